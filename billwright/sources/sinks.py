"""JSON output of records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.operators.records import MODEL, MODEL_FIELDS, RULE_FIELDS, RULES


def with_output_name(records: DataFrame, stem: str) -> DataFrame:
    """File name each record has as a single JSON file."""
    name = F.concat(F.col(stem).cast("string"), F.lit("_"), F.coalesce("method", F.lit("")), F.lit(".json"))
    return records.withColumn("output_name", name)


def shared_names(named: DataFrame) -> DataFrame:
    """File names that several records have: as single files they would overwrite each other.

    Only names are read and counted, one row per task and name.
    """
    counts = named.groupBy("output_name").agg(F.count("*").alias("records"))
    return counts.filter("records > 1")


def record_json(records: DataFrame, *keys: str) -> DataFrame:
    """Adds the record as JSON text: keys, nulls, and the fields of its method.

    A record of no known method has null JSON.
    """

    def as_json(fields: tuple[str, ...]):
        present = [*keys, *(f for f in fields if f in records.columns)]
        return F.to_json(F.struct(*present), {"ignoreNullFields": "false"})

    json = F.when(F.col("method") == RULES, as_json(RULE_FIELDS)).when(
        F.col("method") == MODEL, as_json(MODEL_FIELDS)
    )
    return records.withColumn("json", json)


def sink_json(
    records: DataFrame, path: str, stem: str = "doc_id", keys: tuple[str, ...] = ("doc_id",),
    mode: str = "error",
) -> DataFrame:
    """Write one JSON object per line, in a folder per method; return the shared file names.

    Each object has the ``keys`` and ``output_name`` of its record. Records of no known
    method go to the folder ``method=rejected`` with their keys alone. Payloads are written
    where they are made, without a shuffle; names shared by several records are then found
    from the written names and stored beside, in ``{path}-shared-names``.
    """
    named = record_json(with_output_name(records, stem), *keys, "output_name")
    rejected = F.to_json(F.struct(*keys, "output_name"), {"ignoreNullFields": "false"})
    lines = named.select(
        F.coalesce("json", rejected).alias("value"),
        F.when(F.col("json").isNull(), "rejected").otherwise(F.col("method")).alias("method"),
    )
    lines.write.mode(mode).partitionBy("method").text(path)
    written = records.sparkSession.read.schema("output_name string, method string").json(path)
    side = f"{path.rstrip('/')}-shared-names"
    shared_names(written.filter("method != 'rejected'")).write.mode(mode).parquet(side)
    return records.sparkSession.read.parquet(side)


def export_path(folder: str, run_time: datetime) -> str:
    """Run-stamped path of a download export."""
    return f"{folder.rstrip('/')}/invoice_data_{run_time:%Y%m%d_%H%M%S}.json"


def sink_export_named(
    records: DataFrame, folder: str, run_time: datetime, stem: str = "doc_id",
    keys: tuple[str, ...] = ("doc_id",),
) -> str:
    path = export_path(folder, run_time)
    sink_json(records, path, stem, keys)
    return path
