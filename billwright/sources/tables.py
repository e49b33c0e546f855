"""Readers of document texts, OCR words and token predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.session import spread

TEXT_SCHEMA = "doc_id long, text string"
WORD_SCHEMA = (
    "doc_id long, row_no int, text string, conf double, "
    "left int, top int, width int, height int"
)
TOKEN_SCHEMA = "doc_id long, token_idx long, word_idx long, label_id int"
CORRUPT = "_corrupt_record"


def scan_text(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Document texts as (doc_id, text); only these two columns are read.

    ``fmt`` is parquet, orc or json. For ``text`` every file is one document and
    ``doc_id`` is its path.
    """
    if fmt == "text":
        df = spark.read.text(path, wholetext=True)
        return df.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError(f"cannot scan text from format {fmt!r}")
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(f"`{id_column}` long, `{text_column}` string")
    df = reader.format(fmt).load(path)
    return df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def scan_ocr_words(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """OCR word table.

    Tab-separated files are read by the names in their header (all files of a call share
    one order): further columns don't matter, ``doc_id`` comes from the file's name where
    the header lacks it (its number, else a hash of the path). A row with a value that
    can't be read keeps null there and its fields in ``_corrupt_record``.
    """
    if fmt == "tsv":
        raw = spark.read.options(sep="\t", header=True, quote="", mode="PERMISSIVE").csv(path)
        wanted = dict(part.split() for part in WORD_SCHEMA.split(", "))
        missing = set(wanted) - set(raw.columns) - {"doc_id"}
        if missing:
            raise ValueError(f"the header lacks {sorted(missing)}")
        file = F.col("_metadata.file_path")
        stem = F.regexp_extract(file, r"([0-9]+)\.[^/]*$", 1)
        from_file = F.coalesce(stem.try_cast("long"), F.xxhash64(file))
        values, unread = [], F.lit(False)
        for name, kind in wanted.items():
            if name not in raw.columns:
                values.append(from_file.alias(name))
                continue
            value = F.col(name) if kind == "string" else F.col(name).try_cast(kind)
            values.append(value.alias(name))
            if kind != "string":
                unread = unread | value.isNull()
        line = F.concat_ws("\t", *(F.coalesce(c, F.lit("")) for c in raw.columns))
        return raw.select(*values, F.when(unread, line).alias(CORRUPT))
    return spark.read.schema(WORD_SCHEMA).format(fmt).load(path)


def with_engine(
    inputs: DataFrame,
    step: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Run a user's own OCR or model step over the inputs.

    ``step`` gets and yields Arrow-backed batches (``mapInPandas``) and must produce
    ``WORD_SCHEMA`` or ``TOKEN_SCHEMA``; it should load its engine once per call.
    ``partitions`` deals the inputs out first, for few large files.
    """
    if schema not in (WORD_SCHEMA, TOKEN_SCHEMA):
        raise ValueError("the step must produce WORD_SCHEMA or TOKEN_SCHEMA rows")
    return spread(inputs, partitions).mapInPandas(step, schema)
