"""Corpus-level reports: plain aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_FIELDS = ("receipt_number", "date", "bill_to", "total_amount")


def _with_status(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "status", F.when(F.col("error_class").isNull(), "ok").otherwise("failed")
    )


def batch_summary(records: DataFrame) -> DataFrame:
    """Documents per method and outcome."""
    return (
        _with_status(records)
        .groupBy("method", "status", "error_class")
        .agg(F.count("*").alias("documents"))
    )


def unprocessed_docs(documents: DataFrame, good_records: DataFrame, key: list[str]) -> DataFrame:
    """Input documents without a record."""
    return documents.join(good_records.select(*key), key, "left_anti")


def quality_report(rated: DataFrame) -> DataFrame:
    """Documents and mean confidence by tier, validation and format."""
    return rated.groupBy(
        "confidence_tier", "validation_status", F.col("format.name").alias("format_name")
    ).agg(
        F.count("*").alias("documents"),
        F.avg("extraction_confidence").alias("avg_confidence"),
    )


def quality_rollup(rated: DataFrame) -> DataFrame:
    """``quality_report`` with its subtotals by tier, by tier and validation, and the total.

    ``level`` tells them from rows whose own value is null: 0 for the rows of the report, 1 for
    a sum over formats, 3 over validation and formats, 7 over everything. One shuffle: the
    subtotals are made from rows expanded in each task and combined there.
    """
    rows = rated.withColumn("format_name", F.col("format.name"))
    return rows.rollup("confidence_tier", "validation_status", "format_name").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("documents"),
        F.avg("extraction_confidence").alias("avg_confidence"),
        F.count_if(F.col("total_amount").isNull()).alias("without_total"),
    )


def processed_per_session(events: DataFrame, key: str, ts: str = "ingest_ts", gap: str = "30 minutes") -> DataFrame:
    """Documents of each session of a user: uploads at most ``gap`` apart, as (key, first, until, documents).

    ``until`` is the last upload plus the gap. Sessions that a later row joins are merged. The
    same code runs on a stream. Rows without a time are in no session; a null key is one user.
    """
    return (
        events.groupBy(key, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("documents"))
        .select(
            key,
            F.col("w.start").cast("timestamp_ntz").alias("first"),
            F.col("w.end").cast("timestamp_ntz").alias("until"),
            "documents",
        )
    )


def field_fill_rate(records: DataFrame, *by: str) -> DataFrame:
    """Share of documents in which each field was found."""

    def rate(found: Column, name: str) -> Column:
        return F.avg(found.cast("int")).alias(f"{name}_rate")

    return records.groupBy(*by).agg(
        F.count("*").alias("documents"),
        *[rate(F.col(f).isNotNull(), f) for f in REPORT_FIELDS],
        rate(F.size("items") > 0, "items"),
    )


def field_accuracy(
    pairs: DataFrame, fields: dict[str, tuple[str, str]], by_side: str | None = None
) -> DataFrame:
    """Precision, recall and F1 per field from rows holding expected and actual values.

    ``fields`` maps a field name to its (expected, actual) columns. The counts of
    all fields are gathered in one pass and one exchange of a single row per task.
    ``by_side`` names a column of ``both``, ``missing`` or ``unexpected``, whose rows are counted too.
    """
    sides = {"records": "both", "missing_records": "missing", "unexpected_records": "unexpected"}
    counts = []
    if by_side:
        counts += [F.count_if(F.col(by_side) == side).alias(name) for name, side in sides.items()]
    for name, (expected, actual) in fields.items():
        e, a = F.col(expected), F.col(actual)
        same = F.coalesce(e == a, F.lit(False))
        counts += [
            F.count_if(same).alias(f"{name}_tp"),
            F.count_if(a.isNotNull() & ~same).alias(f"{name}_fp"),
            F.count_if(e.isNotNull() & ~same).alias(f"{name}_fn"),
        ]
    totals = pairs.agg(*counts)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("field"),
                    F.col(f"{n}_tp").alias("tp"),
                    F.col(f"{n}_fp").alias("fp"),
                    F.col(f"{n}_fn").alias("fn"),
                )
                for n in fields
            ]
        )
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    kept = list(sides) if by_side else []
    return totals.select(rows.alias("r"), *kept).select("r.*", *kept).withColumns(
        {
            "precision": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
            "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        }
    )


def expected_accuracy(
    expected: DataFrame, actual: DataFrame, key: str, fields: tuple[str, ...]
) -> DataFrame:
    """``field_accuracy`` of two tables, with the records that only one of them has.

    Both have the key and the fields by the same names. Of an expected record that is missing
    every value is a false negative, of an unexpected one every value a false positive; the
    columns ``missing_records`` and ``unexpected_records`` count them, ``records`` counts those
    of both. Rows with a null key match nothing. Tables of ``session.bucketed`` with the same
    number of buckets are joined where they lie.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        values = (F.col(f).alias(f"__{name}_{f}") for f in fields)
        return rows.select(F.col(key).alias(f"__{name}_key"), F.lit(True).alias(f"__{name}"), *values)

    one, two = side(expected, "e"), side(actual, "a")
    pairs = one.join(two, F.col("__e_key") == F.col("__a_key"), "full")
    # a value stands on either side of a row that has no partner for it
    pairs = pairs.select(
        *(F.col(f"__{s}_{f}") for s in "ea" for f in fields),
        F.when(F.col("__a").isNull(), "missing")
        .when(F.col("__e").isNull(), "unexpected")
        .otherwise("both")
        .alias("__side"),
    )
    return field_accuracy(pairs, {f: (f"__e_{f}", f"__a_{f}") for f in fields}, by_side="__side")


def processed_per_day(events: DataFrame, ts: str = "ingest_ts") -> DataFrame:
    """Documents processed per calendar day; the same code runs on a stream."""
    return (
        events.groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.count("*").alias("documents"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "documents")
    )
