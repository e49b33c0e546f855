"""Documents to typed records: rule-based extraction over a table of texts.

Each operator is DataFrame in, DataFrame out, keeps all input columns and adds
its own. All are row-local: no shuffle, so the partitions of the scan carry
through to the sink, and the same code runs on a stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions import fields, quality
from billwright.functions.text import ascii_digits, to_double

RULES, MODEL = "rules", "ml"
METHODS = (MODEL, RULES)

# Fields of a record in the order of the JSON output, per method.
RULE_FIELDS = (
    "receipt_number",
    "date",
    "bill_to",
    "items",
    "total_amount",
    "raw_text",
    "extraction_confidence",
    "validation_passed",
)
MODEL_FIELDS = (
    "receipt_number",
    "date",
    "bill_to",
    "items",
    "total_amount",
    "vendor",
    "address",
    "raw_text",
    "raw_ocr_words",
    "raw_predictions",
)


# Steps are kept in columns of their own where a later step uses them more than
# once: Catalyst then computes each pattern once per document. The step columns
# start with STEP and are dropped at the end.
STEP = "__rule_"


def _cased(df: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return df.withColumns(
        {"__rule_lower": F.lower(t), "__rule_upper": F.upper(t), "__rule_plain": ascii_digits(t)}
    )


def _drop_steps(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(STEP)])


def _add_date(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__rule_runs", fields.date_runs(F.col(text))).withColumn(
        "date", fields.first_date(F.col("__rule_runs"))
    )


def _add_total(df: DataFrame) -> DataFrame:
    return df.withColumn("__rule_total", fields.total_digits(F.col("__rule_plain"), F.col("__rule_lower"))).withColumn(
        "total_amount", to_double(F.col("__rule_total"))
    )


def _add_vendor(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("__rule_through", fields.through_company_suffix(F.col("__rule_upper"))).withColumn(
        "vendor_rules", fields.vendor(F.col(text), F.col("__rule_through"))
    )


def _add_bill_to(df: DataFrame, text: str) -> DataFrame:
    bill_text, mail, name = map(F.col, ("__rule_bill_text", "__rule_bill_mail", "__rule_bill_name"))
    return (
        df.withColumn("__rule_bill_text", fields.bill_to_text(F.col(text), F.col("__rule_lower")))
        .withColumn("__rule_bill_mail", fields.email(bill_text))
        .withColumn("__rule_bill_name", fields.bill_to_name(bill_text, mail))
        .withColumn("bill_to", fields.bill_to(name, mail))
    )


def with_dates(df: DataFrame, text: str = "text") -> DataFrame:
    return _drop_steps(
        df.withColumn("__rule_runs", fields.date_runs(F.col(text)))
        .withColumn("dates", fields.dates(F.col("__rule_runs")))
        .withColumn("date", F.get("dates", F.lit(0)))
    )


def with_amounts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("amounts", fields.amounts(ascii_digits(F.col(text))))


def with_total(df: DataFrame, text: str = "text") -> DataFrame:
    return _drop_steps(_add_total(_cased(df, text)))


def with_vendor(df: DataFrame, text: str = "text") -> DataFrame:
    return _drop_steps(_add_vendor(_cased(df, text), text))


def with_receipt_number(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("receipt_number", fields.receipt_number(F.col(text)))


def with_bill_to(df: DataFrame, text: str = "text") -> DataFrame:
    return _drop_steps(_add_bill_to(_cased(df, text), text))


def with_item_section(df: DataFrame, text: str = "text") -> DataFrame:
    return _drop_steps(
        _cased(df, text).withColumn("item_section", fields.item_section(F.col("__rule_plain"), F.col("__rule_lower")))
    )


def with_line_items(df: DataFrame, text: str = "text") -> DataFrame:
    return (
        with_item_section(df, text)
        .withColumn("items", fields.line_items(F.col("item_section")))
        .drop("item_section")
    )


def computed_once(df: DataFrame, **counts: Column) -> DataFrame:
    """Keep later filters and explodes from repeating the extraction.

    Catalyst moves a filter on an extracted column below the extraction by copying
    its whole expression, so every pattern behind it would run again. It does not
    move filters past observed metrics; these are also the counters of the run.
    """
    observed = [F.count(F.lit(1)).alias("documents")]
    observed += [c.alias(name) for name, c in counts.items()]
    return df.observe(f"extraction-{uuid.uuid4().hex}", *observed)


def error_class(text: Column) -> Column:
    """Why a document cannot become a record; null when it can."""
    return F.when(text.isNull(), "null_text")


def warning(items: Column) -> Column:
    """What a good record lacks: a quantity above BIGINT is null in its item."""
    overflow = F.exists(items, lambda i: i["quantity"].isNull())
    return F.when(overflow, "quantity_overflow")


def structure_records(df: DataFrame, text: str = "text", only: Column | None = None) -> DataFrame:
    """Full rule-based record of every text, with ``error_class`` for the bad ones.

    All other input columns are kept. ``only`` is a condition on input columns: it is
    applied before the extraction, so that key and partition filters reach the scan (later
    filters stay above the extraction, see ``computed_once``). ``warning`` names a loss
    within a good record.
    """
    if only is not None:
        df = df.filter(only)
    out = _add_bill_to(_add_vendor(_cased(df, text), text), text)
    out = _add_total(_add_date(with_receipt_number(out, text), text)).withColumn(
        "items", fields.line_items(fields.item_section(F.col("__rule_plain"), F.col("__rule_lower")))
    )
    items = F.col("items")
    found = [F.col(c) for c in ("receipt_number", "date", "bill_to", "total_amount")]
    out = out.withColumns(
        {
            "extraction_confidence": quality.confidence(fields=found, items=items),
            "validation_passed": quality.validation(
                F.col("total_amount"), quality.items_total(items)
            ),
            "method": F.lit(RULES),
            "error_class": error_class(F.col(text)),
            "warning": warning(items),
        }
    )
    out = _drop_steps(out).withColumnRenamed(text, "raw_text")
    return computed_once(out, failed=F.count("error_class"))


def split_quarantine(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and the rows that failed with their reason."""
    good = records.filter(F.col("error_class").isNull()).drop("error_class")
    bad = records.filter(F.col("error_class").isNotNull())
    return good, bad


def explode_amounts(df: DataFrame) -> DataFrame:
    """One row per amount; documents without amounts keep one row of nulls."""
    return computed_once(df).select("*", F.posexplode_outer("amounts").alias("pos", "amount")).drop(
        "amounts"
    )


def explode_line_items(records: DataFrame, *keep: str) -> DataFrame:
    """Line-item fact table with the display strings of the item table."""
    rows = records.select(*keep, F.posexplode("items").alias("pos", "item"))
    return rows.select(
        *keep,
        "pos",
        "item.*",
        F.coalesce("item.description", F.lit(quality.MISSING)).alias("show_description"),
        F.coalesce(F.col("item.quantity").cast("string"), F.lit(quality.MISSING)).alias(
            "show_qty"
        ),
        quality.display_money(F.col("item.unit_price"), "$0.00").alias("show_unit_price"),
        quality.display_money(F.col("item.total"), "$0.00").alias("show_total"),
    )


def with_quality(records: DataFrame) -> DataFrame:
    """Tier, validation status, detected format and advice of each record."""
    out = records.withColumns(
        {
            "confidence_tier": quality.confidence_tier(F.col("extraction_confidence")),
            "validation_status": quality.validation_status(F.col("validation_passed")),
            "format": quality.detect_format(F.col("raw_text")),
        }
    )
    return out.withColumn(
        "recommendations", quality.recommendations(F.col("format.supported"))
    )


def with_display(records: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Text shown for each field, N/A where it is missing."""
    shown = {
        "show_vendor": quality.display_text(F.col(vendor)),
        "show_receipt_number": quality.display_text(F.col("receipt_number")),
        "show_date": quality.display_text(F.col("date")),
        "show_total": quality.display_money(F.col("total_amount")),
        "show_bill_to": F.coalesce(F.col("bill_to.name"), F.lit(quality.MISSING)),
    }
    if "address" in records.columns:
        shown["show_address"] = quality.display_text(F.col("address"))
    return records.withColumns(shown)


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"Unknown extraction method {method!r}: use 'ml' or 'rules'.")
    return method


def dispatch(
    documents: DataFrame, model: Callable[[DataFrame], DataFrame], text: str = "text"
) -> DataFrame:
    """Records of each document by the method its ``method`` column names.

    The rules run on their documents only and ``model`` on its own; documents
    naming any other method come back with ``unknown_method``. Without a method the model
    is meant. No join is needed here; ``model`` must work on the rows it is given.
    """
    method = F.coalesce("method", F.lit(MODEL))
    by_rules = structure_records(documents.filter(method == RULES), text)
    by_model = model(documents.filter(method == MODEL))
    unknown = (
        documents.filter(~method.isin(*METHODS))
        .withColumnRenamed(text, "raw_text")
        .withColumn("error_class", F.lit("unknown_method"))
    )
    return by_rules.unionByName(by_model, allowMissingColumns=True).unionByName(
        unknown, allowMissingColumns=True
    )


def section_lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Lines of the item section with the numbers, quantity and text read from each."""
    lines = F.split("item_section", "\n")
    rows = computed_once(with_item_section(df, text)).select(
        *keep, F.posexplode(F.slice(lines, F.lit(2), F.size(lines))).alias("line_no", "line")
    )
    line = F.col("line")
    return rows.withColumn("__rule_digits", fields.leading_digits(line)).select(
        *keep,
        "line_no",
        "line",
        fields.line_numbers(line).alias("numbers"),
        fields.quantity(F.col("__rule_digits")).alias("quantity"),
        fields.description(line).alias("description"),
    )
