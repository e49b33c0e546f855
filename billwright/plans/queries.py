"""Registered queries: every operator over the whole of the given tables.

Nested results are flattened to scalar columns, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.functions import entities as ent
from billwright.functions import quality
from billwright.operators import dates, entities, formats, records, reports, statistics, words
from billwright.plans import corpus as src
from billwright.session import bucketed, input_partitions, shared_folder, spread, stored, tasks_for
from billwright.sources import images, record_files, sinks, tables
from billwright.streaming import corrections, ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ("corpus", "doc_id")
LANDING = "/landing"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- Inputs ----------------------------------------------------------------------
def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.corpus(spark, sf_dir).select(*KEY, "text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good records of all texts."""
    return records.split_quarantine(records.structure_records(src.corpus(spark, sf_dir)))[0]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.read_documents(spark, sf_dir)


def _ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.ocr_words(_documents(spark, sf_dir))


TASK_CHARS = 8_000_000  # of the texts whose words one task sorts: about a million words


def _word_tasks(documents: DataFrame) -> int:
    return tasks_for(documents, F.length("text"), TASK_CHARS)


def _kept_words(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    documents = _documents(spark, sf_dir)
    tasks = tasks or _word_tasks(documents)
    return words.filter_confident_words(src.ocr_words(documents), tasks)


def _boxed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_boxes(_kept_words(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    return src.token_predictions(_kept_words(spark, sf_dir, tasks))


def _labels_of(kept: DataFrame, tasks: int | None = None) -> DataFrame:
    return entities.word_labels(src.token_predictions(kept), src.LABELS, tasks)


WORD_COLUMNS = ("doc_id", "ocr_run", "word_idx", "text", "left", "top", "width", "height")


def _stored_words(documents: DataFrame, tasks: int) -> DataFrame:
    """Kept words as later steps read them: each run of a page stays in its bucket."""
    kept = words.filter_confident_words(src.ocr_words(documents), tasks).select(*WORD_COLUMNS)
    return bucketed(kept, "kept-words", ("doc_id", "ocr_run"), tasks, is_dealt=True)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    tasks = _word_tasks(documents)
    kept = _stored_words(documents, tasks)
    return entities.merge_entities(_labels_of(kept, tasks), words.word_boxes(kept), tasks)


def _model_records(documents: DataFrame, *keys: str) -> DataFrame:
    """Model records of the given documents (keys, doc_id, text): only their words are made."""
    tasks = _word_tasks(documents)
    kept = _stored_words(documents, tasks)
    labels = bucketed(_labels_of(kept, tasks), "word-labels", "doc_id", tasks, is_dealt=True)
    sizes = src.page_sizes(documents)
    documents = documents.select(*keys)
    errors = entities.page_errors(labels, kept, sizes)
    merged = entities.merge_entities(labels, words.word_boxes(kept), tasks)
    return entities.entities_to_record(documents, merged, kept, errors, tasks)


# ---- Scans and sinks ---------------------------------------------------------------
@query
def scan_text(spark, sf_dir):
    docs = tables.scan_text(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


@query
def scan_image_manifest(spark, sf_dir):
    return images.image_manifest(src.landed_files(_documents(spark, sf_dir)), LANDING)


@query
def first_sample(spark, sf_dir):
    return images.first_sample(src.landed_files(_documents(spark, sf_dir)), LANDING)


@query
def scan_image_checked(spark, sf_dir):
    """Sizes and faults of image files, whose bytes hold the texts of ``documents``."""
    return images.checked_headers(src.image_files(_documents(spark, sf_dir)))


@query
def image_faults(spark, sf_dir):
    """How many files of each kind have each fault, and the pixels of the sound ones."""
    found = scan_image_checked(spark, sf_dir)
    return found.groupBy("kind", "problem").agg(
        F.count("*").alias("files"),
        F.sum(F.col("width").cast("long") * F.col("height") * F.col("channels")).alias("samples"),
    )


@query
def scan_ocr_words(spark, sf_dir):
    path = shared_folder(spark, "ocr-words")
    _ocr_words(spark, sf_dir).write.parquet(path)
    return tables.scan_ocr_words(spark, path)


JSON_SCHEMA = (
    "corpus string, doc_id long, output_name string, receipt_number string, date string, "
    "bill_to struct<name:string,email:string>, "
    "items array<struct<description:string,quantity:bigint,unit_price:double,total:double>>, "
    "total_amount double, extraction_confidence int, validation_passed boolean, method string"
)


def _records_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _records(spark, sf_dir).withColumn("stem", F.col("doc_id") % 20000)
    return kept.select(*KEY, "stem", "method", *records.RULE_FIELDS)


def _read_back(spark: SparkSession, path: str, shared: DataFrame) -> DataFrame:
    lines = spark.read.text(path)
    written = lines.withColumn("r", F.from_json("value", JSON_SCHEMA.rpartition(", ")[0]))
    marked = shared.select(F.col("output_name").alias("_shared"))
    rows = written.join(marked, F.col("r.output_name") == F.col("_shared"), "left")
    return rows.select(
        "r.corpus",
        "r.doc_id",
        "r.output_name",
        F.col("_shared").isNotNull().alias("duplicate_name"),
        "method",
        "r.receipt_number",
        "r.date",
        F.col("r.bill_to.name").alias("bill_to_name"),
        F.size("r.items").alias("n_items"),
        "r.total_amount",
        "r.extraction_confidence",
        "r.validation_passed",
        F.contains("value", F.lit('"bill_to":null')).alias("null_kept"),
    )


@query
def sink_json(spark, sf_dir):
    path = shared_folder(spark, "records-json")
    shared = sinks.sink_json(_records_to_write(spark, sf_dir), path, "stem", tuple(KEY))
    return _read_back(spark, path, shared)


@query
def sink_json_files(spark, sf_dir):
    """The records of ``documents``, one indented file each, read back; stems repeat."""
    path = shared_folder(spark, "record-files")
    kept = records.split_quarantine(records.structure_records(_documents(spark, sf_dir)))[0]
    kept = kept.withColumn("stem", F.floor(F.col("doc_id") / 3)).select(
        "doc_id", "stem", "method", *records.RULE_FIELDS
    )
    record_files.sink_json_files(kept, path, "stem")
    # the files are read once, in Python; what is read from their texts is not
    back = stored(record_files.read_json_files(spark, path), "record-texts")
    schema = JSON_SCHEMA.replace("corpus string, ", "").rpartition(", ")[0]
    return back.withColumn("r", F.from_json("value", schema)).select(
        "r.doc_id",
        F.regexp_replace("file", "~[0-9]+", "").alias("output_name"),
        "r.receipt_number",
        "r.date",
        F.col("r.bill_to.name").alias("bill_to_name"),
        F.size("r.items").alias("n_items"),
        "r.total_amount",
        "r.extraction_confidence",
        F.startswith("value", F.lit('{\n  "doc_id": ')).alias("indented"),
        F.contains("value", F.lit('\n  "bill_to": null')).alias("null_kept"),
    )


@query
def sink_export_named(spark, sf_dir):
    run_time = datetime(2024, 2, 3, 4, 5, 6)
    folder = shared_folder(spark, "export")
    path = sinks.sink_export_named(_records_to_write(spark, sf_dir), folder, run_time, "stem", tuple(KEY))
    shared = spark.read.parquet(f"{path}-shared-names")
    return _read_back(spark, path, shared).withColumn("export_name", F.lit(path.rpartition("/")[2]))


# Confidences of some words are made unusable, huge or missing.
def _spoiled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.pmod(F.col("row_no"), F.lit(97))
    conf = F.when(part == 5, None).when(part == 6, float("nan")).when(part == 7, 1e300)
    text = F.when(part != 8, F.col("text"))
    known = part.isin(5, 6, 7)
    return _ocr_words(spark, sf_dir).withColumns(
        {"conf": F.when(known, conf).otherwise(F.col("conf")), "text": text}
    )


@query
def word_quarantine(spark, sf_dir):
    found = words.word_quarantine(_spoiled_words(spark, sf_dir))
    return found.select("doc_id", "row_no", "text", "error_class")


@query
def confident_spoiled_words(spark, sf_dir):
    kept = words.confident_words(_spoiled_words(spark, sf_dir))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_words"))


# ---- OCR words ---------------------------------------------------------------------
@query
def filter_confident_words(spark, sf_dir):
    return _kept_words(spark, sf_dir).select("doc_id", "row_no", "word_idx", "text", "conf")


@query
def word_boxes(spark, sf_dir):
    return _boxed_words(spark, sf_dir).select("doc_id", "word_idx", "box.*")


@query
def normalize_boxes(spark, sf_dir):
    sizes = src.page_sizes(_documents(spark, sf_dir))
    return words.normalize_boxes(_boxed_words(spark, sf_dir), sizes).select(
        "doc_id", "word_idx", "norm_box.*", "error_class"
    )


@query
def page_text(spark, sf_dir):
    return words.page_text(_kept_words(spark, sf_dir), with_words=True).select(
        "doc_id", "raw_text", F.size("words").alias("n_words")
    )


@query
def best_ocr_variant(spark, sf_dir):
    best = words.best_ocr_variant(src.ocr_variants(_documents(spark, sf_dir)))
    return best.select("doc_id", "config_rank", "config", "n_chars", F.md5("text").alias("md5"))


@query
def best_of_two_variants(spark, sf_dir):
    best = words.best_ocr_variant(
        src.ocr_variants(_documents(spark, sf_dir)), ("--psm 6", "--psm 11")
    )
    return best.select("doc_id", "config", "n_chars")


@query
def ocr_variant_lengths(spark, sf_dir):
    out = words.ocr_variant_lengths(src.ocr_variants(_documents(spark, sf_dir)))
    return out.withColumn("avg_chars", F.round("avg_chars", 4))


# ---- Text fields --------------------------------------------------------------------
@query
def extract_dates(spark, sf_dir):
    out = records.with_dates(_texts(spark, sf_dir))
    return out.select(*KEY, F.array_join("dates", "|").alias("dates"), F.size("dates").alias("n"))


@query
def dedupe_stable(spark, sf_dir):
    out = records.computed_once(records.with_dates(_texts(spark, sf_dir)))
    return out.select(*KEY, F.posexplode("dates").alias("pos", "date_text"))


@query
def first_date(spark, sf_dir):
    out = records.with_dates(_texts(spark, sf_dir))
    return out.select(*KEY, "date")


@query
def date_parsed(spark, sf_dir):
    """Invoices, in which some sources write the month first, and all documents."""
    columns = [*KEY, "source", "text"]
    texts = src.with_mixed_dates(src.read_invoices(spark, sf_dir)).select(*columns)
    texts = texts.unionByName(_documents(spark, sf_dir).select(*columns))
    return dates.with_parsed_dates(records.with_dates(texts), list(KEY))


@query
def date_votes(spark, sf_dir):
    """How many dates of each source speak for each order, and what they decide."""
    decided = date_parsed(spark, sf_dir).filter("date IS NOT NULL")
    return decided.groupBy("corpus", "source").agg(
        F.count_if(F.col("decided_by") == "date").alias("by_date"),
        F.count_if(F.col("decided_by") == "source").alias("by_source"),
        F.count_if(F.col("date_problem").isNotNull()).alias("unread"),
        F.min("date_parsed").alias("first_day"),
        F.max("date_parsed").alias("last_day"),
    )


@query
def extract_amounts(spark, sf_dir):
    out = records.with_amounts(_texts(spark, sf_dir))
    total = F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        *KEY,
        F.size("amounts").alias("n"),
        F.round(total, 2).alias("sum_amounts"),
        F.array_max("amounts").alias("max_amount"),
    )


@query
def explode_amounts(spark, sf_dir):
    return records.explode_amounts(records.with_amounts(_texts(spark, sf_dir))).drop("text")


@query
def amount_statistics(spark, sf_dir):
    """Amounts of all texts, per corpus and source and per corpus (source ``(all)``)."""
    amounts = records.explode_amounts(
        records.with_amounts(src.corpus(spark, sf_dir).select("corpus", "source", "text"))
    )
    amounts = stored(amounts.filter("amount IS NOT NULL").select("corpus", "source", "amount"), "amounts")
    by_source = statistics.value_statistics(amounts, "amount", ("corpus", "source"))
    whole = statistics.value_statistics(amounts, "amount", ("corpus",))
    both = by_source.unionByName(whole.withColumn("source", F.lit("(all)")))
    common = F.transform(
        "common", lambda c: F.format_string("%.2f x %d", c["value"], c["n"])
    )
    return both.withColumn("common", F.array_join(common, ", ")).withColumn("total", F.round("total", 2))


@query
def amount_heavy_hitters(spark, sf_dir):
    """The 20 commonest amounts of each corpus."""
    amounts = records.explode_amounts(records.with_amounts(src.corpus(spark, sf_dir).select("corpus", "text")))
    counts = statistics.value_counts(amounts, "amount", "corpus")
    return statistics.common_values(counts, ("corpus",), 20)


@query
def extract_total(spark, sf_dir):
    return records.with_total(_texts(spark, sf_dir)).drop("text")


@query
def extract_vendor(spark, sf_dir):
    return records.with_vendor(_texts(spark, sf_dir)).drop("text")


@query
def extract_receipt_number(spark, sf_dir):
    return records.with_receipt_number(_texts(spark, sf_dir)).drop("text")


@query
def extract_bill_to(spark, sf_dir):
    out = records.with_bill_to(_texts(spark, sf_dir))
    return out.select(*KEY, F.col("bill_to.name").alias("name"), F.col("bill_to").isNull().alias("missing"))


@query
def email_in_bill_to(spark, sf_dir):
    out = records.with_bill_to(_texts(spark, sf_dir))
    return out.select(*KEY, "bill_to.email")


@query
def item_section(spark, sf_dir):
    out = records.section_lines(_texts(spark, sf_dir), *KEY)
    return out.select(*KEY, "line_no", "line")


@query
def item_line_numbers(spark, sf_dir):
    out = records.section_lines(_texts(spark, sf_dir), *KEY)
    return out.select(*KEY, "line_no", F.array_join("numbers", "|").alias("numbers"))


@query
def item_quantity(spark, sf_dir):
    out = records.section_lines(_texts(spark, sf_dir), *KEY)
    return out.select(*KEY, "line_no", "quantity")


@query
def item_description(spark, sf_dir):
    out = records.section_lines(_texts(spark, sf_dir), *KEY)
    return out.select(*KEY, "line_no", "description")


@query
def extract_line_items(spark, sf_dir):
    out = records.computed_once(records.with_line_items(_texts(spark, sf_dir)))
    return out.select(*KEY, F.posexplode("items").alias("pos", "item")).select(
        *KEY, "pos", "item.*"
    )


@query
def explode_line_items(spark, sf_dir):
    out = records.explode_line_items(_records(spark, sf_dir), *KEY)
    shown = [c for c in out.columns if c.startswith("show_")]
    return out.select(*KEY, "pos", *shown)


@query
def structure_records(spark, sf_dir):
    return _records(spark, sf_dir).select(
        *KEY,
        "method",
        "receipt_number",
        "date",
        F.col("bill_to.name").alias("bill_to_name"),
        F.col("bill_to.email").alias("bill_to_email"),
        F.size("items").alias("n_items"),
        F.round(quality.items_total(F.col("items")), 2).alias("items_total"),
        "total_amount",
        F.md5("raw_text").alias("raw_text_md5"),
        "extraction_confidence",
        "validation_passed",
        "vendor_rules",
    )


@query
def quarantine(spark, sf_dir):
    bad = records.split_quarantine(records.structure_records(src.corpus(spark, sf_dir)))[1]
    return bad.select(*KEY, "error_class")


# ---- Quality and display ---------------------------------------------------------------
@query
def extraction_confidence(spark, sf_dir):
    return _records(spark, sf_dir).select(*KEY, "extraction_confidence")


@query
def validate_total(spark, sf_dir):
    return _records(spark, sf_dir).select(*KEY, "validation_passed")


@query
def item_total_sum(spark, sf_dir):
    total = quality.items_total(F.col("items"))
    return _records(spark, sf_dir).select(*KEY, F.round(total, 2).alias("items_total"))


@query
def detect_format(spark, sf_dir):
    fmt = quality.detect_format(F.col("text"))
    return _texts(spark, sf_dir).withColumn("f", fmt).select(
        *KEY, "f.name", "f.confidence", "f.supported", F.array_join("f.indicators", "|").alias("indicators")
    )


@query
def detect_format_templates(spark, sf_dir):
    """The strongest of about 200 templates, by one pattern."""
    found = formats.with_format(_texts(spark, sf_dir), src.format_templates(spark))
    return found.select(
        *KEY,
        "format.name",
        "format.confidence",
        "format.supported",
        "format.mark",
        F.array_join("format.indicators", "|").alias("indicators"),
    )


@query
def format_recommendations(spark, sf_dir):
    advice = quality.recommendations(quality.detect_format(F.col("text"))["supported"])
    return _texts(spark, sf_dir).select(*KEY, F.array_join(advice, "|").alias("recommendations"))


@query
def confidence_tier(spark, sf_dir):
    return records.with_quality(_records(spark, sf_dir)).select(*KEY, "confidence_tier")


@query
def validation_status(spark, sf_dir):
    return records.with_quality(_records(spark, sf_dir)).select(*KEY, "validation_status")


@query
def display_defaults(spark, sf_dir):
    shown = records.with_display(_records(spark, sf_dir), vendor="vendor_rules")
    return shown.select(
        *KEY, "show_vendor", "show_receipt_number", "show_date", "show_total", "show_bill_to"
    )


# ---- Token predictions and entities ------------------------------------------------------
@query
def truncate_tokens(spark, sf_dir):
    return entities.truncate_tokens(_tokens(spark, sf_dir))


@query
def words_lost(spark, sf_dir):
    tasks = _word_tasks(_documents(spark, sf_dir))
    return entities.words_lost(_tokens(spark, sf_dir, tasks), tasks)


@query
def word_labels(spark, sf_dir):
    tasks = _word_tasks(_documents(spark, sf_dir))
    return _labels_of(_kept_words(spark, sf_dir, tasks), tasks).select(
        "doc_id", "word_idx", "label_id", "label"
    )


@query
def logits_to_label(spark, sf_dir):
    logits = src.table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    logits = spread(logits, input_partitions(spark))
    return entities.logits_to_labels(logits, "embedding").select("vec_id", "label_id")


@query
def merge_entities(spark, sf_dir):
    return _entities(spark, sf_dir).select(
        "doc_id",
        "entity_type",
        "text",
        F.size("bbox").alias("n_words"),
        F.array_min(F.transform("bbox", lambda b: b[0])).alias("min_x0"),
        F.array_min(F.transform("bbox", lambda b: b[1])).alias("min_y0"),
        F.array_max(F.transform("bbox", lambda b: b[2])).alias("max_x1"),
        F.array_max(F.transform("bbox", lambda b: b[3])).alias("max_y1"),
    )


@query
def parse_entity_total(spark, sf_dir):
    return _entities(spark, sf_dir).select(
        "doc_id", "entity_type", ent.entity_total(F.col("text")).alias("amount")
    )


@query
def entities_to_record(spark, sf_dir):
    return _model_records(_documents(spark, sf_dir), "doc_id").select(
        "doc_id",
        "method",
        "vendor",
        "address",
        "date",
        "total_amount",
        F.md5("raw_text").alias("raw_text_md5"),
        F.size("raw_ocr_words").alias("n_words"),
        F.size("raw_predictions").alias("n_entities"),
        "extraction_confidence",
        "error_class",
    )


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices by the rules, documents by the model, a few naming neither."""
    method = (
        F.when(F.col("doc_id") % 101 == 100, "auto")
        .when(F.col("corpus") == src.DOCUMENTS, records.MODEL)
        .otherwise(records.RULES)
    )
    docs = _texts(spark, sf_dir).withColumn("method", method)

    def model(chosen: DataFrame) -> DataFrame:
        return _model_records(chosen, *KEY)

    return records.dispatch(docs, model)


@query
def dispatch_method(spark, sf_dir):
    return _dispatched(spark, sf_dir).select(
        *KEY, "method", "date", "total_amount", "vendor", "receipt_number", "error_class"
    )


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good records of both methods, with tier, status and the text shown for each field."""
    good = records.split_quarantine(_dispatched(spark, sf_dir))[0]
    return records.with_display(records.with_quality(good))


@query
def display_both_methods(spark, sf_dir):
    return _shown(spark, sf_dir).select(
        *KEY,
        "method",
        "show_vendor",
        "show_address",
        "show_receipt_number",
        "show_date",
        "show_total",
        "show_bill_to",
        "confidence_tier",
        "validation_status",
    )


@query
def quality_of_both_methods(spark, sf_dir):
    rows = _shown(spark, sf_dir).groupBy("method", "confidence_tier", "validation_status")
    return rows.agg(F.count("*").alias("documents"))


@query
def complete_from_rules(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = _model_records(docs, "doc_id")
    rules = records.structure_records(docs)
    return entities.complete_from_rules(model, rules).select(
        "doc_id",
        "receipt_number",
        "date",
        "total_amount",
        "vendor",
        F.size("items").alias("n_items"),
    )


# ---- Reports -----------------------------------------------------------------------------
@query
def batch_summary(spark, sf_dir):
    return reports.batch_summary(_dispatched(spark, sf_dir))


@query
def unprocessed_docs(spark, sf_dir):
    done = _records(spark, sf_dir)
    return reports.unprocessed_docs(_texts(spark, sf_dir), done, list(KEY)).select(*KEY)


@query
def quality_report(spark, sf_dir):
    report = reports.quality_report(records.with_quality(_records(spark, sf_dir)))
    return report.withColumn("avg_confidence", F.round("avg_confidence", 4))


@query
def quality_rollup(spark, sf_dir):
    report = reports.quality_rollup(records.with_quality(_records(spark, sf_dir)))
    return report.withColumn("avg_confidence", F.round("avg_confidence", 4))


@query
def field_fill_rate(spark, sf_dir):
    rates = reports.field_fill_rate(_records(spark, sf_dir), "corpus", "lang", "source")
    return rates.withColumns(
        {c: F.round(c, 6) for c in rates.columns if c.endswith("_rate")}
    )


@query
def field_accuracy(spark, sf_dir):
    found = records.structure_records(src.read_invoices(spark, sf_dir)).withColumn(
        "bill_to_name", F.col("bill_to.name")
    )
    scores = reports.field_accuracy(
        found,
        {
            "receipt_number": ("truth_number", "receipt_number"),
            "date": ("truth_date", "date"),
            "total_amount": ("truth_total", "total_amount"),
            "bill_to": ("truth_name", "bill_to_name"),
        },
    )
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


EXPECTED_BUCKETS = 16


@query
def expected_accuracy(spark, sf_dir):
    """Records of the invoices against what ``orders`` expects; each side lacks some."""
    invoices = src.read_invoices(spark, sf_dir)
    expected = invoices.filter("doc_id % 41 != 0").select(
        "doc_id",
        F.col("truth_number").alias("receipt_number"),
        F.col("truth_date").alias("date"),
        F.col("truth_total").alias("total_amount"),
        F.col("truth_name").alias("bill_to_name"),
    )
    found = records.split_quarantine(records.structure_records(invoices))[0]
    found = found.withColumn("bill_to_name", F.col("bill_to.name"))
    fields = ("receipt_number", "date", "total_amount", "bill_to_name")
    tables_of = [
        bucketed(t.select("doc_id", *fields), name, "doc_id", EXPECTED_BUCKETS)
        for t, name in ((expected, "expected-records"), (found, "actual-records"))
    ]
    scores = reports.expected_accuracy(*tables_of, "doc_id", fields)
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# ---- Streams -------------------------------------------------------------------------------
def _stream(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    whole = src.table(spark, sf_dir, name, *columns)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)
    return ingest.stream_table(spark, sf_dir, ddl, f"{name}.parquet")


@query
def ingest_without_repeats(spark, sf_dir):
    """Two runs of a stream; the second one brings a tenth of the first one's texts again."""
    landing, output, checkpoint = (shared_folder(spark, f"repeats-{n}") for n in ("in", "out", "state"))
    docs = _documents(spark, sf_dir).select(
        "doc_id", "text", F.to_timestamp(F.lit("2024-01-01 10:00:00")).alias("ingest_ts")
    )
    schema = "doc_id long, text string, ingest_ts timestamp"
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1 OR doc_id % 20 = 0"):
        docs.filter(part).write.mode("append").parquet(landing)
        stream = ingest.stream_table(spark, landing, schema)
        once = ingest.drop_repeats(stream, ["doc_id"], "ingest_ts", "1 hour")
        ingest.incremental_ingest(once, output, checkpoint).awaitTermination()
    found = spark.read.parquet(output).groupBy("doc_id")
    return found.agg(F.count("*").alias("records"), F.max("date").alias("date"))


@query
def incremental_ingest(spark, sf_dir):
    orders = _stream(
        spark,
        sf_dir,
        "orders",
        "o_orderkey",
        "o_custkey",
        "o_orderdate",
        "o_totalprice",
        "o_orderpriority",
    )

    def extract(batch: DataFrame) -> DataFrame:
        return records.structure_records(src.invoices(batch).select("doc_id", "text"))

    output, checkpoint = shared_folder(spark, "ingest"), shared_folder(spark, "ingest-state")
    parts = input_partitions(spark)
    ingest.incremental_ingest(orders, output, checkpoint, extract, parts).awaitTermination()
    return spark.read.parquet(output).select(
        "doc_id",
        "receipt_number",
        "date",
        "total_amount",
        F.size("items").alias("n_items"),
        "extraction_confidence",
        "validation_passed",
        "error_class",
    )


@query
def processed_per_day(spark, sf_dir):
    events = src.table(spark, sf_dir, "events", "ts")
    return reports.processed_per_day(events, "ts")


@query
def processed_per_day_stream(spark, sf_dir):
    events = _stream(spark, sf_dir, "events", "ts").withColumn("ts", F.to_timestamp("ts"))
    output, checkpoint = shared_folder(spark, "daily"), shared_folder(spark, "daily-state")
    ingest.daily_counts(events, output, checkpoint, "ts", "2 days").awaitTermination()
    return ingest.latest_daily_counts(spark, output)


SESSION_GAP = "8 hours"


@query
def processed_per_session(spark, sf_dir):
    events = src.table(spark, sf_dir, "events", "user_id", "ts")
    return reports.processed_per_session(events, "user_id", "ts", SESSION_GAP)


@query
def processed_per_session_stream(spark, sf_dir):
    """The sessions of ``events`` from a stream of four parts of the time, in four micro-batches.

    A last row far in the future closes what is open.
    """
    landing, output, checkpoint = (shared_folder(spark, f"sessions-{n}") for n in ("in", "out", "state"))
    events = src.table(spark, sf_dir, "events", "user_id", F.to_timestamp("ts").alias("ts"))
    bounds = events.agg(F.min("ts").cast("double").alias("low"), F.max("ts").cast("double").alias("high"))
    low, high = bounds.first()
    at = F.col("ts").cast("double")
    part = F.least(F.floor((at - low) / max(high - low, 1.0) * 4), F.lit(3))
    for k in range(4):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(landing)
    end = F.timestamp_seconds(F.lit(high + 365 * 86400))
    closing = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), end.alias("ts"))
    closing.coalesce(1).write.mode("append").parquet(landing)
    stream = ingest.stream_table(spark, landing, "user_id long, ts timestamp", max_files=1)
    ingest.session_counts(stream, output, checkpoint, "user_id", "ts", SESSION_GAP, "1 hour").awaitTermination()
    found = spark.read.parquet(output).select("user_id", "first", "until", "documents")
    return found.filter("user_id IS NOT NULL")


@query
def unprocessed_docs_stream(spark, sf_dir):
    """Documents whose result does not follow their upload within an hour, from two streams.

    A document is uploaded a second after the one before; its result takes some minutes, with
    some beyond the hour, and one in seven never comes. A last row on either side ends the time.
    """
    docs = src.table(spark, sf_dir, "documents", "doc_id")
    uploads = docs.select("doc_id", F.timestamp_seconds(F.col("doc_id") + 1704067200).alias("uploaded"))
    minutes = F.pmod(F.col("doc_id") * 37, F.lit(80))
    results = uploads.filter("doc_id % 7 != 0").select(
        "doc_id", F.timestamp_seconds(F.unix_timestamp("uploaded") + minutes * 60).alias("finished")
    )
    end = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.timestamp_seconds(F.lit(4102444800)).alias("t"))
    streams = []
    for name, rows in (("uploaded", uploads), ("finished", results)):
        landing = shared_folder(spark, f"{name}-in")
        for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
            rows.filter(part).coalesce(1).write.mode("append").parquet(landing)
        end.withColumnRenamed("t", name).coalesce(1).write.mode("append").parquet(landing)
        streams.append(ingest.stream_table(spark, landing, f"doc_id long, {name} timestamp", max_files=1))
    # files hold the whole range of times, so a row may be as late as that
    lost = ingest.unanswered(*streams, "doc_id", "uploaded", "finished", "1 HOUR", "10000 days")
    output, checkpoint = shared_folder(spark, "unanswered"), shared_folder(spark, "unanswered-state")
    ingest.append_table(lost, output, checkpoint).awaitTermination()
    return spark.read.parquet(output).filter("doc_id >= 0").select(
        "doc_id", F.col("uploaded").cast("timestamp_ntz").alias("uploaded")
    )


STATE_PARTITIONS = 8  # at least; a Python worker each, one number per document is held


@query
def corrected_uploads(spark, sf_dir):
    """Three runs over the documents: some come with their third version first, some with none older.

    The second run brings the versions that the first one left out, the third repeats some.
    """
    landing, output, checkpoint = (shared_folder(spark, f"corrections-{n}") for n in ("in", "out", "state"))
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    versions = docs.select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version"))
    # only the newest version has the whole text: an older one ends after its first line
    text = F.when(F.col("version") == 3, F.col("text")).otherwise(F.substring_index("text", "\n", 1))
    at = F.timestamp_seconds(F.col("doc_id") + F.col("version") * 3600 + 1704067200)
    uploads = versions.filter("version < 3 OR doc_id % 5 != 0").select(
        "doc_id", F.col("version").cast("long"), text.alias("text"), at.alias("uploaded")
    )
    first = "(doc_id % 3 = 0 AND version = 3) OR (doc_id % 3 = 1 AND version = 1) OR (doc_id % 3 = 2 AND version = 2)"
    partitions = max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    for part in (first, f"NOT ({first})", "doc_id % 2 = 0 AND version = 2"):
        uploads.filter(part).write.mode("append").parquet(landing)
        stream = ingest.stream_table(spark, landing, corrections.UPLOAD_SCHEMA)
        run = corrections.ingest_corrections(
            stream, output, checkpoint, "10 days", partitions=partitions
        )
        run.awaitTermination()
    current = corrections.current_records(spark.read.parquet(output))
    return current.select(
        "doc_id", "version", "receipt_number", "date", "total_amount", F.size("items").alias("n_items")
    )
