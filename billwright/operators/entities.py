"""Token predictions to entities and records (the table side of the model path).

Token tables are cut to the model's token limit before anything is shuffled, so a
page brings at most ``TOKEN_LIMIT`` rows into any group, however many it has. One
exchange on the page id then serves the grouping and all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billwright.functions import entities as ent
from billwright.functions.text import strip
from billwright.operators.records import MODEL
from billwright.operators.words import page_size_errors, page_text
from billwright.session import dealt

RECORD_ENTITIES = {"COMPANY": "vendor", "ADDRESS": "address", "DATE": "date"}
TOTAL_ENTITY = "TOTAL"
_ITEMS = "array<struct<description:string,quantity:bigint,unit_price:double,total:double>>"


def truncate_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens the model sees; later ones get no label."""
    return tokens.filter(F.col("token_idx") < ent.TOKEN_LIMIT)


def words_lost(tokens: DataFrame, partitions: int | None = None) -> DataFrame:
    """Words per page that have no token within the limit.

    A task holds the words of its share of the tokens: ``partitions`` keeps that share small.
    """
    known = tokens.filter(F.col("word_idx").isNotNull())
    first = (
        dealt(known, partitions, "doc_id", "word_idx")
        .groupBy("doc_id", "word_idx")
        .agg(F.min("token_idx").alias("first_token"))
    )
    lost = F.col("first_token") >= ent.TOKEN_LIMIT
    return first.groupBy("doc_id").agg(
        F.count("*").alias("words"), F.count_if(lost).alias("words_lost")
    )


def logits_to_labels(tokens: DataFrame, logits: str = "logits") -> DataFrame:
    return tokens.withColumn("label_id", ent.argmax(F.col(logits)))


def word_labels(
    tokens: DataFrame, id2label: dict[int, str], partitions: int | None = None
) -> DataFrame:
    """Label of each word: that of its first labelled token.

    ``error_class`` marks ids outside the label set. ``partitions`` is the number of tasks
    that the pages are dealt out to.
    """
    seen = truncate_tokens(tokens).filter(
        F.col("word_idx").isNotNull() & (F.col("label_id") != ent.PADDING_LABEL)
    )
    seen = seen.select("doc_id", "word_idx", "token_idx", "label_id")
    pages = seen.repartition("doc_id") if partitions is None else dealt(seen, partitions, "doc_id")
    first = (
        pages.groupBy("doc_id", "word_idx")
        .agg(F.min_by("label_id", "token_idx").alias("label_id"))
    )
    label = ent.label_name(F.col("label_id"), id2label)
    return first.withColumn("label", label).withColumn(
        "error_class", F.when(F.col("label").isNull(), "unknown_label")
    )


def entity_words(labels: DataFrame) -> DataFrame:
    """Words of the entity that remains per page and type: the last segment.

    A segment starts at a B- word, or at an I- word not directly preceded by a word
    of its type; words before the first B- of the type belong to no entity.
    """
    page = Window.partitionBy("doc_id").orderBy("word_idx")
    kind = Window.partitionBy("doc_id", "entity_type")
    so_far = kind.orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0)
    continues = (F.col("_prev_idx") == F.col("word_idx") - 1) & (
        F.col("_prev_type") == F.col("entity_type")
    )
    begins = ent.is_begin(F.col("label"))
    return (
        labels.withColumn("entity_type", ent.entity_type(F.col("label")))
        .withColumns(
            {
                "_prev_idx": F.lag("word_idx").over(page),
                "_prev_type": F.lag("entity_type").over(page),
            }
        )
        .filter(F.col("entity_type").isNotNull())
        .withColumn("_open", F.max(begins).over(so_far))
        .filter("_open")
        .withColumn(
            "_start",
            F.when(begins | ~F.coalesce(continues, F.lit(False)), F.col("word_idx")),
        )
        .withColumn("_last", F.max("_start").over(kind))
        .filter(F.col("word_idx") >= F.col("_last"))
        .select("doc_id", "entity_type", "word_idx")
    )


def merge_entities(
    labels: DataFrame, boxed_words: DataFrame, partitions: int | None = None
) -> DataFrame:
    """Text and boxes of the remaining entity per page and type.

    A word has one token at least, so only the first ``TOKEN_LIMIT`` words of a page can
    have a label: the others are cut off before any shuffle. An entity is a run of words, so
    its labels come down to a first and last word; words look up the few entities of their
    page by hash, and only those within one are gathered. ``partitions`` is the number of
    tasks that the pages are dealt out to; labels dealt out so meet them where they are.
    """
    spans = (
        entity_words(labels)
        .groupBy("doc_id", "entity_type")
        .agg(F.min("word_idx").alias("_first"), F.max("word_idx").alias("_last"))
    )
    short = boxed_words.filter(F.col("word_idx") < ent.TOKEN_LIMIT).select(
        "doc_id", "word_idx", "text", "box"
    )
    own = spans.withColumnRenamed("doc_id", "_doc").hint("shuffle_hash")
    within = (F.col("doc_id") == F.col("_doc")) & F.col("word_idx").between(
        F.col("_first"), F.col("_last")
    )
    in_order = F.array_sort(F.collect_list(F.struct("word_idx", "text", "box")))
    parts = (
        dealt(short, partitions, "doc_id")
        .join(own, within)
        .groupBy("doc_id", "entity_type")
        .agg(in_order.alias("_words"))
    )
    return parts.select(
        "doc_id",
        "entity_type",
        strip(F.array_join(F.transform("_words", lambda w: w["text"]), " ")).alias("text"),
        F.transform(
            "_words",
            lambda w: F.array(w["box"]["x0"], w["box"]["y0"], w["box"]["x1"], w["box"]["y1"]),
        ).alias("bbox"),
    )


def page_errors(
    labels: DataFrame, kept_words: DataFrame, page_sizes: DataFrame
) -> DataFrame:
    """Pages the model path fails on: unknown labels, or no usable page size."""
    by_label = labels.filter(F.col("error_class").isNotNull()).select(
        "doc_id", "error_class"
    )
    return (
        by_label.unionByName(page_size_errors(kept_words, page_sizes))
        .groupBy("doc_id")
        .agg(F.min("error_class").alias("error_class"))
    )


def entities_to_record(
    documents: DataFrame,
    entities: DataFrame,
    kept_words: DataFrame,
    errors: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One model record per document, also for documents without any entity.

    ``errors`` (see :func:`page_errors`) gives failed documents their reason; they have no
    values besides their text and words. ``partitions`` is the number of tasks that the pages
    are dealt out to.
    """
    value = F.struct("text", "bbox")
    wide = entities.groupBy("doc_id").agg(
        *[
            F.max(F.when(F.col("entity_type") == kind, F.col("text"))).alias(name)
            for kind, name in RECORD_ENTITIES.items()
        ],
        F.max(F.when(F.col("entity_type") == TOTAL_ENTITY, F.col("text"))).alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("entity_type", value))).alias(
            "raw_predictions"
        ),
    )
    pages = page_text(kept_words, with_words=True, partitions=partitions)
    out = documents.join(pages, "doc_id", "left").join(wide, "doc_id", "left")
    if errors is None:
        out = out.withColumn("error_class", F.lit(None).cast("string"))
    else:
        out = out.join(dealt(errors, partitions, "doc_id"), "doc_id", "left")
    null = F.lit(None)
    good = F.col("error_class").isNull()
    return out.select(
        *documents.columns,
        F.lit(MODEL).alias("method"),
        null.cast("string").alias("receipt_number"),
        F.when(good, F.col("date")).alias("date"),
        null.cast("struct<name:string,email:string>").alias("bill_to"),
        F.array().cast(_ITEMS).alias("items"),
        F.when(good, ent.entity_total(F.col("_total"))).alias("total_amount"),
        F.when(good, F.col("vendor")).alias("vendor"),
        F.when(good, F.col("address")).alias("address"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("words", F.array().cast("array<string>")).alias("raw_ocr_words"),
        F.coalesce(
            F.when(good, F.col("raw_predictions")),
            F.create_map().cast(
                "map<string,struct<text:string,bbox:array<array<int>>>>"
            ),
        ).alias("raw_predictions"),
        null.cast("int").alias("extraction_confidence"),
        null.cast("boolean").alias("validation_passed"),
        "error_class",
    )


def complete_from_rules(model_records: DataFrame, rule_records: DataFrame) -> DataFrame:
    """Model records whose empty fields are filled by the rules of the same document."""
    names = ("receipt_number", "date", "bill_to", "total_amount")
    rules = rule_records.select(
        "doc_id",
        *[F.col(n).alias(f"_{n}") for n in names],
        F.col("items").alias("_items"),
        F.col("vendor_rules").alias("_vendor"),
    )
    joined = model_records.join(rules, "doc_id", "left")
    filled = {n: F.coalesce(n, f"_{n}") for n in names}
    filled["vendor"] = F.coalesce("vendor", "_vendor")
    filled["items"] = F.when(F.size("items") > 0, F.col("items")).otherwise(
        F.coalesce("_items", "items")
    )
    return joined.withColumns(filled).drop(*[c for c in rules.columns if c != "doc_id"])
