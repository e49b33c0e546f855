"""OCR word tables: confident words, boxes, page text, OCR variants.

A page can hold any number of words. Ranks and texts of a page are therefore built
in two levels, over runs of ``RUN_ROWS`` consecutive OCR rows: each run is small and
can be placed on any task, and only one row per run is brought together per page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.functions import entities as ent
from billwright.functions.text import strip
from billwright.session import dealt

RUN_ROWS = 1024


def confident_words(words: DataFrame) -> DataFrame:
    """Words above the confidence limit that are not blank.

    The whole part of the confidence counts. Words without a usable confidence or text are
    no confident words; ``word_quarantine`` has them with the reason.
    """
    enough = F.col("conf") >= ent.CONFIDENCE_ABOVE + 1
    return words.filter(
        word_error(F.col("conf"), F.col("text")).isNull() & enough & (strip(F.col("text")) != "")
    )


def word_error(conf: Column, text: Column) -> Column:
    """Why an OCR row can't be judged; null when it can."""
    unbounded = F.isnan(conf) | (F.abs(conf) == float("inf"))
    return (
        F.when(conf.isNull(), "no_confidence")
        .when(unbounded, "bad_confidence")
        .when(text.isNull(), "no_text")
    )


def word_quarantine(words: DataFrame) -> DataFrame:
    """OCR rows that no rule can judge, with ``error_class``."""
    marked = words.withColumn("error_class", word_error(F.col("conf"), F.col("text")))
    return marked.filter(F.col("error_class").isNotNull())


def filter_confident_words(words: DataFrame, partitions: int | None = None) -> DataFrame:
    """Confident words with ``word_idx``, their rank on the page in OCR order.

    rank = words in earlier runs of the page + rank within the run. A window per
    page sees one count per run; a window per run sees at most ``RUN_ROWS`` words. Words are
    ranked before they meet the counts of their run, so that one sort serves both. A task
    sorts its share of the words: ``partitions`` keeps that share small in a large table.
    """
    kept = confident_words(words).withColumn(
        "ocr_run", F.floor(F.col("row_no") / RUN_ROWS)
    )
    counts = kept.groupBy("doc_id", "ocr_run").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy("doc_id")
        .orderBy("ocr_run")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "doc_id", "ocr_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("doc_id", "ocr_run").orderBy("row_no")
    ranked = dealt(kept, partitions, "doc_id", "ocr_run").withColumn(
        "_rank", F.row_number().over(within)
    )
    return (
        ranked.join(offsets, ["doc_id", "ocr_run"])
        .withColumn("word_idx", F.col("_offset") + F.col("_rank") - 1)
        .drop("_offset", "_rank")
    )


def word_boxes(words: DataFrame) -> DataFrame:
    return words.withColumn(
        "box", ent.box(F.col("left"), F.col("top"), F.col("width"), F.col("height"))
    )


def _with_page_size(df: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Adds the page size, and ``error_class`` when there is none to divide by."""
    sizes = page_sizes.select(
        "doc_id", F.col("width").alias("page_width"), F.col("height").alias("page_height")
    )
    width, height = F.col("page_width"), F.col("page_height")
    return df.join(sizes, "doc_id", "left").withColumn(
        "error_class",
        F.when(width.isNull() | height.isNull(), "no_page_size").when(
            (width == 0) | (height == 0), "zero_page_size"
        ),
    )


def normalize_boxes(boxed_words: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Boxes on the 0-1000 grid; ``error_class`` tells why a page or word has none.

    The page sizes, a row per page, are looked up by hash: no task sorts its words for it.
    """
    sized = _with_page_size(boxed_words, page_sizes.hint("shuffle_hash")).withColumn(
        "norm_box",
        ent.normalized_box(F.col("box"), F.col("page_width"), F.col("page_height")),
    )
    lost = F.col("norm_box").isNull() & F.col("error_class").isNull()
    return sized.withColumn(
        "error_class", F.when(lost, "box_out_of_range").otherwise(F.col("error_class"))
    )


def page_size_errors(kept_words: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Pages with words but no usable size. Words are reduced to pages before the join."""
    pages = kept_words.select("doc_id").distinct()
    return (
        _with_page_size(pages, page_sizes)
        .filter(F.col("error_class").isNotNull())
        .select("doc_id", "error_class")
    )


def page_text(
    kept_words: DataFrame, with_words: bool = False, partitions: int | None = None
) -> DataFrame:
    """Kept words of each page joined by blanks, in order (and as an array).

    ``partitions`` is the number of tasks that the pages are dealt out to.
    """
    in_order = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    runs = kept_words.groupBy("doc_id", "ocr_run").agg(
        F.transform(in_order, lambda w: w["text"]).alias("_words")
    )
    merged = F.array_sort(F.collect_list(F.struct("ocr_run", "_words")))
    pages = dealt(runs, partitions, "doc_id").groupBy("doc_id").agg(
        F.flatten(F.transform(merged, lambda r: r["_words"])).alias("words")
    )
    return pages.select(
        "doc_id",
        F.array_join("words", " ").alias("raw_text"),
        *(["words"] if with_words else []),
    )


def best_ocr_variant(
    variants: DataFrame, configs: Sequence[str] | None = None
) -> DataFrame:
    """Longest text of each page; the first setting wins ties.

    One aggregate with map-side combine: the variants of a page that lie together
    are reduced to one before the shuffle, and no page is gathered as a group.
    """
    if configs is not None:
        variants = variants.filter(F.col("config").isin(*configs))
    n_chars = F.length("text")
    rank = F.struct(n_chars, -F.col("config_rank"))
    row = F.struct("config_rank", "config", n_chars.alias("n_chars"), "text")
    best = variants.groupBy("doc_id").agg(F.max_by(row, rank).alias("best"))
    return best.select("doc_id", "best.*")


def ocr_variant_lengths(variants: DataFrame) -> DataFrame:
    """Text length per OCR setting over all pages."""
    n = F.length("text")
    return variants.groupBy("config_rank", "config").agg(
        F.count("*").alias("pages"),
        F.avg(n).alias("avg_chars"),
        F.max(n).alias("max_chars"),
    )
