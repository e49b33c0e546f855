"""Corpus pipeline: quality rules, near duplicates, decontamination, tokenizing.

Each stage works on all that the one before it kept; its result is stored and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.llm import byte_bpe, decontaminate, jaccard_join, quality_rules
from billwright.session import shared_folder, ship_package, stored

#: Ids and text hashes of kept documents are broadcast up to so many rows of 16 bytes (counted
#: first); beyond it they meet the documents in a shuffle.
BROADCAST_ROWS = 400_000
#: Near duplicates share at least 0.8 of their 5-word shingles.
NEAR = jaccard_join.Measure(ngram=5, numerator=4, denominator=5)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.judged(docs, labels=labels).filter("kept").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Of texts that share the smallest id, or of a group without ids, the one of the smallest
    hash stays. Rows that repeat an id and a text count as one document; texts without words
    are in no group.
    """
    ship_package(spark)
    linked = jaccard_join.linked_rows(docs, measure=NEAR)
    own = linked.groupBy("doc_id", "mark", "root").agg(F.count("*").alias("rows"))
    alone = F.when(F.col("root").isNull(), F.struct("doc_id", "mark"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "rows")
    first = own.groupBy("root", alone.alias("alone")).agg(F.min(order).alias("first"))
    first = stored(
        first.select(
            F.col("first.doc_id").alias("__first"),
            F.col("first.mark").alias("__mark"),
            F.col("first.rows").alias("__rows"),
        ),
        "first-documents",
    )
    size = first.agg(F.count("*").alias("n"), F.max("__rows").alias("most")).first()
    chosen = first.drop("__rows")
    if size["n"] <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    same = docs["doc_id"].eqNullSafe(F.col("__first")) & (F.xxhash64(docs["text"]) == F.col("__mark"))
    kept = docs.join(chosen, same, "left_semi")
    if (size["most"] or 0) > 1:  # some row repeats an id and a text
        kept = kept.withColumn("__text", F.xxhash64("text"))
        kept = kept.dropDuplicates(["doc_id", "__text"]).drop("__text")
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.contamination(docs, tests, keep=docs.columns)
    return judged.filter("NOT contaminated").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text.

    The ids are stored before they are decoded: in one stage, every core would keep a Python
    worker for each of the two steps, with the tables of both.
    """
    ship_package(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    kept = [c for c in docs.columns if c != "text"]
    source = docs.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    ids = byte_bpe.encoded(source, ranks, public_tokenizers.PATTERN, keep=[*kept, "__sha"])
    ids = stored(ids, "token-ids")
    same = F.sha2("decoded", 256) == F.col("__sha")
    return byte_bpe.decoded(ids, ranks).select(
        *kept, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: Quantile sketches and byte-pair merges have no SQL form: tests/llm checks each stage by
#: brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's result is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
