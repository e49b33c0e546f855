"""Registered queries of the training-data operators: each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    lm_scoring,
    periodic_runs,
    quality_rules,
    secret_scan,
    token_counts,
    url_filter,
    warc,
    whitening,
)
from billwright.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_document(pages: DataFrame) -> DataFrame:
    """Add ``doc_id``: a page shows the document whose number ends its url's path."""
    number = F.regexp_extract("path", r"/(\d+)[^/]*/?$", 1)
    parsed = url_filter.with_host(pages).withColumn("doc_id", number.try_cast("long"))
    return parsed.drop("host", "path")


URL_RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


@query
def op1_url_filter(spark, sf_dir):
    """The label of the document that a page shows is its outcome: bad if of low quality or
    toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = with_document(pages).select("page_id", "doc_id")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    outcomes = shown.filter("doc_id is not null").join(labels, "doc_id").select("page_id", "bad")
    return url_filter.judged(pages, outcomes, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


@query
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_tokens")


@query
def op4_lm_scoring(spark, sf_dir):
    """Held out are the documents of remainder 2; those of remainder 3 teach the weights."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    part = F.when(remainder == 2, "held_out").when(remainder == 3, "apart").otherwise("learn")
    return lm_scoring.scored(table(spark, sf_dir, "documents"), part).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = quality_rules.judged(docs, columns=["doc_id"], labels=labels)
    return judged.select("doc_id", *quality_rules.BASE_COLUMNS, "base_failed", "kept")


@query
def op7_chat_format(spark, sf_dir):
    return chat_format.formatted(table(spark, sf_dir, "conversations"))


@query
def op8_html_extract(spark, sf_dir):
    """Pages are labelled by the document that they show. At most SAMPLE_PAGES ids are
    broadcast."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    sample = html_extract.sampled(with_document(pages).filter("doc_id is not null"))
    wanted = F.broadcast(sample.select("doc_id").distinct())
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article"))
    labelled = sample.join(texts.join(wanted, "doc_id"), "doc_id")
    weights = html_extract.learned_weights(labelled)
    return html_extract.extracted(pages, weights).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


@query
def op9_warc(spark, sf_dir):
    captures = warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0, payloads=False)
    return captures.select(
        "page_id",
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        "refers_to",
    )


RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op10_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id"])
    return byte_bpe.decoded(ids, RANKS).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_whitening(spark, sf_dir):
    """``deviation`` is null where it outgrows a long."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whitened(rows).withColumn("deviation", F.col("deviation").try_cast("long"))


def _of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


@query
def op12_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.with_secrets(docs, keep=["doc_id"]).select(
        "doc_id",
        _of_kind(1).alias("n_assign"),
        _of_kind(2).alias("n_access"),
        _of_kind(3).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document (by crc32 of its id) repeats from some word on.

    Of its n words, those from a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them,
    with g = crc32 // 10.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    words = F.when((crc % 10 == 0) & (bare != ""), F.split(bare, r"[\x20\x09-\x0D]+", -1))
    rows = docs.select("doc_id", "text", F.floor(crc / 10).cast("long").alias("g"), words.alias("w"))
    n = F.size("w")
    start = (F.col("g") % n).cast("int")
    rows = rows.withColumn("a", start).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i)))
    return rows.select(
        "doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(F.array_join(again, " ")).alias("text")
    )


@query
def op13_periodic_runs(spark, sf_dir):
    docs = planted_runs(table(spark, sf_dir, "documents"))
    line = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    best = F.col("strongest")
    return periodic_runs.with_runs(docs, keep=["doc_id"]).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
