"""Words of large tables are dealt out by their number, so that each task sorts and holds a bounded share."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from billwright.operators import entities as E
from billwright.operators import words as W
from billwright.plans import corpus, queries
from billwright.session import bucketed, tasks_for
from billwright.sources.tables import WORD_SCHEMA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words_df(spark, pages=40, n=2 * W.RUN_ROWS + 9):
    rng = random.Random(7)
    rows = [(d, i, f"w{i}", rng.choice([30.0, 90.0]), 0, 0, 1, 1) for d in range(pages) for i in range(0, n, 9)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, WORD_SCHEMA)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_tasks_follow_the_size(texts):
    assert tasks_for(texts([]), F.length("text"), 10) == 1
    assert tasks_for(texts([None]), F.length("text"), 10) == 1
    assert tasks_for(texts(["a" * 25, "b" * 26, None]), F.length("text"), 10) == 6


def test_words_are_dealt_out_and_sorted_once(spark):
    words = words_df(spark)
    kept = W.filter_confident_words(words, 5)
    assert rows_of(kept) == rows_of(W.filter_confident_words(words))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(W.filter_confident_words(words, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # words: one sort before their window, none before the join; the counts have the two others
    assert "SortMergeJoin" in p and p.count("+- Sort [") + p.count(":- Sort [") == 3
    assert "REPARTITION_BY_NUM" in p
    assert kept.groupBy(F.spark_partition_id()).count().count() > 1


def test_lost_words_and_labels_are_dealt_out(spark):
    tokens = corpus.token_predictions(W.filter_confident_words(words_df(spark)))
    for step in (E.words_lost, lambda t, n=None: E.word_labels(t, corpus.LABELS, n)):
        assert rows_of(step(tokens, 6)) == rows_of(step(tokens))
        assert ", 6), REPARTITION_BY_NUM" in plan(step(tokens, 6))


def test_page_sizes_are_looked_up_without_a_sort(spark):
    boxed = W.word_boxes(W.confident_words(words_df(spark, 3)))
    sizes = spark.createDataFrame([(0, 480, 100), (1, 0, 100)], "doc_id long, width int, height int")
    out = W.normalize_boxes(boxed, sizes)
    assert "ShuffledHashJoin" in plan(out) and "Sort [" not in plan(out)
    found = {(r.doc_id, r.error_class) for r in out.select("doc_id", "error_class").distinct().collect()}
    assert found == {(0, None), (1, "zero_page_size"), (2, "no_page_size")}


def test_stored_runs_and_labels_are_read_where_they_lie(spark):
    docs = spark.createDataFrame(
        [(d, " ".join(f"w{i}" for i in range(40 * d))) for d in range(60)] + [(90, None)], "doc_id long, text string"
    )
    kept = queries._stored_words(docs, 4)
    runs = plan(kept.groupBy("doc_id", "ocr_run").count())
    assert "Exchange" not in runs and "out of 4" in runs
    assert "conf" not in kept.columns
    labels = bucketed(queries._labels_of(kept, 4), "labels", "doc_id", 4, is_dealt=True)
    whole = W.filter_confident_words(corpus.ocr_words(docs))
    old = E.word_labels(corpus.token_predictions(whole), corpus.LABELS)
    assert rows_of(labels) == rows_of(old)
    merged, plain = E.merge_entities(labels, W.word_boxes(kept), 4), E.merge_entities(old, W.word_boxes(whole))
    assert rows_of(merged) == rows_of(plain)
    record = E.entities_to_record(docs.select("doc_id"), merged, kept, None, 4).drop("raw_predictions")
    by_old = E.entities_to_record(docs.select("doc_id"), plain, whole).drop("raw_predictions")
    assert rows_of(record) == rows_of(by_old)
    errors = E.page_errors(labels, kept, corpus.page_sizes(docs))
    p = plan(E.entities_to_record(docs.select("doc_id"), merged, kept, errors, 4))
    # pages that lie together stay there: only rows of errors and sizes go elsewhere
    assert not [part for part in p.split("Exchange")[1:] if "SortMergeJoin" in part[:120]]
