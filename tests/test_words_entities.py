"""OCR words and token predictions: literal cases and a sequential fold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from billwright.functions import entities as ent
from billwright.operators import entities as E
from billwright.operators import words as W
from billwright.sources.tables import TOKEN_SCHEMA, WORD_SCHEMA

NAMES = {0: "O", 1: "B-X", 2: "I-X", 3: "B-Y", 4: "I-Y"}
IDS = {n: i for i, n in NAMES.items()}


def words_df(spark, rows):
    return spark.createDataFrame(rows, WORD_SCHEMA)


def test_confidence_is_truncated_and_blank_text_dropped(spark):
    rows = [(1, i, t, c, 0, 0, 1, 1) for i, (t, c) in enumerate(
        [("a", 60.0), ("b", 60.9), ("c", 61.0), ("d", -1.0), (" \xa0", 99.0), ("", 99.0), ("e", 99.5)]
    )]
    out = W.filter_confident_words(words_df(spark, rows)).orderBy("word_idx").collect()
    assert [(r.text, r.word_idx) for r in out] == [("c", 0), ("e", 1)]


def test_rank_and_page_text_over_many_runs(spark):
    rng = random.Random(3)
    n = 3 * W.RUN_ROWS + 17
    rows = [(d, i, f"w{i}", rng.choice([30.0, 90.0]), 0, 0, 1, 1) for d in (1, 2) for i in range(n)]
    rows += [(3, W.RUN_ROWS * 9, "far", 90.0, 0, 0, 1, 1)]
    rng.shuffle(rows)
    kept = W.filter_confident_words(words_df(spark, rows))
    got = {(r.doc_id, r.row_no): r.word_idx for r in kept.collect()}
    pages = {r.doc_id: r for r in W.page_text(kept, with_words=True).collect()}
    for d in (1, 2, 3):
        mine = sorted(r[1] for r in rows if r[0] == d and r[3] > 60)
        assert [got[d, i] for i in mine] == list(range(len(mine)))
        texts = {r[1]: r[2] for r in rows if r[0] == d}
        assert pages[d].words == [texts[i] for i in mine]
        assert pages[d].raw_text == " ".join(pages[d].words)


def test_box_and_normalized_box(spark):
    words = W.word_boxes(words_df(spark, [(d, 0, "a", 99.0, 10, 0, 21, 5) for d in (1, 2, 3)]))
    sizes = spark.createDataFrame([(1, 300, 50), (2, 0, 50)], "doc_id long, width int, height int")
    out = {r.doc_id: r for r in W.normalize_boxes(words, sizes).collect()}
    assert tuple(out[1].box) == (10, 0, 31, 5)
    assert tuple(out[1].norm_box) == (33, 0, 103, 100) and out[1].error_class is None
    assert (out[2].norm_box, out[2].error_class) == (None, "zero_page_size")
    assert (out[3].norm_box, out[3].error_class) == (None, "no_page_size")


def test_best_variant(spark):
    rows = [(1, 0, "a", "x" * 10), (1, 1, "b", "x" * 12), (1, 2, "c", "y" * 12), (2, 4, "--psm 11", "x"), (2, 3, "--psm 6", "y")]
    df = spark.createDataFrame(rows, "doc_id long, config_rank int, config string, text string")
    best = {r.doc_id: r.config for r in W.best_ocr_variant(df).collect()}
    assert best == {1: "b", 2: "--psm 6"}
    two = W.best_ocr_variant(df, ["--psm 6", "--psm 11"]).collect()
    assert [r.doc_id for r in two] == [2]


@pytest.mark.parametrize(
    "text,expected",
    [("RM 1,234.56", 1234.56), ("Rs.5.00", None), ("-5.00", 5.0), ("1.234.56", None), ("abc", None), ("", None)],
)
def test_entity_total(spark, text, expected):
    assert spark.range(1).select(ent.entity_total(F.lit(text))).first()[0] == expected


def test_argmax_takes_first_maximum(spark):
    df = spark.createDataFrame([(1, [0.1, 0.9, 0.9]), (2, [3.0])], "doc_id long, logits array<float>")
    assert [r.label_id for r in E.logits_to_labels(df).orderBy("doc_id").collect()] == [1, 0]


def test_word_label_is_that_of_first_labelled_token(spark):
    rows = [(1, 0, None, 1), (1, 1, 0, 2), (1, 2, 0, 1), (1, 3, 1, -100), (1, 4, 1, 3), (1, 5, 2, -100),
            (1, 6, 3, 77), (1, 511, 4, 4), (1, 512, 5, 4)]
    df = spark.createDataFrame(rows, TOKEN_SCHEMA)
    out = {r.word_idx: (r.label, r.error_class) for r in E.word_labels(df, NAMES).collect()}
    assert out == {0: ("I-X", None), 1: ("B-Y", None), 3: (None, "unknown_label"), 4: ("I-Y", None)}
    lost = E.words_lost(df).first()
    assert (lost.words, lost.words_lost) == (6, 1)


def test_failed_pages_keep_their_reason(spark):
    words = words_df(spark, [(d, 0, "a", 99.0, 0, 0, 1, 1) for d in (1, 2, 3)])
    sizes = spark.createDataFrame([(1, 9, 9), (2, 0, 9), (3, 9, 9)], "doc_id long, width int, height int")
    tokens = spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, 1), (3, 1, 0, 9)], TOKEN_SCHEMA)
    kept, labels = W.filter_confident_words(words), E.word_labels(tokens, NAMES)
    boxed = W.word_boxes(kept)
    errors = E.page_errors(labels, kept, sizes)
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    out = E.entities_to_record(docs, E.merge_entities(labels, boxed), kept, errors)
    got = {r.doc_id: r.error_class for r in out.collect()}
    assert got == {1: None, 2: "zero_page_size", 3: "unknown_label"}


def sequential(labels):
    """One pass over the words of a page, keeping one entity per type."""
    kept, previous = {}, None
    for i, label in enumerate(labels):
        mark, kind = label[:1], label[2:]
        if mark == "B":
            kept[kind] = [i]
        elif mark == "I" and kind in kept:
            kept[kind] = kept[kind] + [i] if previous == kind else [i]
        previous = kind or None
    return kept


def run_merge(spark, pages):
    tokens, words = [], []
    for d, labels in enumerate(pages):
        for i, label in enumerate(labels):
            tokens.append((d, i + 1, i, IDS[label]))
            words.append((d, i, f"w{i}", 99.0, i, 2 * i, 1, 1))
    boxed = W.word_boxes(W.filter_confident_words(words_df(spark, words)))
    labelled = E.word_labels(spark.createDataFrame(tokens, TOKEN_SCHEMA), NAMES)
    merged = E.merge_entities(labelled, boxed)
    return labelled, boxed, merged


def test_merge_literal_and_random(spark):
    rng = random.Random(11)
    pages = [
        ["I-X", "I-X", "B-X", "I-X", "O", "I-X"],
        ["I-X", "I-X"],
        ["B-X", "I-X", "B-X"],
        ["B-X", "I-Y", "I-X"],
    ] + [rng.choices(list(IDS), k=rng.randint(1, 12)) for _ in range(1500)]
    got = {}
    for r in run_merge(spark, pages)[2].collect():
        got.setdefault(r.doc_id, {})[r.entity_type] = (r.text, r.bbox)
    for d, labels in enumerate(pages):
        want = {
            k: (" ".join(f"w{i}" for i in at), [[i, 2 * i, i + 1, 2 * i + 1] for i in at])
            for k, at in sequential(labels).items()
        }
        assert got.get(d, {}) == want, labels
    assert got[0]["X"][0] == "w5" and 1 not in got and got[2]["X"][0] == "w2"


def test_model_record_keeps_documents_without_entities(spark):
    names = {0: "O", 1: "B-COMPANY", 2: "I-COMPANY", 3: "B-TOTAL"}
    words = words_df(spark, [(1, 0, "Acme", 90.0, 0, 0, 1, 1), (1, 1, "Ltd", 90.0, 0, 0, 1, 1), (1, 2, "RM1,200.50", 90.0, 0, 0, 1, 1)])
    tokens = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 2), (1, 3, 2, 3)], TOKEN_SCHEMA)
    kept = W.filter_confident_words(words)
    merged = E.merge_entities(E.word_labels(tokens, names), W.word_boxes(kept))
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = {r.doc_id: r for r in E.entities_to_record(docs, merged, kept).collect()}
    assert (out[1].vendor, out[1].total_amount, out[1].raw_text) == ("Acme Ltd", 1200.5, "Acme Ltd RM1,200.50")
    assert out[1].raw_predictions["COMPANY"].text == "Acme Ltd"
    assert (out[2].vendor, out[2].raw_text, out[2].raw_ocr_words, out[2]["items"]) == (None, "", [], [])
    assert out[2].raw_predictions == {} and out[2].extraction_confidence is None
