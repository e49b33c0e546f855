"""The plans: what is read, what is shuffled, and that long texts stay cheap."""

from __future__ import annotations

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from billwright.operators import records as R
from billwright.plans.queries import QUERIES
from billwright.session import spread, work_root

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_has_no_shuffle_and_no_python(texts, tmp_path, spark):
    texts(["a"]).write.parquet(str(tmp_path / "t"))
    p = plan(R.structure_records(spark.read.parquet(str(tmp_path / "t"))))
    assert "Exchange" not in p and "Python" not in p


def test_only_needed_columns_are_read(spark):
    p = plan(QUERIES["field_accuracy"](spark, SF))
    assert "o_orderstatus" not in p
    p = plan(QUERIES["extract_total"](spark, SF))
    assert "n_chars" not in p


def test_conditions_on_keys_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = plan(R.structure_records(docs, only=F.col("doc_id") == 5).filter("total_amount > 1"))
    assert "EqualTo(doc_id,5)" in p and p.count("BALANCE") == 1


def test_only_labelled_words_of_a_page_are_shuffled(spark):
    p = plan(QUERIES["merge_entities"](spark, SF))
    assert "word_idx" in p and "LessThan(word_idx,512)" in p


def test_filters_do_not_repeat_the_extraction(texts):
    p = plan(R.structure_records(texts(["a"])).filter("total_amount > 1 AND bill_to.email IS NOT NULL"))
    assert p.count("billed to|billing name") == 1
    assert p.count("BALANCE") == 1


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"scan_ocr_words", "sink_json", "sink_export_named", "incremental_ingest", "ingest_without_repeats", "processed_per_day_stream"}))
def test_no_query_uses_python_or_cross_joins(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "Python" not in p and "Cartesian" not in p and "BroadcastNestedLoop" not in p


LONG = 200_000
LONG_TEXTS = {
    "letters": "a" * LONG,
    "blanks": " " * LONG + "x",
    "newlines": "\n" * LONG,
    "grouped": "1" + ",234" * (LONG // 4),
    "items": "item\n" + "Pen 5.00\n" * (LONG // 9),
    "no digits": "item\n" + "abc def " * (LONG // 8),
    "label": "total" + " " * LONG + "x",
    "mail": "bill to: " + "a." * (LONG // 2) + "@",
    "code": "no 1 " + "ab-" * (LONG // 3),
    "headings": "customer\n" * (LONG // 9),
}


def test_long_texts_are_linear(texts):
    start = time.time()
    rows = R.structure_records(texts(LONG_TEXTS.values())).collect()
    assert time.time() - start < 60
    assert max(len(r["items"]) for r in rows) == LONG // 9


def test_inputs_keep_their_partitions_unless_told(spark):
    one = spark.range(10).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 1
    assert spread(one, 5).rdd.getNumPartitions() == 5


def session_stub(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_follows_the_session():
    named = session_stub("yarn", spark_checkpoint_dir="/shared/work/")
    assert work_root(named) == "/shared/work"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_root(session_stub(master))
