"""Corrected uploads over several runs against the batch answer."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from billwright.streaming import corrections, ingest

START = datetime(2024, 1, 1)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(spark, tmp_path, parts, late_by="100 days", keep_days=30):
    landing, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        rows = spark.createDataFrame(part, corrections.UPLOAD_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.stream_table(spark, landing, corrections.UPLOAD_SCHEMA)
        corrections.ingest_corrections(stream, output, state, late_by, keep_days).awaitTermination()
    return spark.read.parquet(output)


def test_three_runs_in_any_order_equal_the_batch(spark, tmp_path, one_partition):
    rng = random.Random(3)
    uploads = [
        (doc, version, f"Date: 0{version}/02/2024", START + timedelta(hours=rng.randrange(50)))
        for doc in range(12)
        for version in rng.sample(range(1, 9), rng.randint(1, 4))
    ]
    uploads += [uploads[0], (50, 1, None, START)]  # a repeated upload, a null text
    rng.shuffle(uploads)
    unsound = [(None, 1, "x", START), (1, None, "x", START), (1, 9, "x", None)]
    parts = [uploads[:12] + unsound, uploads[12:24], uploads[24:]]
    table = run(spark, tmp_path, parts)
    newest = {}
    for doc, version, text, _ in uploads:
        newest[doc] = max(newest.get(doc, (0, None)), (version, text))
    current = {r.doc_id: (r.version, r.raw_text) for r in corrections.current_records(table).collect()}
    assert current == newest
    rows = table.collect()
    assert len(rows) == len(uploads) and {r.error_class for r in rows if r.doc_id == 50} == {"null_text"}
    for doc in newest:  # an upload is accepted only if nothing as new came before
        seen = []
        for part in parts:
            own = sorted(u[1] for u in part if u[0] == doc and None not in (u[1], u[3]))
            for version in own:
                verdict = corrections.ACCEPTED if not seen or version > max(seen) else corrections.STALE
                seen.append(version)
                assert verdict in {r.verdict for r in rows if (r.doc_id, r.version) == (doc, version)}
    bad = corrections.unversioned(spark.createDataFrame(unsound, corrections.UPLOAD_SCHEMA))
    assert sorted(r.error_class for r in bad.collect()) == ["no_id", "no_time", "no_version"]


def test_old_documents_are_forgotten(spark, tmp_path, one_partition):
    late = START + timedelta(days=400)
    parts = [[(1, 5, "a", START)], [(2, 1, "b", late)], [(1, 4, "c", late)]]
    rows = run(spark, tmp_path, parts, "1 day", 30).filter(F.col("doc_id") == 1).collect()
    assert {(r.version, r.verdict) for r in rows} == {(5, "accepted"), (4, "accepted")}


def test_a_document_is_judged_by_rows_in_chunks(monkeypatch):
    """Keyed state takes rows as they come, without a table per document."""
    monkeypatch.setattr(corrections, "SORTED_ROWS", 3)
    calls = []

    class Handle:
        newest = None

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.newest

        def update(self, value):
            self.newest = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    judge = corrections.NewestVersion(1000)
    judge.init(Handle())

    def rows(*versions):
        return iter([Row(doc_id=1, version=v, text="t", micros=v * 1000) for v in versions])

    first = [(r.version, r.verdict) for r in judge.handleInputRows((1,), rows(2, 1, 2, 3), None)]
    assert first == [(1, "accepted"), (2, "accepted"), (2, "stale"), (3, "accepted")]
    again = [(r.version, r.verdict) for r in judge.handleInputRows((1,), rows(3, 9), None)]
    assert again == [(3, "stale"), (9, "accepted")] and judge.newest.get() == (9, 1009)
    assert calls == [("register", 1003), ("delete", 1003), ("register", 1009)]
