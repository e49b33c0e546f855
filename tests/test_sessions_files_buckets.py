"""Session counts, late rows, unanswered uploads, record files and bucketed joins."""

from __future__ import annotations

import json
import os
import time
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from billwright.operators import reports
from billwright.session import bucketed
from billwright.sources import record_files
from billwright.streaming import ingest

START = datetime(2024, 1, 1)


def landed(spark, folder, rows, schema):
    """A file, then a pause: files are taken in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


# ---- Reports ---------------------------------------------------------------------------
def test_rollup_tells_subtotals_from_null_values(spark):
    rows = [("High", True, None, 80, 1.0), ("High", True, "A", 100, None), ("High", False, "A", 80, 2.0), (None, True, "A", None, None)]
    rated = spark.createDataFrame(
        rows, "confidence_tier string, validation_status boolean, name string, extraction_confidence int, total_amount double"
    ).withColumn("format", F.struct("name"))
    found = {(r.confidence_tier, r.validation_status, r.format_name, r.level): r for r in reports.quality_rollup(rated).collect()}
    assert found["High", True, None, 0].documents == 1  # a record without a format
    assert found["High", True, None, 1].documents == 2  # the sum over formats
    assert (found["High", None, None, 3].documents, found["High", None, None, 3].avg_confidence) == (3, 260 / 3)
    assert found[None, None, None, 3].documents == 1  # records without a tier
    assert (found[None, None, None, 7].documents, found[None, None, None, 7].without_total) == (4, 2)
    assert len(found) == 4 + 3 + 2 + 1


# ---- Sessions ---------------------------------------------------------------------------
def sessions_of(rows, gap):
    out = []
    for user in {u for u, _ in rows}:
        times = sorted(t for u, t in rows if u == user and t is not None)
        for t in times:
            if out and out[-1][0] == user and t <= out[-1][2]:
                out[-1][2:] = [t + gap, out[-1][3] + 1]
            else:
                out.append([user, t, t + gap, 1])
    return sorted(map(tuple, out), key=repr)


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    parts = [
        [(1, at(0)), (1, at(50)), (2, at(10)), (None, at(3)), (1, None)],
        [(1, at(25)), (2, at(40)), (2, at(69))],  # joins both sessions of user 1
        [(1, at(200)), (1, at(200)), (2, at(100)), (2, at(129))],
    ]
    gap = timedelta(minutes=30)
    schema = "user_id long, ts timestamp"
    rows = [r for part in parts for r in part]
    batch = reports.processed_per_session(spark.createDataFrame(rows, schema), "user_id", "ts")
    want = sessions_of(rows, gap)
    assert sorted((tuple(r) for r in batch.collect()), key=repr) == want
    folder = str(tmp_path / "in")
    for part in [*parts, [(99, at(100_000))]]:
        landed(spark, folder, part, schema)
    stream = ingest.stream_table(spark, folder, schema, max_files=1)
    output = str(tmp_path / "out")
    ingest.session_counts(stream, output, str(tmp_path / "state"), "user_id", "ts", "30 minutes", "3 hours").awaitTermination()
    got = spark.read.parquet(output).filter("user_id IS NULL OR user_id != 99")
    assert sorted((tuple(r)[:4] for r in got.select("user_id", "first", "until", "documents").collect()), key=repr) == want
    assert batch.limit(0).count() == 0


def test_late_rows_are_counted_beyond_the_remembered_micro_batches(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "doc_id long, ts timestamp"
    first = START + timedelta(days=100)
    landed(spark, folder, [(0, first)], schema)
    for k in range(1, 16):  # one row in time, one a hundred days late
        landed(spark, folder, [(k, first + timedelta(hours=k)), (-k, START)], schema)
    listener = ingest.LateRows()
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "5")  # 100 by default
    spark.streams.addListener(listener)
    try:
        stream = ingest.stream_table(spark, folder, schema, max_files=1)
        days = reports.processed_per_day(stream.withWatermark("ts", "1 day"), "ts")
        sink = days.writeStream.outputMode("update").format("noop").trigger(availableNow=True)
        query = sink.option("checkpointLocation", str(tmp_path / "state")).start()
        query.awaitTermination()
        for _ in range(100):  # the listener hears of the last batch a moment later
            if listener.of(query) >= 14:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len(query.recentProgress) <= 5
    # the first late row comes before any watermark does
    assert listener.of(query) in (14, 15)
    assert ingest.late_rows(query) < listener.of(query)


def test_unanswered_uploads(spark, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    uploads = [[(1, at(0)), (2, at(1)), (None, at(2))], [(3, at(30)), (4, at(31)), (4, at(31))], [(9, at(100_000))]]
    results = [[(1, at(10))], [(2, at(70)), (3, at(90)), (5, at(5))], [(9, at(100_000))]]
    streams = []
    for name, parts in (("uploaded", uploads), ("finished", results)):
        for part in parts:
            landed(spark, str(tmp_path / name), part, f"doc_id long, {name} timestamp")
        streams.append(ingest.stream_table(spark, str(tmp_path / name), f"doc_id long, {name} timestamp", max_files=1))
    lost = ingest.unanswered(*streams, "doc_id", "uploaded", "finished", "1 HOUR", "2 hours")
    ingest.append_table(lost, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id or 0) for r in rows if r.doc_id != 9) == [0, 2, 4, 4]


# ---- Record files --------------------------------------------------------------------------
RECORDS = (
    "doc_id long, stem string, method string, receipt_number string, date string, "
    "bill_to struct<name:string,email:string>, total_amount double"
)


def files_under(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs)


def test_record_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [
        (1, "a", "rules", "Nº-1", None, ("Zoë ☕", None), 193.0),
        (2, "a", "rules", "X", "01/02/2024", None, None),
        (3, "a", "ml", None, None, None, 1e-7),
        (4, "_x/y", "rules", None, None, None, None),
        (5, "b", "auto", "no method", None, None, None),
        (6, None, "rules", None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, RECORDS).coalesce(1)
    record_files.sink_json_files(frame, folder, "stem")
    names = [os.path.basename(f) for f in files_under(folder)]
    assert sorted(names) == sorted(["a_rules.json", "a_rules~2.json", "a_ml.json", "~_x_y_rules.json", "b_auto.json", "~"])
    found = {os.path.basename(f): open(os.path.join(folder, f), encoding="utf-8").read() for f in files_under(folder)}
    assert found["a_rules.json"].startswith('{\n  "doc_id": 1,\n  "receipt_number": "Nº-1",\n  "date": null,\n  "bill_to": {\n    "name": "Zoë ☕"')
    assert json.loads(found["b_auto.json"]) == {"doc_id": 5} and '"total_amount": 193.0' in found["a_rules.json"]
    # a second job adds its own files, an overwriting one replaces all
    record_files.sink_json_files(frame.limit(1), folder, "stem")
    assert len(files_under(folder)) == 7
    record_files.sink_json_files(frame.limit(2), folder, "stem", mode="overwrite")
    assert len(files_under(folder)) == 2
    read = record_files.read_json_files(spark, folder).collect()
    assert sorted((r.file, json.loads(r.value)["doc_id"]) for r in read) == [("a_rules.json", 1), ("a_rules~2.json", 2)]
    record_files.sink_json_files(frame.limit(0), str(tmp_path / "none"), "stem")
    assert files_under(str(tmp_path / "none")) == []


def test_retried_and_aborted_tasks_leave_no_files(tmp_path):
    folder = str(tmp_path / "out")
    rows = pa.RecordBatch.from_pydict({"output_name": ["a.json", "b.json"], "value": ['{"k":1}', '{"k":2}']})
    broken = pa.RecordBatch.from_pydict({"output_name": ["c.json"], "value": ["not json"]})
    writer = record_files.RecordFilesWriter(folder, overwrite=False)
    lost = record_files.RecordFilesWriter(folder, overwrite=False)
    lost.job, lost.staging = writer.job, writer.staging.rstrip("/")
    try:  # a first attempt dies half way
        writer.staging += "/first"
        writer.write(iter([rows, broken]))
    except json.JSONDecodeError:
        pass
    finally:
        writer.staging = lost.staging
    assert files_under(folder)
    message = writer.write(iter([rows]))
    assert message.files == 2
    writer.commit([message, None, record_files.WrittenFolder(None, 0, "part-x")])
    assert [os.path.basename(f) for f in files_under(folder)] == ["a.json", "b.json"]
    other = record_files.RecordFilesWriter(folder, overwrite=True)
    other.abort([other.write(iter([rows]))])
    assert len(files_under(folder)) == 2 and os.listdir(folder) == [message.place]


# ---- Expected records ------------------------------------------------------------------------
def test_expected_records_are_joined_where_they_lie(spark):
    expected = spark.createDataFrame([(k, f"n{k}", None if k == 3 else k * 1.0) for k in range(8)], "k long, name string, total double")
    actual = spark.createDataFrame([(k, f"n{k}", 1.0) for k in range(2, 10)] + [(None, "x", 1.0)], "k long, name string, total double")
    tables = [bucketed(t, f"Test {n}", "k", 4) for n, t in (("e", expected), ("a", actual))]
    out = reports.expected_accuracy(*tables, "k", ("name", "total"))
    rows = {r.field: r for r in out.collect()}
    name, total = rows["name"], rows["total"]
    assert (name.records, name.missing_records, name.unexpected_records) == (6, 2, 3)
    assert (name.tp, name.fp, name.fn) == (6, 3, 2)
    assert (total.tp, total.fp, total.fn) == (0, 9, 7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one, two = tables
        joined = one.join(two, one["k"] == two["k"], "full")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    empty = bucketed(expected.limit(0), "empty", "k", 4)
    assert reports.expected_accuracy(empty, tables[1], "k", ("name",)).first().unexpected_records == 9
