"""Scans, image listing, JSON output and streams on small files."""

from __future__ import annotations

import json
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billwright.operators import records as R
from billwright.operators import words as W
from billwright.sources import images, sinks, tables
from billwright.streaming import ingest


def png(width, height, rgb):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    rows = b"".join(b"\0" + bytes(rgb) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.png").write_bytes(png(3, 2, (255, 0, 0)))
    (tmp_path / "a.jpeg").write_bytes(b"not an image")
    (tmp_path / "c.jpg").write_bytes(png(1, 1, (0, 0, 0)))
    (tmp_path / "d.PNG").write_bytes(png(1, 1, (0, 0, 0)))
    (tmp_path / "e.txt").write_text("x")
    (tmp_path / "sub" / "f.png").write_bytes(png(1, 1, (0, 0, 0)))
    return str(tmp_path)


def test_image_manifest(spark, folder):
    rows = images.scan_image_manifest(spark, folder).orderBy("ext_rank", "path").collect()
    assert [(r.stem, r.ext) for r in rows] == [("c", "jpg"), ("b", "png"), ("a", "jpeg")]
    assert all(len(r.sha256) == 64 for r in rows)
    assert images.first_sample(images.scan_files(spark, folder), folder).first().stem == "a"


def test_first_sample_reads_one_file(spark, folder, tmp_path):
    row = images.scan_first_sample(spark, folder).first()
    assert (row.stem, row.length, len(row.sha256)) == ("a", 12, 64)
    scan = images.first_path(spark, folder)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string" in scan and "content:binary" not in scan.split("ReadSchema")[-1]
    (tmp_path / "sub2").mkdir()
    assert images.scan_first_sample(spark, str(tmp_path / "sub2")).count() == 0


def test_spellings_of_a_folder(spark, folder):
    start, _, last = folder.rpartition("/")
    for same in (folder + "/", f"{start}//{last}", f"{start}/./{last}", f"{start}/{last[:-1]}?", "file:" + folder, "file://" + folder):
        rows = images.scan_image_manifest(spark, same).collect()
        assert sorted(r.stem for r in rows) == ["a", "b", "c"], same


def test_image_check(spark, folder):
    out = {r.path.rsplit("/", 1)[-1]: r for r in images.scan_image_checked(spark, folder).collect()}
    assert (out["b.png"].width, out["b.png"].height, out["b.png"].error_class) == (3, 2, None)
    assert bytes(out["b.png"].data[:3]) == b"\x00\x00\xff"
    assert out["a.jpeg"].error_class == "bad_image"


def test_missing_folder_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        images.scan_image_manifest(spark, str(tmp_path / "none")).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_scan_text(spark, texts, tmp_path, fmt):
    texts(["a\nb", "é"]).withColumn("other", F.lit(1)).write.format(fmt).save(str(tmp_path / "t"))
    rows = tables.scan_text(spark, str(tmp_path / "t"), fmt).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a\nb"), (1, "é")]


def test_scan_text_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n\nb\n")
    row = tables.scan_text(spark, str(tmp_path), "text").first()
    assert row.doc_id.endswith("x.txt") and row.text == "a\n\nb\n"
    with pytest.raises(ValueError):
        tables.scan_text(spark, str(tmp_path), "xml")


def test_scan_ocr_words_keeps_bad_rows(spark, tmp_path):
    head = "doc_id\trow_no\ttext\tconf\tleft\ttop\twidth\theight\n"
    (tmp_path / "w.tsv").write_text(head + '1\t0\t"a\t96.5\t1\t2\t3\t4\n1\tx\tb\t9\t1\t2\t3\t4\n')
    rows = tables.scan_ocr_words(spark, str(tmp_path), "tsv").collect()
    good = [r for r in rows if r[tables.CORRUPT] is None]
    assert [(r.text, r.conf, r.height) for r in good] == [('"a', 96.5, 4)]
    bad = [r for r in rows if r not in good]
    assert [r[tables.CORRUPT] for r in bad] == ["1\tx\tb\t9\t1\t2\t3\t4"]
    assert (bad[0].row_no, bad[0].text, bad[0].conf) == (None, "b", 9.0)


def test_ocr_words_are_read_by_name(spark, tmp_path):
    head = "level\trow_no\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "page-31.tsv").write_text(head + "5\t0\t1\t2\t3\t4\t95\t42\n")
    row = tables.scan_ocr_words(spark, str(tmp_path), "tsv").first()
    assert (row.doc_id, row.row_no, row.text, row.conf, row.height, row[tables.CORRUPT]) == (31, 0, "42", 95.0, 4, None)
    (tmp_path / "page-31.tsv").write_text("row_no\ttext\n1\tx\n")
    with pytest.raises(ValueError, match="header lacks"):
        tables.scan_ocr_words(spark, str(tmp_path), "tsv")


def test_unusable_words_have_a_reason(spark):
    rows = [(1, 0, "a", None, 1), (1, 1, "b", float("nan"), 1), (1, 2, "c", 1e300, 1), (1, 3, None, 99.0, 1), (1, 4, "d", 60.9, 1),
            (1, 5, "e", 61.0, 2**31 - 1), (1, 6, "f", float("inf"), 1)]
    words = spark.createDataFrame(rows, "doc_id long, row_no int, text string, conf double, left int").selectExpr(
        "*", "1 AS top", "5 AS width", "6 AS height"
    )
    kept = W.filter_confident_words(words)
    assert sorted(r.text for r in kept.collect()) == ["c", "e"]
    reasons = {r.row_no: r.error_class for r in W.word_quarantine(words).collect()}
    assert reasons == {0: "no_confidence", 1: "bad_confidence", 3: "no_text", 6: "bad_confidence"}
    sizes = spark.createDataFrame([(1, 1, 1)], "doc_id long, width int, height int")
    boxes = {r.text: r for r in W.normalize_boxes(W.word_boxes(kept), sizes).collect()}
    assert boxes["c"].error_class is None and tuple(boxes["c"].norm_box) == (1000, 1000, 6000, 7000)
    assert (boxes["e"].norm_box, boxes["e"].error_class) == (None, "box_out_of_range")


def test_user_step(spark, texts):
    def step(batches):
        for pdf in batches:
            words = pdf.assign(text=pdf.text.str.split()).explode("text")
            yield words.assign(
                row_no=words.groupby("doc_id").cumcount(), conf=99.0, left=0, top=0, width=1, height=1
            )[["doc_id", "row_no", "text", "conf", "left", "top", "width", "height"]]

    out = tables.with_engine(texts(["a b", "c"]), step, tables.WORD_SCHEMA)
    assert sorted((r.doc_id, r.row_no, r.text) for r in out.collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    with pytest.raises(ValueError):
        tables.with_engine(texts(["a"]), step, "x int")


def test_json_output(spark, texts, tmp_path):
    records = R.structure_records(texts(["Café GmbH\nItem\n2 Pen 1.00\nTotal 1.00", ""]))
    path = sinks.sink_export_named(records, str(tmp_path), datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("/invoice_data_20240506_070809.json")
    lines = [r.value for r in spark.read.text(f"{path}/method=rules").collect()]
    out = {json.loads(line)["raw_text"]: json.loads(line) for line in lines}
    first = out["Café GmbH\nItem\n2 Pen 1.00\nTotal 1.00"]
    assert list(first) == ["doc_id", "output_name", *R.RULE_FIELDS]
    assert (first["doc_id"], first["output_name"]) == (0, "0_rules.json")
    assert first["bill_to"] is None and first["total_amount"] == 1.0
    assert first["items"] == [{"description": "Pen", "quantity": 2, "unit_price": 2.0, "total": 1.0}]
    assert any("Café" in line for line in lines)


def test_output_names(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "stem string").withColumn("method", F.lit("ml"))
    out = sinks.shared_names(sinks.with_output_name(df, "stem")).collect()
    assert [(r.output_name, r.records) for r in out] == [("a_ml.json", 2)]


def test_records_of_no_method_are_rejected(spark, texts, tmp_path):
    records = R.structure_records(texts(["a", "b"])).withColumn("method", F.expr("IF(doc_id = 1, 'auto', method)"))
    shared = sinks.sink_json(records, str(tmp_path / "out"))
    assert shared.count() == 0
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/method=rejected")).collect()]
    assert lines == [{"doc_id": 1, "output_name": "1_auto.json"}]


def test_stream_equals_batch(spark, texts, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    values = ["Bill To: Jane\n01/02/2019", "Item\nPen 1.00\nTotal 1.00", None, "Acme Ltd"]
    texts(values[:2]).write.parquet(landing)
    stream = lambda: ingest.stream_table(spark, landing, "doc_id long, text string")
    ingest.incremental_ingest(stream(), out, state).awaitTermination()
    late = spark.createDataFrame(list(enumerate(values))[2:], "doc_id long, text string")
    late.write.mode("append").parquet(landing)
    ingest.incremental_ingest(stream(), out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch_id").distinct().count() == 2
    batch = R.structure_records(texts(values))
    assert sorted(map(str, got.drop("batch_id").collect())) == sorted(map(str, batch.collect()))


def test_repeated_uploads_count_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    t = datetime(2024, 1, 1, 12)
    rows = [(1, "a", t), (1, "a", t), (2, "b", t)]
    schema = "doc_id long, text string, ingest_ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(landing)
    docs = ingest.drop_repeats(ingest.stream_table(spark, landing, schema), ["doc_id"], "ingest_ts", "1 hour")
    ingest.incremental_ingest(docs, out, state).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_daily_counts_over_two_runs(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, ingest_ts timestamp"
    days = [(1, datetime(2024, 1, 1, 1)), (2, datetime(2024, 1, 1, 23)), (3, datetime(2024, 1, 2, 1))]
    for part in (days[:1], days[1:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(landing)
        stream = ingest.stream_table(spark, landing, schema)
        ingest.daily_counts(stream, out, state, "ingest_ts", "2 days").awaitTermination()
    got = {str(r.day): r.documents for r in ingest.latest_daily_counts(spark, out).collect()}
    assert got == {"2024-01-01 00:00:00": 2, "2024-01-02 00:00:00": 1}


def test_late_rows_are_counted(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id long, ingest_ts timestamp"
    days = [(1, datetime(2024, 1, 9, 1)), (2, datetime(2024, 1, 10, 1)), (3, datetime(2024, 1, 2, 1))]
    late = []
    for part in (days[:2], days[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = ingest.stream_table(spark, landing, schema)
        query = ingest.daily_counts(stream, out, state, "ingest_ts", "2 days")
        query.awaitTermination()
        late.append(ingest.late_rows(query))
    got = {str(r.day)[:10]: r.documents for r in ingest.latest_daily_counts(spark, out).collect()}
    assert got == {"2024-01-09": 1, "2024-01-10": 1}
    assert late == [0, 1]
