"""Calendar dates, exact quantiles, template formats and image headers on worked-out cases."""

from __future__ import annotations

import math
import random
import struct
import zlib
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from billwright.functions.marks import longest_mark_pattern
from billwright.operators import dates, formats, records, statistics
from billwright.sources import images


# ---- Dates -----------------------------------------------------------------------------
def parsed(spark, rows):
    frame = spark.createDataFrame(
        [(k, *r, "clash") for k, r in enumerate(rows)],
        "doc_id long, corpus string, source string, text string, date_parsed string",
    ).drop("date_parsed")
    out = dates.with_parsed_dates(records.with_dates(frame), ["doc_id"])
    return [(r.date_parsed, r.date_order, r.decided_by, r.date_problem) for r in out.orderBy("doc_id").collect()]


def test_dates_follow_the_votes_of_their_source_then_of_their_corpus(spark):
    rows = [
        ("a", "eu", "on 25/12/2023 and 13-01-2024"),
        ("a", "eu", "on 03/04/2024"),
        ("a", "us", "on 12/25/2023"),
        ("a", "us", "on 03/04/2024"),
        ("a", "tie", "25/12/2023 12/25/2023"),
        ("a", "tie", "03/04/24"),
        ("a", None, "04-03-99 x"),  # no votes of its own: the corpus has 4 to 2 for the day
        ("c", "x", "05/06/2024"),  # nobody votes
        ("a", "odd", "31/02/2024 and"),
        ("a", "us", "2024-02-30"),
        ("a", "us", "2024-02-29"),
        ("a", "us", "07/07/2024"),
        ("a", "us", "45/67/2024"),
        ("a", "us", "00/01/2024"),
        ("a", "us", "0000-01-01"),
        ("a", "us", "no date"),
        ("a", "us", None),
        ("a", "us", ""),
        ("b", "y", "٢٥/١٢/٢٠٢٣"),
    ]
    want = [
        (date(2023, 12, 25), "day_first", "date", None),
        (date(2024, 4, 3), "day_first", "source", None),
        (date(2023, 12, 25), "month_first", "date", None),
        (date(2024, 3, 4), "month_first", "source", None),
        (date(2023, 12, 25), "day_first", "date", None),
        (date(2024, 4, 3), "day_first", "corpus", None),
        (date(1999, 3, 4), "day_first", "corpus", None),
        (None, None, None, "undecided_order"),
        (None, "day_first", "date", "impossible_date"),
        (None, "year_first", "date", "impossible_date"),
        (date(2024, 2, 29), "year_first", "date", None),
        (date(2024, 7, 7), "day_first", "date", None),
        (None, None, None, "impossible_date"),
        (None, None, None, "impossible_date"),
        (None, "year_first", "date", "impossible_date"),
        (None, None, None, None),
        (None, None, None, None),
        (None, None, None, None),
        (date(2023, 12, 25), "day_first", "date", None),
    ]
    assert parsed(spark, rows) == want
    assert parsed(spark, rows[:0]) == []


# ---- Quantiles ---------------------------------------------------------------------------
def test_quantiles_equal_sorting(spark):
    rng = random.Random(1)
    groups = {
        "money": [round(rng.lognormvariate(3, 2), 2) for _ in range(3000)],
        "one": [4.5] * 500,  # a hot value
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-5, 5) for _ in range(400)],
        "close": [1.0 + k * 2.0**-52 for k in range(50)],
        "single": [7.0],
        None: [float(k % 10) for k in range(101)],
    }
    odd = [(g, v) for g in ("money", "empty") for v in (None, math.nan, math.inf, -math.inf)]
    rows = [(g, v) for g, values in groups.items() for v in values] + odd
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    counts = statistics.value_counts(frame, "v", "g").cache()
    wanted = (0, 1, 250, 500, 950, 999, 1000)
    found = {(r.g, r.permille): r.quantile for r in statistics.exact_quantiles(counts, ("g",), wanted).collect()}
    assert len(found) == len(groups) * len(wanted)
    for g, values in groups.items():
        ordered = sorted(values)
        for p in wanted:
            assert found[g, p] == ordered[max(1, -(-len(values) * p // 1000)) - 1], (g, p)
    common = statistics.common_values(counts, ("g",), 3).collect()
    for g, values in groups.items():
        got = [(r.value, r.n) for r in sorted(common, key=lambda r: r.place) if r.g == g]
        assert got == sorted(Counter(values).items(), key=lambda c: (-c[1], c[0]))[:3]
    counts.unpersist()


def test_statistics_of_groups_and_of_nothing(spark):
    frame = spark.createDataFrame([("a", 1.5), ("a", 1.5), ("a", 3.0), ("b", None)], "g string, v double")
    rows = statistics.value_statistics(frame, "v", ("g",)).collect()
    assert [(r.g, r.n, r.n_distinct, r.least, r.most, r.total, r.p500, r.p950) for r in rows] == [
        ("a", 3, 2, 1.5, 3.0, 6.0, 1.5, 3.0)
    ]
    assert [tuple(c) for c in rows[0].common] == [(1.5, 2), (3.0, 1)]
    assert statistics.value_statistics(frame.limit(0), "v", ("g",)).count() == 0


def test_values_are_counted_before_they_are_moved(spark):
    frame = spark.range(1000).selectExpr("id % 3 AS g", "cast(id % 5 AS double) AS v")
    plan = statistics.value_counts(frame, "v", "g")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("HashAggregate") and "partial_count" in plan
    counts = statistics.value_counts(frame, "v", "g")
    plan = statistics.common_values(counts, ("g",), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# ---- Template formats ----------------------------------------------------------------------
def template(mark, priority, name):
    return (mark, priority, name, 50.0, True, [f"saw {mark}"])


def brute_format(text, rows):
    held = [r for r in rows if r[0] and text is not None and r[0] in text]
    best = min(held, key=lambda r: (-(r[1] or 0), -len(r[0]), r[0], r[2]), default=None)
    return (best[2], best[0]) if best else ("Unknown Format", None)


def test_formats_equal_testing_every_mark(spark):
    rng = random.Random(4)
    marks = {"".join(rng.choice("ab.$") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    rows = [template(m, rng.randint(0, 4), f"t{k}") for k, m in enumerate(sorted(marks))]
    rows += [template(rows[0][0], 9, "again"), template("", 99, "empty"), template(None, 99, "null")]
    texts = [None, "", "SDN", *("".join(rng.choice("abc.$ \n") for _ in range(rng.randint(1, 14))) for _ in range(300))]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, format string")
    table = spark.createDataFrame(rows, formats.TEMPLATE_SCHEMA)
    out = formats.with_format(docs, table).orderBy("doc_id").collect()
    assert [(r["format"]["name"], r["format"]["mark"]) for r in out] == [brute_format(t, rows) for t in texts]
    none = formats.with_format(docs, table.limit(0))
    assert {r["format"]["name"] for r in none.collect()} == {"Unknown Format"}
    assert formats.with_format(docs.limit(0), table).count() == 0
    plan = formats.with_format(docs, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mark_patterns(spark):
    with pytest.raises(ValueError):
        longest_mark_pattern([""])
    long = "x" * 5000  # no recursion
    text = spark.createDataFrame([(f"a{long}b",)], "text string")
    pattern = F.lit(longest_mark_pattern([long, "a", "ax"]))
    assert [len(m) for m in text.select(F.regexp_extract_all("text", pattern, F.lit(1))).first()[0]] == [2, 5000]
    too_many = spark.range(formats.MOST_TEMPLATES + 1).select(F.col("id").cast("string").alias("mark"), F.lit(1).alias("priority"))
    with pytest.raises(ValueError):
        formats.templates_of(too_many)


# ---- Image headers -----------------------------------------------------------------------
def png(width, height, colour=2, depth=8, data=b"data", end=True, crc=0):
    def chunk(kind, body, wrong=0):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) ^ wrong)

    header = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header, crc) + chunk(b"IDAT", zlib.compress(data))
    return out + chunk(b"IEND", b"") if end else out


def jpeg(width, height, channels=3, before=b"", marker=0xC0, end=b"\xff\xd9"):
    frame = struct.pack(">BHHB", 8, height, width, channels) + b"\x01\x11\x00" * channels
    return b"\xff\xd8" + before + bytes([0xFF, marker]) + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xda\x00\x02zz" + end


def segment(marker, size):
    return bytes([0xFF, marker]) + struct.pack(">H", size + 2) + b"\xff\xc0" * (size // 2) + b"\x00" * (size % 2)


def test_image_headers(spark):
    many = b"".join(segment(0xE2, k % 5) for k in range(1500))
    cases = {
        png(640, 480): ("png", 640, 480, 3, None),
        png(1, 2**31 - 1, 6, 16): ("png", 1, 2**31 - 1, 4, None),
        png(5, 6, 3, 1): ("png", 5, 6, 3, None),
        png(5, 6, 0, 16): ("png", 5, 6, 1, None),
        png(5, 6, 2, 4): ("png", None, None, None, "bad_header"),
        png(5, 6, 5): ("png", None, None, None, "bad_header"),
        png(0, 6): ("png", None, None, None, "bad_header"),
        png(5, 6, crc=1): ("png", None, None, None, "bad_checksum"),
        png(5, 6, end=False): ("png", None, None, None, "cut_file"),
        png(5, 6)[:20]: ("png", None, None, None, "cut_header"),
        b"\x89PNG\r\n\x1a\n" + b"\0" * 40: ("png", None, None, None, "bad_header"),
        jpeg(300, 200): ("jpeg", 300, 200, 3, None),
        jpeg(300, 201, 1, segment(0xE0, 14) + b"\xff\xff\xff" + segment(0xFE, 9)[1:], 0xC2): ("jpeg", 300, 201, 1, None),
        jpeg(65535, 1, 4, b"\xff\x01\xff\xd3" + segment(0xC4, 30) + segment(0xE1, 65533)): ("jpeg", 65535, 1, 4, None),
        jpeg(7, 8, 3, many): ("jpeg", 7, 8, 3, None),
        jpeg(7, 8, 3, many + b"\x00"): ("jpeg", None, None, None, "bad_header"),
        jpeg(7, 0): ("jpeg", None, None, None, "bad_header"),
        jpeg(7, 8, 2): ("jpeg", None, None, None, "bad_header"),
        jpeg(7, 8, end=b""): ("jpeg", None, None, None, "cut_file"),
        jpeg(7, 8)[:9]: ("jpeg", None, None, None, "cut_header"),
        b"\xff\xd8": ("jpeg", None, None, None, "cut_header"),
        b"\xff\xd8\xff\xd9": ("jpeg", None, None, None, "bad_header"),
        b"\xff\xd8\xff\xe0\x00\x01": ("jpeg", None, None, None, "bad_header"),
        b"\xff\xd8" + b"\xff" * 300: ("jpeg", None, None, None, "cut_header"),
        b"GIF89a": ("none", None, None, None, "not_an_image"),
        b"": ("none", None, None, None, "no_content"),
        None: ("none", None, None, None, "no_content"),
    }
    rows = [(f"/f{k}", bytearray(c) if c is not None else None, "clash") for k, c in enumerate(cases)]
    files = spark.createDataFrame(rows, "path string, content binary, width string")
    out = {r.path: r for r in images.checked_headers(files).collect()}
    for k, want in enumerate(cases.values()):
        r = out[f"/f{k}"]
        assert (r.kind, r.width, r.height, r.channels, r.problem) == want, k
        assert (r.error_class == "bad_image") == (r.problem is not None)
    assert images.checked_headers(files.limit(0)).count() == 0


def test_headers_agree_with_the_decoder(spark, tmp_path):
    (tmp_path / "one.png").write_bytes(png(3, 2, data=b"\0" + b"\1\2\3" * 3 + b"\0" + b"\1\2\3" * 3))
    (tmp_path / "two.jpg").write_bytes(b"text")
    decoded = {r.path.rpartition("/")[2]: r for r in images.scan_image_checked(spark, str(tmp_path)).collect()}
    read = {r.path.rpartition("/")[2]: r for r in images.scan_image_headers(spark, str(tmp_path)).collect()}
    assert set(decoded) == set(read) == {"one.png", "two.jpg"}
    assert (decoded["one.png"].width, decoded["one.png"].height) == (read["one.png"].width, read["one.png"].height) == (3, 2)
    assert decoded["two.jpg"].error_class == read["two.jpg"].error_class == "bad_image"
