"""Secrets in texts: fixed patterns, and character Markov models of what looks random.

The patterns (assignments to a keyword, access keys, long hexadecimal strings) give the base
spans. Their values are also the labelled samples of random strings; the samples of ordinary
identifiers are the shorter strings of texts without any base span. For both, a first-order Markov
model of characters is counted, smoothed by its single characters. Long strings of letters and
digits that stand in no assignment are candidates; one whose log-likelihood ratio of the two
models exceeds ``LEAST_RATIO`` is one more span. DataFrame functions only: patterns and scores are
row-local, the model's counts are one aggregate over a bounded number of labelled texts.
"""

from __future__ import annotations

import json
import math
import string
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.session import stored

# The base patterns and their least lengths.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 6
ACCESS = "AKIA[A-Z0-9]+"
LEAST_ACCESS = 20
HEX = "[0-9a-f]+"
LEAST_HEX = 24
#: Kinds in the order in which spans of equal start are listed; the last is the method's.
KINDS = ("assign", "access", "hex", "random")

ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/_=-"
IN_STRING = "[A-Za-z0-9+/_=-]"
LEAST_CANDIDATE = 20
LEAST_ORDINARY = 4
#: Labelled texts of each kind that teach the models, those of the least md5 of their keys.
SAMPLE_TEXTS = 2000
#: Observations by which single characters smooth a pair's frequency.
SMOOTHING = 10.0
#: Shares of random and of ordinary strings whose characters are all equally likely: labelled
#: samples show few alphabets, and what neither has seen must not weigh much.
UNIFORM = {True: 0.2, False: 0.02}
#: Natural logarithm of the odds that a span must reach: 1 to 22,000 strings is the prior.
LEAST_RATIO = 10.0
#: Positions are added up in runs of so many matches, so that long texts stay near linear.
RUN = 256

_SPAN = "struct<kind:int,start:int,end:int,value:string>"
_PLACES = "array<struct<start:int,end:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _places(pieces: Column, hits: Column) -> Column:
    """(start, end) of each hit in code points, from the pieces of text around the hits.

    Two levels of sums: within runs of RUN hits, then over the runs.
    """
    steps = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(hits)),
        hits,
        lambda piece, hit: F.struct(F.length(piece).alias("skip"), F.length(hit).alias("size")),
    )

    def step(done: Column, one: Column) -> Column:
        start = done["at"] + one["skip"]
        place = F.struct(start.alias("start"), (start + one["size"]).alias("end"))
        return F.struct((start + one["size"]).alias("at"), F.concat(done["out"], F.array(place)).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACES).alias("out"))
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int")),
        lambda run: F.aggregate(F.slice(steps, run * RUN + 1, F.lit(RUN)), none, step),
    )

    def shifted(done: Column, run: Column) -> Column:
        moved = F.transform(
            run["out"],
            lambda p: F.struct((p["start"] + done["at"]).alias("start"), (p["end"] + done["at"]).alias("end")),
        )
        return F.struct((done["at"] + run["at"]).alias("at"), F.concat(done["out"], F.array(moved)).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACES}>").alias("out"))
    return F.flatten(F.aggregate(runs, nothing, shifted)["out"])


def undecided(value: Column) -> Column:
    """True for strings long enough to be a candidate, with a letter and a digit."""
    return (F.length(value) >= LEAST_CANDIDATE) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _spans(kind: int, places: Column, values: Column) -> Column:
    return F.zip_with(
        places,
        values,
        lambda p, v: F.struct(
            F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), v.alias("value")
        ),
    )


def _simple(text: Column, pattern: str, kind: int) -> Column:
    """Spans of a pattern without groups."""
    hits = _matches(text, pattern)
    found = _spans(kind, _places(F.split(text, pattern, -1), hits), hits)
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scanned(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base``, the spans of the patterns, and ``candidates``: (kind, start, end, value).

    Candidates are strings of at least ``LEAST_CANDIDATE`` characters with a letter and a
    digit, outside of all assignments, that hold no base span. The text itself is dropped.
    """
    kept = keep if keep is not None else docs.columns
    none = F.array().cast(f"array<{_SPAN}>")
    assign = f"(?i)(?=[psta]){ASSIGN}"
    access = "AKIA[A-Z0-9]{%d,}+" % (LEAST_ACCESS - 4)
    hexes = "[0-9a-f]{%d,}+" % LEAST_HEX
    strings = "%s{%d,}+" % (IN_STRING, LEAST_CANDIDATE)
    body = F.col("__text")
    rows = docs.select(*kept, F.coalesce(docs[text], F.lit("")).alias("__text"))
    rows = rows.withColumn("__hits", _matches(body, assign))
    assigned = F.size("__hits") > 0
    rows = rows.withColumn(
        "__pieces", F.when(assigned, F.split(body, assign, -1)).otherwise(F.array(body))
    )
    rows = rows.withColumn("__ends", F.when(assigned, _places(F.col("__pieces"), F.col("__hits"))))
    values = _spans(1, F.col("__ends"), _matches(body, assign, 2))
    long = F.filter(values, lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    rows = rows.withColumn("__assign", F.when(assigned, long).otherwise(none))
    # what lies before the first assignment, and behind each of them
    starts = F.concat(F.array(F.lit(0)), F.coalesce(F.col("__ends.end"), F.array().cast("array<int>")))

    def candidates(piece: Column, start: Column) -> Column:
        wanted = F.filter(
            _simple(piece, strings, 4),
            lambda s: undecided(s["value"]) & ~s["value"].rlike(access) & ~s["value"].rlike(hexes),
        )
        return F.transform(
            wanted,
            lambda s: F.struct(
                s["kind"].alias("kind"),
                (s["start"] + start).alias("start"),
                (s["end"] + start).alias("end"),
                s["value"].alias("value"),
            ),
        )

    rows = rows.withColumn("__candidates", F.flatten(F.zip_with("__pieces", starts, candidates)))
    base = F.concat("__assign", _simple(body, access, 2), _simple(body, hexes, 3))
    kept = [c for c in kept if c not in ("base", "candidates")]
    return rows.select(*kept, base.alias("base"), F.col("__candidates").alias("candidates"))


def labelled_strings(found: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(value, random): values of base spans, and the strings of texts without any.

    Candidates are not labelled: they are what the models are to decide.

    Of either kind of text, at most ``SAMPLE_TEXTS`` (those of the least md5 of their keys).
    """

    def sample(condition: Column) -> DataFrame:
        keys = found.groupBy(key).agg(F.max(F.size("base")).alias("n")).filter(condition)
        return keys.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(SAMPLE_TEXTS).select(key)

    secret = found.join(F.broadcast(sample(F.col("n") > 0)), key, "left_semi")
    random = secret.select(F.explode("base").alias("s")).select("s.value", F.lit(True).alias("random"))
    plain = docs.select(key, text).join(F.broadcast(sample(F.col("n") == 0)), key, "left_semi")
    strings = _matches(F.col(text), "%s{%d,}" % (IN_STRING, LEAST_ORDINARY))
    ordinary = plain.select(F.explode(strings).alias("value"), F.lit(False).alias("random"))
    return random.unionByName(ordinary.filter(~undecided(F.col("value"))))


def pair_counts(strings: DataFrame) -> dict[bool, Counter]:
    """How often one character follows another: at most 2 * 67 * 67 numbers."""
    chars = strings.select("random", F.split("value", "").alias("c"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.concat(F.get("c", i - 1), F.get("c", i))
    )
    counted = (
        chars.filter(F.size("c") > 1)
        .select("random", F.explode(pairs).alias("pair"))
        .groupBy("random", "pair")
        .count()
    )
    known = F.col("pair").rlike(f"^{IN_STRING}{{2}}$")
    counts = {True: Counter(), False: Counter()}
    for row in counted.filter(known).collect():
        counts[row["random"]][row["pair"]] = row["count"]
    return counts


def transitions(counts: Counter, uniform: float) -> dict[str, float]:
    """Probability of each second character after each first one."""
    followed, seen = Counter(), Counter()
    for pair, n in counts.items():
        followed[pair[0]] += n
        seen[pair[1]] += n
    total, size = sum(seen.values()), len(ALPHABET)
    out = {}
    for a in ALPHABET:
        for b in ALPHABET:
            single = (seen[b] + 1.0) / (total + size)
            learned = (counts[a + b] + SMOOTHING * single) / (followed[a] + SMOOTHING)
            out[a + b] = (1 - uniform) * learned + uniform / size
    return out


def ratios(counts: dict[bool, Counter]) -> list[float]:
    """Log-likelihood ratio of each pair of characters, in the alphabet's order."""
    random, ordinary = (transitions(counts[kind], UNIFORM[kind]) for kind in (True, False))
    return [math.log(random[a + b]) - math.log(ordinary[a + b]) for a in ALPHABET for b in ALPHABET]


def ratio_of(value: Column, table: Column) -> Column:
    """Sum of a string's log-likelihood ratios."""
    places = F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    none = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum"))

    def step(done: Column, at: Column) -> Column:
        pair = F.get(table, done["before"] * len(ALPHABET) + at)
        more = F.when(done["before"] >= 0, done["sum"] + pair).otherwise(F.lit(0.0))
        return F.struct(at.alias("before"), more.alias("sum"))

    return F.aggregate(places, none, step)["sum"]


def listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            order,
            lambda s: F.concat_ws(":", F.get(names, s["kind"] - 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def with_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``base``, the spans of the patterns, and ``spans``, those and the models' ones.

    Both are arrays of (kind, start, end, value): kind is a number into ``KINDS`` from 1, start
    and end count code points, the end is exclusive. Base spans of one kind don't overlap.

    Null and empty texts have no spans; repeated rows each get their result; where no text
    has a base span, every pair of characters is equally likely in a random string; ``keep``
    names the columns to carry (default all but the text), input columns named ``base`` or
    ``spans`` are replaced; an empty table gives an empty one.
    """
    kept = keep if keep is not None else [c for c in docs.columns if c != text]
    kept = [c for c in kept if c not in ("base", "spans", "candidates")]
    carried = docs.select(*kept, F.col(key).alias("__key"), F.col(text).alias("__source"))
    found = stored(scanned(carried, "__source", [*kept, "__key"]), "secret-candidates")
    table = ratios(pair_counts(labelled_strings(found, carried, "__key", "__source")))
    table = F.from_json(F.lit(json.dumps(table)), "array<double>")
    more = F.filter("candidates", lambda s: ratio_of(s["value"], table) > LEAST_RATIO)
    return found.select(*kept, "base", F.concat("base", more).alias("spans"))
