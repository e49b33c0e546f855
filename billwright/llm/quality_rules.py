"""Quality rules with adaptive thresholds.

Each text gets a few counts. For every (lang, source) mergeable KLL sketches summarise the
rates built from the counts, and a text is kept when none of its rates lies beyond the
upper fence of its own group. No rate has a written cutoff: a fence is made of quantiles of the
group's texts and, where labels are given, of its language's texts known to be good, whose
sketches are merged from those of its groups. Everything is DataFrame functions: counting is
row-local, the sketches merge map-side, and only one small row per group meets the texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.session import stored

WHITE = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WHITE_CHARACTER = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rate -> the counts it divides, and what one event adds to the upper one: a window found
#: twice makes six words repeated.
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1),
    "repeat_rate": ("n_repeat_words", "n_words", 6),
    "word_length": ("word_chars", "n_words", 1),
}
#: With labels, a fence lies this many (upper - median) spreads above the quantile UPPER_RANK of
#: the good texts of the language; without, SPREADS (median - low quantile) above the median.
GOOD_SPREADS, UPPER_RANK = 3.0, 0.99
SPREADS, LOW_RANK = 6.0, 0.10
#: Events may exceed what the fence allows for by so many standard deviations of a Poisson
#: count, as they do in short texts by chance.
DEVIATIONS = 3.0


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``BASE_COLUMNS`` plus ``n_lines``.

    Null and blank texts have zeros. Columns of these names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(value, F.lit(WHITE))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(NOT_WHITE))
    stage = docs.withColumns(
        {
            "__words": F.when(bare == "", F.array().cast("array<string>")).otherwise(
                F.split(bare, GAP, -1)
            ),
            "__lines": lines,
            "n_symbols": F.regexp_count(value, F.lit(SYMBOL)).cast("long"),
            "word_chars": (
                F.length(value) - F.regexp_count(value, F.lit(WHITE_CHARACTER))
            ).cast("long"),
        }
    )
    stage = stage.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (
                F.size("__lines") - F.size(F.array_distinct("__lines"))
            ).cast("long"),
        }
    )
    return _with_repeats(stage).drop("__words", "__lines")


def _with_repeats(df: DataFrame) -> DataFrame:
    """Words in 3-word windows that the text holds twice or more.

    A window's hash and its place share one long (the place takes only the bits it needs),
    so equal windows are neighbours of a sorted primitive array; neighbours of equal hash
    are then compared word by word.
    """
    words = F.col("__words")
    df = df.withColumn(
        "__mask",
        F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(words)))) - 1,
    ).withColumn("__high", F.bitwise_not("__mask"))
    mask, high = F.col("__mask"), F.col("__high")
    places = F.greatest(F.size(words) - 2, F.lit(0))

    def packed(word: Column, place: Column) -> Column:
        value = F.xxhash64(word, F.get(words, place + 1), F.get(words, place + 2))
        return value.bitwiseAND(high).bitwiseOR(place)

    def beside(values: Column, same) -> Column:
        return F.filter(
            values, lambda x, i: same(x, F.get(values, i + 1)) | same(x, F.get(values, i - 1))
        )

    def same_hash(a: Column, b: Column) -> Column:
        return a.bitwiseAND(high) == b.bitwiseAND(high)

    def place_of(value: Column) -> Column:
        return value.bitwiseAND(mask).cast("int")

    def same_words(a: Column, b: Column) -> Column:
        equal = same_hash(a, b)
        for k in range(3):
            equal &= F.get(words, place_of(a) + k) == F.get(words, place_of(b) + k)
        return equal

    windows = F.slice(F.transform(words, packed), 1, places)
    df = df.withColumn("__sorted", F.sort_array(windows))
    df = df.withColumn("__twice", beside(F.col("__sorted"), same_hash))
    df = df.withColumn("__twice", beside(F.col("__twice"), same_words))
    covered = F.array_distinct(
        F.flatten(
            F.transform(
                "__twice",
                lambda x: F.array(place_of(x), place_of(x) + 1, place_of(x) + 2),
            )
        )
    )
    df = df.withColumn("n_repeat_words", F.size(covered).cast("long"))
    return df.drop("__mask", "__high", "__sorted", "__twice")


def base_failed() -> Column:
    """Fixed rules that hold in every group: too short, or more than half repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rate(name: str) -> Column:
    top, bottom, _ = RATES[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def _sketches(counted: DataFrame, *keys: str) -> DataFrame:
    return counted.groupBy(*keys).agg(*(F.kll_sketch_agg_double(_rate(r)).alias(f"__{r}") for r in RATES))


def _merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Upper quantiles of each rate from the sketches of several groups."""
    merged = sketches.groupBy(*keys).agg(*(F.kll_merge_agg_double(f"__{r}").alias(f"__{r}") for r in RATES))
    upper = (
        F.kll_sketch_get_quantile_double(f"__{r}", F.lit(UPPER_RANK)).alias(f"__upper_{r}") for r in RATES
    )
    return merged.select(*keys, *upper)


def group_fences(
    counted: DataFrame, keys: tuple[str, ...] = ("lang", "source"), good: DataFrame | None = None
) -> DataFrame:
    """One row per group: an upper fence for each rate, from sketches of its texts.

    Texts without words and those that fail the base rules take no part, so that they can't
    widen the fence. ``good`` are those of ``counted`` that are labelled good. The fence lies
    beyond the upper quantile of the good texts of the first key (of all keys where it has
    none) by a multiple of that quantile's distance to the group's median. Without ``good`` (or
    if it is empty) the fence is the median plus a multiple of the distance from a low quantile
    to the median: junk raises upper quantiles, not these two, below half of the group.
    """
    own = _sketches(counted.filter(~base_failed()), *keys)
    quantile = F.kll_sketch_get_quantile_double
    middle = {r: quantile(f"__{r}", F.lit(0.5)) for r in RATES}
    low = {r: quantile(f"__{r}", F.lit(LOW_RANK)) for r in RATES}
    whole = None
    if good is not None:
        by_group = stored(_sketches(good.filter(~base_failed()), *keys), "good-sketches")
        whole = _merged(by_group).first()
    if whole is None or whole[0] is None:
        return own.select(
            *keys, *((middle[r] + SPREADS * (middle[r] - low[r])).alias(f"{r}_fence") for r in RATES)
        )
    first = keys[0]
    by_first = _merged(by_group, first).withColumnRenamed(first, "__first")
    joined = own.join(by_first, F.col(first).eqNullSafe(F.col("__first")), "left")
    fences = []
    for at, rate in enumerate(RATES):
        upper = F.coalesce(F.col(f"__upper_{rate}"), F.lit(whole[at]))
        fence = upper + GOOD_SPREADS * F.greatest(upper - middle[rate], F.lit(0.0))
        fences.append(fence.alias(f"{rate}_fence"))
    return joined.select(*keys, *fences)


def judged(
    docs: DataFrame,
    text: str = "text",
    keys: tuple[str, ...] = ("lang", "source"),
    columns: list[str] | None = None,
    labels: DataFrame | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """Add counts, ``base_failed``, ``failed_rates`` (array of names) and ``kept``.

    ``labels`` has the ``key`` and ``quality`` (1: good) of some texts. ``columns``: those of
    ``docs`` to carry (default all). Null keys form a group of their own. Repeated rows are
    judged each. A group whose texts all fail the base rules has no fence and keeps none. An
    empty table gives an empty result. Input columns that carry the name of a result are
    replaced.
    """
    results = (*BASE_COLUMNS, "n_lines", "base_failed", "failed_rates", "kept")
    carried = [c for c in (columns or docs.columns) if c not in results]
    named = [] if labels is None else [key]
    needed = list(dict.fromkeys([*carried, *keys, *named, text]))
    counted = with_counts(docs.select(*needed), text)
    counted = counted.select(
        *dict.fromkeys([*carried, *keys, *named]), *BASE_COLUMNS, "n_lines"
    )
    counted = stored(counted.withColumn("base_failed", base_failed()), "quality-counts")
    good = None
    if labels is not None:
        known = labels.filter("quality = 1").select(F.col(key).alias("__known"))
        sized = counted.select(*dict.fromkeys([key, *keys]), *BASE_COLUMNS, "n_lines")
        good = sized.join(known, F.col(key) == F.col("__known"), "left_semi")
    marks = [f"__key{i}" for i in range(len(keys))]
    fences = group_fences(counted, keys, good).withColumnsRenamed(dict(zip(keys, marks, strict=True)))
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marks, strict=True)]
    joined = counted.join(fences, same, "left")
    failed = F.filter(
        F.array(*(F.when(_beyond(r), F.lit(r)) for r in RATES)),
        lambda x: x.isNotNull(),
    )
    judged_rows = joined.withColumn("failed_rates", failed)
    fenced = F.col(f"{next(iter(RATES))}_fence").isNotNull()
    kept = ~F.col("base_failed") & (F.size("failed_rates") == 0) & fenced
    return judged_rows.withColumn("kept", kept).select(
        *carried, *BASE_COLUMNS, "base_failed", "failed_rates", "kept"
    )


def _beyond(rate: str) -> Column:
    top, bottom, event = RATES[rate]
    allowed = F.greatest(F.col(f"{rate}_fence") * F.col(bottom) / event, F.lit(0.0))
    return F.col(top) / event > allowed + DEVIATIONS * F.sqrt(allowed) + DEVIATIONS**2
