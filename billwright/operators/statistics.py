"""Exact quantiles and commonest values of numbers per group, without sorting or gathering any.

Equal values are counted first, so that a hot value is one row per task. A quantile is then
found by narrowing: the values between the current bounds of a group fall into buckets of equal
width, the buckets are counted, and the one that holds the wanted rank gives the next bounds,
until all values between them are equal: about one pass for each factor of 1,024 between the
range of the values and the gap around the quantile. A pass moves one row per group, quantile and bucket;
no task sees the values of a group, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.session import stored

BUCKETS = 1024


def value_counts(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, value, n): the finite values of each group and how often each occurs."""
    number = F.col(value).cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return rows.filter(finite).groupBy(*by, number.alias("value")).agg(F.count("*").alias("n"))


def _same(by: tuple[str, ...], prefix: str) -> Column:
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return same


def _narrowed(counts: DataFrame, targets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The targets with the bounds of the bucket that holds their rank, one pass further."""
    named = targets.select(
        *(F.col(c).alias(f"__{c}") for c in by), "permille", "rank", "low", "high"
    )
    width = F.col("high") - F.col("low")
    place = F.floor((F.col("value") - F.col("low")) / width * BUCKETS)
    bucket = F.when(width > 0, F.least(place, F.lit(BUCKETS - 1))).otherwise(F.lit(0))
    within = (
        counts.join(named, _same(by, "__") & F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*by, "permille", "rank", bucket.cast("int").alias("bucket"))
        .agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    # at most BUCKETS rows to a group and quantile
    up_to = F.sum("n").over(Window.partitionBy(*by, "permille").orderBy("bucket"))
    rank = F.col("rank") - (F.col("up_to") - F.col("n"))
    return (
        within.withColumn("up_to", up_to)
        .filter((F.col("rank") <= F.col("up_to")) & (rank >= 1))
        .select(*by, "permille", rank.alias("rank"), "low", "high")
    )


def exact_quantiles(counts: DataFrame, by: tuple[str, ...], permille: tuple[int, ...]) -> DataFrame:
    """(by, permille, quantile): the least value with at least permille / 1000 of a group up to it.

    ``counts`` is a stored table of ``value_counts``. Permille 0 is the least value. Groups
    without values have no row; null keys are groups of their own.
    """
    wanted = F.explode(F.array(*map(F.lit, permille))).alias("permille")
    whole = counts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    rank = F.greatest(F.expr("(n * permille + 999) div 1000"), F.lit(1))
    targets = whole.select("*", wanted).select(*by, "permille", rank.alias("rank"), "low", "high")
    targets = stored(targets, "quantile-bounds")
    found = None
    while True:
        done = targets.filter("low = high").select(*by, "permille", F.col("low").alias("quantile"))
        found = done if found is None else found.unionByName(done)
        left = targets.filter("low < high")
        if left.isEmpty():
            return found
        targets = stored(_narrowed(counts, left, by), "quantile-bounds")


def common_values(counts: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """(by, place, value, n): the k commonest values of each group (ties: the smaller value).

    Each task keeps its own k rows of a group before any are moved.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def value_statistics(
    rows: DataFrame, value: str, by: tuple[str, ...], permille: tuple[int, ...] = (500, 950), k: int = 3
) -> DataFrame:
    """One row per group: n, n_distinct, least, most, total, a column per quantile, common.

    Quantiles are named ``p500`` and so on; ``common`` is an array of (value, n) from the
    commonest on. ``total`` adds up value * n in decimals of 6 places. Null, NaN and infinite
    values count nowhere; groups without any other value have no row.
    """
    counts = stored(value_counts(rows, value, *by), "value-counts")
    exact = (F.col("value").cast("decimal(26,6)") * F.col("n").cast("decimal(12,0)")).cast("decimal(38,6)")
    sizes = counts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_distinct"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.sum(exact).cast("double").alias("total"),
    )
    quantiles = exact_quantiles(counts, by, permille).groupBy(*by)
    quantiles = quantiles.pivot("permille", list(permille)).agg(F.first("quantile"))
    quantiles = quantiles.select(
        *(F.col(c).alias(f"__q_{c}") for c in by), *(F.col(str(p)).alias(f"p{p}") for p in permille)
    )
    common = common_values(counts, by, k).groupBy(*by)
    common = common.agg(F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("common"))
    common = common.select(
        *(F.col(c).alias(f"__c_{c}") for c in by),
        F.transform("common", lambda c: F.struct(c["value"].alias("value"), c["n"].alias("n"))).alias("common"),
    )
    joined = sizes.join(quantiles, _same(by, "__q_")).join(common, _same(by, "__c_"))
    return joined.drop(*(f"__{side}_{c}" for side in "qc" for c in by))
