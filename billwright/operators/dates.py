"""Calendar dates from date texts, with the order of day and month learned per source.

Two passes. Dates that can be read in one order only vote for it, one pair of counts per
source and task; the votes are joined back and decide the dates that could be either. The
text in ``date`` stays as it is: ``date_parsed`` is a further column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions.text import ascii_digits
from billwright.session import stored

DAY_FIRST, MONTH_FIRST, YEAR_FIRST = "day_first", "month_first", "year_first"
#: Two-digit years below are of this century, others of the last one.
PIVOT = 70
_YEAR_FIRST = "^[0-9]{4}"


def _number(date: Column, start: int, length: int) -> Column:
    return F.substring(date, start, length).cast("int")


def _as_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null when the calendar lacks it."""
    sound = (year >= 1) & month.between(1, 12) & (day >= 1)
    # clamped, so that no branch can fail
    first = F.make_date(F.greatest(year, F.lit(1)), F.least(F.greatest(month, F.lit(1)), F.lit(12)), F.lit(1))
    return F.when(sound & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def _plain(dates: Column) -> Column:
    return F.transform(dates, ascii_digits)


def _short_tails(plain: Column) -> Column:
    """What the two-digit pattern finds within dates that begin with their year."""
    whole = F.filter(plain, lambda d: d.rlike(_YEAR_FIRST))
    return F.transform(whole, lambda d: F.substring(d, 3, 8))


def _votes(plain: Column) -> tuple[Column, Column]:
    """How many of a text's dates can only be day first, and only month first."""
    ordered = F.array_except(F.filter(plain, lambda d: ~d.rlike(_YEAR_FIRST)), _short_tails(plain))

    def count(low: int, high: int) -> Column:
        """Dates whose number at ``low`` is a month and at ``high`` a day beyond any month."""
        return F.size(
            F.filter(ordered, lambda d: _number(d, low, 2).between(1, 12) & _number(d, high, 2).between(13, 31))
        )

    return count(4, 1), count(1, 4)


def date_votes(voted: DataFrame, *by: str) -> DataFrame:
    """(by, day_votes, month_votes): unambiguous dates of each group, of all dates of its texts."""
    sums = [F.sum(c).alias(c) for c in ("day_votes", "month_votes")]
    return voted.groupBy(*by).agg(*sums)


def _order_of(votes: str) -> Column:
    day, month = F.col(f"{votes}.day_votes"), F.col(f"{votes}.month_votes")
    return F.when(day > month, DAY_FIRST).when(month > day, MONTH_FIRST)


def with_parsed_dates(
    dated: DataFrame, keys: list[str], source: str = "source", corpus: str = "corpus"
) -> DataFrame:
    """(keys, corpus, source, date, date_parsed, date_order, decided_by, date_problem).

    ``dated`` has the columns ``dates`` and ``date`` of ``records.with_dates``. Only dates, no
    texts, are stored between the passes.

    A year of four digits at the front decides by itself, also where ``date`` is the short
    form that the two-digit pattern reads out of it. Otherwise the day and the month are told
    apart by the date (``decided_by`` date), else by the votes of its source, else by those of
    its corpus. Ties and groups without votes decide nothing: ``date_parsed`` is null and
    ``date_problem`` is ``undecided_order``. Dates that no calendar has give
    ``impossible_date``; texts without dates have null in all of these. Two-digit years are of
    1970 to 2069. A null source or corpus is a group of its own.
    """
    plain = F.col("__plain")
    rows = dated.withColumn("__plain", _plain(F.col("dates")))
    day_votes, month_votes = _votes(plain)
    wide = F.filter(plain, lambda d: d.rlike(_YEAR_FIRST))
    first = F.col("__first")
    voted = rows.withColumn("__first", ascii_digits(F.col("date"))).select(
        *keys,
        *dict.fromkeys(c for c in (corpus, source) if c not in keys),
        "date",
        first.alias("__date"),
        # the whole date that the first one is the tail of
        F.get(F.filter(wide, lambda d: F.substring(d, 3, 8) == first), F.lit(0)).alias("__whole"),
        day_votes.alias("day_votes"),
        month_votes.alias("month_votes"),
    )
    voted = stored(voted, "voted-dates")
    named = {
        "__source_votes": (corpus, source),
        "__corpus_votes": (corpus,),
    }
    out = voted.drop("day_votes", "month_votes")
    for name, by in named.items():
        votes = date_votes(voted, *by).select(
            *(F.col(c).alias(f"__by_{c}") for c in by), F.struct("day_votes", "month_votes").alias(name)
        )
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
        out = out.join(votes, same, "left").drop(*(f"__by_{c}" for c in by))

    date = F.col("__date")
    year_first = F.coalesce("__whole", F.when(date.rlike(_YEAR_FIRST), date))
    a, b = _number(date, 1, 2), _number(date, 4, 2)
    short = F.length(date) == 8
    late = F.substring(date, 7, 4).cast("int")
    year = F.when(short, F.when(late < PIVOT, late + 2000).otherwise(late + 1900)).otherwise(late)
    can_day, can_month = b.between(1, 12) & (a >= 1), a.between(1, 12) & (b >= 1)
    own = (
        F.when(year_first.isNotNull(), YEAR_FIRST)
        .when((a == b) & can_day, DAY_FIRST)
        .when(can_day & ((a > 12) | ~can_month), DAY_FIRST)
        .when(can_month & ((b > 12) | ~can_day), MONTH_FIRST)
    )
    either = F.when(can_day & can_month & (a <= 12) & (b <= 12), F.lit(True))
    out = out.withColumns(
        {
            "__year_first": year_first,
            "__own": own,
            "__by_source": F.when(either, _order_of("__source_votes")),
            "__by_corpus": F.when(either, _order_of("__corpus_votes")),
        }
    )
    order = F.coalesce("__own", "__by_source", "__by_corpus")
    whole = F.col("__year_first")
    parsed = (
        F.when(F.col("date_order") == YEAR_FIRST, _as_date(_number(whole, 1, 4), _number(whole, 6, 2), _number(whole, 9, 2)))
        .when(F.col("date_order") == DAY_FIRST, _as_date(year, b, a))
        .when(F.col("date_order") == MONTH_FIRST, _as_date(year, a, b))
    )
    decided_by = (
        F.when(F.col("__own").isNotNull(), "date")
        .when(F.col("__by_source").isNotNull(), "source")
        .when(F.col("__by_corpus").isNotNull(), "corpus")
    )
    problem = F.when(
        F.col("date_parsed").isNull() & date.isNotNull(),
        F.when(F.col("date_order").isNull() & F.coalesce(either, F.lit(False)), "undecided_order").otherwise(
            "impossible_date"
        ),
    )
    out = out.withColumn("date_order", order).withColumn("decided_by", decided_by).withColumn("date_parsed", parsed)
    out = out.withColumn("date_problem", problem)
    added = ("date_parsed", "date_order", "decided_by", "date_problem")
    return out.select(
        *keys, *dict.fromkeys(c for c in (corpus, source) if c not in keys), "date", *added
    )
