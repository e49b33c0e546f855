"""Host reputation from labelled pages, by empirical Bayes.

Page outcomes (bad or not) are counted per host. Each host's bad rate is shrunk towards that
of its registered domain, the domain's towards that of its suffix, the suffix's towards the
rate of all pages, each by a beta-binomial prior whose strength is estimated from the groups
of that level. A host is blocked when a lower bound of its posterior bad rate exceeds a limit.
Only counts per distinct host are shuffled; no group is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.session import stored

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Public suffixes of two labels (fixed values); any other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "ac.jp", "co.jp", "ne.jp", "or.jp", "com.au",
    "net.au", "org.au", "com.br", "org.br", "com.cn", "net.cn", "org.cn", "co.in", "co.kr",
    "co.nz", "org.nz", "co.za", "com.mx", "com.tr", "com.tw", "com.ar", "com.sg", "com.hk",
)
#: Share of variance between the groups of a level: its estimate stays in this range.
LEAST_SPREAD, MOST_SPREAD = 0.001, 0.5


@dataclass(frozen=True)
class Rule:
    """A written rule: ``verdict`` for a host, its subdomains, and paths that begin so."""

    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


def with_host(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty for null or no ``://``."""
    start = F.locate("://", F.col(url))
    rest = F.when(start > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)"))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, CAPITALS.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def _sites(hosts: DataFrame) -> DataFrame:
    """Add ``domain`` and ``suffix`` of a host; user and port don't count.

    An IPv4 address is its own domain, with the empty suffix, like the empty host.
    """
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"(:\d*|\.+)$", "")
    labels = F.split(bare, r"\.", -1)
    size = F.size(labels)
    last_two = F.array_join(F.slice(labels, F.greatest(size - 1, F.lit(1)), F.lit(2)), ".")
    two = (last_two.isin(*TWO_LABEL_SUFFIXES) & (size > 1)).cast("int")
    keep = F.least(two + 2, size)
    domain = F.array_join(F.slice(labels, size - keep + 1, keep), ".")
    suffix = F.when(two == 1, last_two).otherwise(F.element_at(labels, -1))
    address = bare.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    return hosts.withColumns(
        {
            "domain": F.when(address, bare).otherwise(domain),
            "suffix": F.when(address, F.lit("")).otherwise(suffix),
        }
    )


def host_counts(pages: DataFrame, outcomes: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per host of ``pages`` (key, host): ``domain``, ``suffix``, labelled ``n``, bad ``k``.

    ``outcomes`` has (key, bad): rows without a page, or with null ``bad``, count nothing.
    """
    labelled = (
        pages.select(key, "host")
        .join(outcomes.select(key, "bad").filter(F.col("bad").isNotNull()), key)
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    )
    hosts = pages.select("host").distinct().join(labelled, "host", "left")
    return _sites(hosts.na.fill(0, ["n", "k"]))


def _strength(groups: DataFrame, prior: str) -> float:
    """Prior strength of a level by the method of moments.

    With prior mean p, n(k/n - p)^2 has the mean p(1-p)(1 + (n-1)r); r is the share of
    variance between groups and 1/r - 1 the strength.
    """
    p = F.col(prior)
    row = (
        groups.filter("n > 0")
        .agg(
            F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("seen"),
            F.sum(p * (1 - p)).alias("within"),
            F.sum(p * (1 - p) * (F.col("n") - 1)).alias("between"),
        )
        .first()
    )
    spread = (row.seen - row.within) / row.between if row.between else LEAST_SPREAD
    return 1 / min(max(spread, LEAST_SPREAD), MOST_SPREAD) - 1


def reputations(hosts: DataFrame, error_share: float = 1.645) -> DataFrame:
    """Posterior of each host of ``host_counts``: ``bad_rate`` and its ``lower_bound``.

    ``error_share`` is the number of posterior standard deviations below the mean. Three
    numbers, the strengths of the levels, go through the driver. Without any
    labels every rate is 0.
    """
    hosts = stored(hosts, "host-counts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    root = (total.k + 1) / (total.n + 2) if total.n else 0.0
    above, above_key = None, None
    for level in ("suffix", "domain", "host"):
        if level == "host":
            groups = hosts
        else:
            keys = [level] if level == "suffix" else [level, "suffix"]
            groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if above is None:
            groups = groups.withColumn("prior", F.lit(root))
        else:
            groups = groups.join(above, above_key)
        strength = _strength(groups, "prior")
        bad, good = F.col("prior") * strength + F.col("k"), F.col("n") + strength
        mean = bad / good
        groups = groups.withColumn("mean", mean).withColumn("weight", good)
        # a domain is told apart by its suffix as well, for addresses and empty hosts
        above_key = ["suffix"] if level == "suffix" else ["domain", "suffix"]
        if level != "host":
            above = groups.select(*above_key, F.col("mean").alias("prior"))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return groups.select(
        "host",
        "domain",
        "suffix",
        "n",
        "k",
        F.col("mean").alias("bad_rate"),
        (F.col("mean") - error_share * deviation).alias("lower_bound"),
    )


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: tuple[Rule, ...] = (),
    key: str = "page_id",
    url: str = "url",
    max_bad_rate: float = 0.25,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null without one) and ``verdict`` (allow or block).

    The longest rule that fits decides, else the host's posterior. ``rules`` is a short
    written list. Rows of null or broken urls share the empty host and are judged like any
    host. Repeated rows are judged each; a repeated key joins each of its outcomes. Input
    columns of the names added are replaced.
    """
    clean = pages.drop("host", "path", "rule", "verdict")
    parsed = with_host(clean, url)
    scores = reputations(host_counts(parsed, outcomes, key))
    scores = scores.select(
        F.col("host").alias("__host"), (F.col("lower_bound") > max_bad_rate).alias("__bad")
    )
    host, path = F.col("host"), F.col("path")
    longest_first = sorted(rules, key=lambda r: -len(r.host + r.path))
    rule = F.coalesce(
        *(F.when(r.fits(host, path), F.lit(r.host + r.path)) for r in longest_first),
        F.lit(None).cast("string"),
    )
    written = F.coalesce(
        *(F.when(r.fits(host, path), F.lit(r.verdict)) for r in longest_first),
        F.lit(None).cast("string"),
    )
    own = F.when(F.col("__bad"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        parsed.join(scores, host == F.col("__host"), "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(written, own))
        .drop("__host", "__bad")
    )
