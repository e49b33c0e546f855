"""Benchmark decontamination with a positional inverted index.

The index holds a row (term, document, position) for every word of the training texts that
occurs in any test text, in the partitions of the texts: building it shuffles nothing. A test
phrase is searched from its rarest term: the positions of that term, less its offset in the
phrase, are the candidates; they are intersected with the offset-adjusted list of the next
rarest term, and the few that are left with the lists of all others, restricted to the
documents that are left. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.session import stored

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = 10
END = ""
#: Tables derived from the test texts or from matches are broadcast up to so many rows of a
#: few dozen bytes (counted first); beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased: runs of digits, letters and non-ASCII. Null: none."""
    lower = F.translate(F.coalesce(text, F.lit("")), CAPITALS, CAPITALS.lower())
    bare = F.regexp_replace(lower, rf"^{NOT_WORD}|{NOT_WORD}\z", "")
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, NOT_WORD, -1))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def phrases_of(tests: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(phrase, item, words): every run of ``PHRASE`` words of each test text.

    A text of fewer words is one phrase; a text without words has none. Equal phrases share
    ``phrase``, a hash of their words.
    """
    split = tests.select(F.col(key).alias("item"), words_of(F.col(text)).alias("__words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("__words") - PHRASE + 1, F.lit(1)))
    return (
        split.filter(F.size("__words") > 0)
        .select("item", "__words", F.explode(starts).alias("__at"))
        .select("item", F.slice("__words", F.col("__at"), F.lit(PHRASE)).alias("words"))
        .select(F.xxhash64("words").alias("phrase"), "item", "words")
    )


def indexed(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored postings (term, doc, text_hash, position from 0) of the words in ``terms``.

    ``terms`` has one row per word. A document is named by its id and its text's hash, so
    that rows which repeat an id with another text stay apart. Behind its last word each row
    has a posting of the term ``END``, no word, whose position is its number of words.
    """
    terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
    n_terms = terms.count()
    tokens = docs.select(
        F.col(key).alias("doc"),
        F.xxhash64(text).alias("text_hash"),
        F.posexplode(F.concat(words_of(F.col(text)), F.array(F.lit(END)))).alias("position", "term"),
    )
    return stored(tokens.join(_small(terms, n_terms), "term"), "postings")


def lengths(postings: DataFrame) -> DataFrame:
    """(doc, text_hash, n_words): one row per indexed row."""
    return postings.filter(F.col("term") == END).select(
        "doc", "text_hash", F.col("position").cast("long").alias("n_words")
    )


def _plan(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """(phrase, term, offset, rank, size): a phrase's places from its rarest term on.

    Phrases with a term that the index lacks occur nowhere and are left out.
    """
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    places = phrases.select(
        "phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term")
    ).dropDuplicates(["phrase", "offset"])
    weighed = places.join(counts, "term", "left")
    whole = Window.partitionBy("phrase")
    rarest_first = whole.orderBy("n", "offset")
    return (
        weighed.withColumn("__least", F.min(F.coalesce("n", F.lit(0))).over(whole))
        .filter("__least > 0")
        .withColumn("rank", F.row_number().over(rarest_first))
        .select("phrase", "term", "offset", "rank", "size")
    )


def _intersected(
    candidates: DataFrame, postings: DataFrame, places: DataFrame, n_places: int, slack: int
) -> DataFrame:
    """Candidates (doc, text_hash, phrase, start) that have a posting at each of ``places``.

    A place is (phrase, term, offset); a posting may lie up to ``slack`` words from it.
    """
    wide = slack + 1
    wanted = candidates.join(_small(places, n_places), "phrase")
    expected = F.col("start") + F.col("offset")
    if slack:
        cells = F.sequence(
            F.floor((expected - slack) / wide).cast("int"),
            F.floor((expected + slack) / wide).cast("int"),
        )
        wanted = wanted.withColumn("__cell", F.explode(cells))
    else:
        wanted = wanted.withColumn("__cell", expected)
    cell = F.floor(F.col("position") / wide).cast("int") if slack else F.col("position")
    listed = postings.select(
        F.col("doc").alias("__doc"),
        F.col("text_hash").alias("__hash"),
        F.col("term").alias("__term"),
        cell.alias("__own_cell"),
        "position",
    )
    same = (
        F.col("doc").eqNullSafe(F.col("__doc"))
        & (F.col("text_hash") == F.col("__hash"))
        & (F.col("term") == F.col("__term"))
        & (F.col("__cell") == F.col("__own_cell"))
    )
    if slack:
        same &= F.abs(F.col("position") - expected) <= slack
    needed = places.groupBy("phrase").agg(F.count("*").alias("__needed"))
    # several postings serve one place where rows repeat, or within the slack
    found = wanted.join(listed, same)
    found = found.select("doc", "text_hash", "phrase", "start", "offset").distinct()
    found = found.groupBy("doc", "text_hash", "phrase", "start").agg(F.count("*").alias("__n"))
    return (
        found.join(_small(needed, n_places), "phrase")
        .filter("__n = __needed")
        .select("doc", "text_hash", "phrase", "start")
    )


def occurrences(phrases: DataFrame, postings: DataFrame, slack: int = 0) -> DataFrame:
    """(doc, text_hash, phrase, start, size): where phrases occur in the indexed texts.

    ``slack`` 0 gives exact phrases: every word at its place after the first. Larger values
    give proximity matches: every word within ``slack`` words of its place as seen from the
    phrase's rarest word. A word at ``start`` may then lie before the text's begin.
    """
    plan = stored(_plan(phrases, postings), "phrase-plan")
    n_places = plan.count()
    rarest = plan.filter("rank = 1").select("phrase", "term", "offset")
    candidates = postings.join(_small(rarest, n_places), "term").select(
        "doc", "text_hash", "phrase", (F.col("position") - F.col("offset")).alias("start")
    )
    if not slack:
        candidates = candidates.filter("start >= 0")
    candidates = candidates.distinct()
    second = plan.filter("rank = 2").select("phrase", "term", "offset")
    second_terms = second.select("term").distinct()
    listed = postings.join(_small(second_terms, n_places), "term", "left_semi")
    single = plan.filter("rank = 1 AND size = 1").select("phrase")
    left = stored(_intersected(candidates, listed, second, n_places, slack), "phrase-candidates")
    n_left = left.count()
    rest = plan.filter("rank > 2").select("phrase", "term", "offset")
    docs = left.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    within = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash"))
    listed = postings.join(_small(docs, n_left), within, "left_semi")
    whole = _intersected(left, listed, rest, n_places, slack)
    sizes = plan.filter("rank = 1").select("phrase", "size")
    short = sizes.filter("size <= 2").select("phrase")
    found = whole.unionByName(left.join(_small(short, n_places), "phrase", "left_semi"))
    found = found.unionByName(candidates.join(_small(single, n_places), "phrase", "left_semi"))
    return found.join(_small(sizes, n_places), "phrase")


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    test_key: str = "item_id",
    test_text: str = "text",
    slack: int = 0,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: (key, n_words, n_hit, n_items, items, contaminated).

    ``keep`` names the columns of ``docs`` to carry instead of the key alone.

    ``n_hit`` counts the words inside any occurrence of a phrase, ``items`` are the ids (as
    strings, sorted) of the tests whose phrases occur. Null and empty texts have no words and
    no hits; null ids of tests are left out of ``items``; repeated rows each get the result
    of their own text; an empty table of tests marks nothing. Further columns don't matter.
    """
    phrases = stored(phrases_of(tests, test_key, test_text), "phrases")
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    postings = indexed(docs, terms, key, text)
    found = stored(occurrences(phrases, postings, slack), "occurrences")
    places = found.select("doc", "text_hash", "start", "size").distinct()
    own = F.sequence(F.greatest("start", F.lit(0)), F.col("start") + F.col("size") - 1)
    hit = (
        places.select("doc", "text_hash", F.explode(own).alias("position"))
        .distinct()
        .groupBy("doc", "text_hash")
        .agg(F.count("*").alias("__hit"))
    )
    items = (
        found.select("doc", "text_hash", "phrase")
        .distinct()
        .join(phrases.select("phrase", "item").distinct(), "phrase")
        .groupBy("doc", "text_hash")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("__items"))
    )
    named = {"doc": "__d", "text_hash": "__h"}
    marks = hit.withColumnsRenamed(named)
    same = F.col("doc").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h"))
    marks = stored(items.join(marks, same).drop("doc", "text_hash"), "contaminated")
    results = ("n_words", "n_hit", "n_items", "items", "contaminated")
    if keep is None:  # the index knows the rows and their lengths: the texts are read once
        rows = lengths(postings).select(
            F.col("doc").alias(key), F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "n_words"
        )
    else:
        rows = docs.select(
            *(c for c in keep if c not in results),
            F.col(key).alias("__doc"),
            F.xxhash64(text).alias("__hash"),
            F.size(words_of(F.col(text))).cast("long").alias("n_words"),
        )
    same = F.col("__doc").eqNullSafe(F.col("__d")) & (F.col("__hash") == F.col("__h"))
    found_items = F.coalesce("__items", F.array().cast("array<string>"))
    return (
        rows.join(_small(marks, marks.count()), same, "left")
        .withColumn("n_hit", F.coalesce("__hit", F.lit(0).cast("long")))
        .withColumn("n_items", F.size(found_items).cast("long"))
        .withColumn("items", found_items)
        .withColumn("contaminated", F.col("__hit").isNotNull())
        .drop("__doc", "__hash", "__d", "__h", "__hit", "__items")
    )
