"""The training-data operators against brute force, a library, or worked-out cases.

Every fixture holds nulls, empty texts, repeated rows, ties and columns whose names clash with
those an operator adds; every operator is also given an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from billwright.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    html_extract,
    jaccard_join,
    lm_scoring,
    quality_rules,
    token_counts,
    url_filter,
    warc,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(seed: int, size: int, words=WORDS) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(size))


def long_text() -> str:
    return prose(9, 5000, [f"w{i}" for i in range(3000)])


# ---- URL filter ----------------------------------------------------------------------
RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


def test_hosts_rules_and_broken_urls(spark):
    cases = {
        1: ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        2: ("http://b.net/", "b.net", "/", "net/", "block"),
        3: ("http://b.net", "b.net", "", None, "allow"),
        4: ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        5: ("https://www.example.com/de/a/b", "www.example.com", "/de/a/b", "example.com/de/", "block"),
        6: (None, "", "", None, "allow"),
        7: ("no scheme", "", "", None, "allow"),
        8: ("", "", "", None, "allow"),
        9: ("x://U@h.org:80/fr/?a=://b", "u@h.org:80", "/fr/", None, "allow"),
        10: ("x://h.org/fr/#a", "h.org", "/fr/", "org/fr/", "allow"),
        11: ("x://h.org?/fr/", "h.org", "", None, "allow"),
    }
    pages = spark.createDataFrame(
        [(k, v[0], "mine", "clash") for k, v in cases.items()],
        "page_id long, url string, host string, verdict string",
    )
    none = spark.createDataFrame([], "page_id long, bad boolean")
    rows = url_filter.judged(pages.unionByName(pages), none, RULES).collect()
    assert len(rows) == 2 * len(cases)
    for r in rows:
        assert (r.url, r.host, r.path, r.rule, r.verdict) == cases[r.page_id]
    assert url_filter.judged(pages.limit(0), none, RULES).count() == 0


def test_bad_hosts_are_blocked_and_thin_ones_shrunk(spark):
    pages, outcomes, n = [], [], 0
    for host, bad, good in (("bad.a.com", 60, 5), ("good.b.com", 2, 80), ("thin.b.com", 1, 0),
                            ("mixed.c.org", 10, 60), ("new.a.com", 0, 0)):
        for k in range(bad + good):
            pages.append((n, f"http://{host}/{k}"))
            outcomes.append((n, k < bad))
            n += 1
        pages.append((n, f"http://{host}/unlabelled"))
        outcomes.append((n, None))
        n += 1
    pages = spark.createDataFrame(pages, "page_id long, url string")
    outcomes = spark.createDataFrame(outcomes, "page_id long, bad boolean")
    hosts = url_filter.host_counts(url_filter.with_host(pages), outcomes)
    scores = {r.host: r for r in url_filter.reputations(hosts).collect()}
    assert (scores["bad.a.com"].n, scores["bad.a.com"].k) == (65, 60)
    assert scores["good.b.com"].bad_rate < scores["thin.b.com"].bad_rate < 0.9
    assert scores["new.a.com"].bad_rate > scores["good.b.com"].bad_rate
    rows = url_filter.judged(pages, outcomes).collect()
    verdicts = {r.host: r.verdict for r in rows}
    assert verdicts["bad.a.com"] == "block"
    assert {verdicts[h] for h in ("good.b.com", "thin.b.com", "mixed.c.org")} == {"allow"}


# ---- Decontamination -------------------------------------------------------------------
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def word_list(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, tests):
    phrases = defaultdict(set)
    for item, text in tests:
        words = word_list(text)
        for at in range(max(1, len(words) - 9) if words else 0):
            phrases[tuple(words[at : at + 10])].add(item)
    out = []
    for doc, text in docs:
        words, hit, items = word_list(text), set(), set()
        for size in set(map(len, phrases)):
            for at in range(len(words) - size + 1):
                if found := phrases.get(tuple(words[at : at + size])):
                    hit.update(range(at, at + size))
                    items |= found
        named = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(words), len(hit), named, bool(hit)))
    return sorted(out, key=repr)


def contamination_fixture():
    tests = [(k, prose(100 + k, 8 + 3 * k)) for k in range(8)]
    tests += [(20, "Solo"), (21, "two words"), (22, None), (23, "!!"), (24, tests[3][1]), (None, "tri ple x")]
    tests += [(25, "a b c d e f g h i j"), (26, "same same same same same same same same same same")]
    docs = [(k, prose(k, 60)) for k in range(20)]
    docs += [(100 + k, f"{prose(k, 7)} {tests[k][1].upper()}!! {prose(k, 5)}") for k in range(8)]
    docs += [(200, tests[5][1]), (201, None), (202, ""), (203, "solo. SOLO two\nwords tri ple x"), (204, "same " * 25)]
    docs += [(205, "a b c d e f g h i"), (206, "a b c d e f g h i j k"), (207, "é日本 solo"), (None, "solo solo")]
    docs += [(200, tests[5][1]), (203, "another text of id 203"), (208, long_text() + " " + tests[6][1])]
    return docs, tests


def test_contamination_equals_brute_force(spark):
    docs, tests = contamination_fixture()
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_hit int, term string")
    items = spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.contamination(frame, items).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr)
    assert found == brute_contamination(docs, tests)
    assert all(r.n_items == len(r["items"]) for r in got)
    kept = decontaminate.contamination(frame, items, keep=frame.columns)
    assert set(frame.columns) <= set(kept.columns) and kept.count() == len(docs)
    none = decontaminate.contamination(frame, items.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontaminate.contamination(frame.limit(0), items).count() == 0


def test_joins_beyond_the_broadcast_bound_agree(spark, monkeypatch):
    docs, tests = contamination_fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(tests, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    got = decontaminate.contamination(frame, items).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=repr)
    assert found == brute_contamination(docs, tests)


def test_proximity_matches(spark):
    tests = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "one two three four five six seven eight nine ten"), (2, "one two and three four five six seven eight nine ten"),
         (3, "two one three four five six seven eight ten nine"), (4, "one two three four five six seven eight nine x x x x ten"),
         (5, "one two three")], "doc_id long, text string",
    )
    exact = decontaminate.contamination(docs, tests)
    near = decontaminate.contamination(docs, tests, slack=1)
    assert {r.doc_id for r in exact.filter("contaminated").collect()} == {1}
    assert {r.doc_id for r in near.filter("contaminated").collect()} == {1, 2, 3}


# ---- Token counts ------------------------------------------------------------------------
def library_unigram(pieces, byte_pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = [("<unk>", min(s for _, s in pieces)), *pieces]
    if byte_pieces:
        vocab += [(f"<0x{b:02X}>", -1000.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_pieces))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return tokenizer


@pytest.mark.parametrize("byte_pieces", [False, True])
def test_counts_equal_the_library_on_ties_and_unknown_characters(byte_pieces):
    rng = random.Random(5)
    for _ in range(20):
        names = {"▁", "a", "b"} | {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(8)}
        names = {n for n in names if "▁" not in n[1:]}
        pieces = tuple((n, -float(rng.randint(1, 3))) for n in sorted(names))
        own, library = token_counts.Counter(pieces, byte_pieces), library_unigram(pieces, byte_pieces)
        if byte_pieces:
            own.unknown = min(-1000.0, *(s for _, s in pieces)) - token_counts.UNKNOWN_COST
        for _ in range(60):
            text = "".join(rng.choice("aab  éx日") for _ in range(rng.randint(0, 12)))
            assert own.text(text) == len(library.encode(text).ids), (text, pieces)


def test_token_counts_of_texts(spark, tmp_path):
    pieces, with_bytes = token_counts.zipf_pieces(PIECES)
    assert with_bytes and len(pieces) > 30_000
    texts = [None, "", " ", "  two  blanks ", prose(1, 50), "ünknown \U0001f600\U0001f600 x", long_text(), "z" * 3000]
    docs = spark.createDataFrame([(k % 5, t, 9) for k, t in enumerate(texts * 2)], "doc_id long, text string, n_tokens int")
    own = token_counts.Counter(pieces, with_bytes)
    rows = token_counts.token_counts(docs, PIECES).collect()
    assert [r.n_tokens for r in rows] == [own.text(t) if t else 0 for t in texts * 2]
    vocab = [*pieces]
    library = library_unigram(vocab, True)
    for text in filter(None, texts[:6]):
        own_low = token_counts.Counter(pieces, True)
        own_low.unknown = -1000.0 - token_counts.UNKNOWN_COST
        assert own_low.text(text) == len(library.encode(text).ids)
    assert token_counts.token_counts(docs.limit(0), PIECES).count() == 0


# ---- Language model ------------------------------------------------------------------------
def test_scores(spark):
    texts = [prose(k, 40) for k in range(60)] + [None, "", "Never-seen words here", long_text(), prose(1, 40)]
    docs = [(k, t, 7.0) for k, t in enumerate(texts)] + [(None, "alpha beta", 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    part = F.when(remainder == 2, "held_out").when(remainder == 3, "apart").otherwise("learn")
    rows = lm_scoring.scored(frame, part).collect()
    assert len(rows) == len(docs)
    tokens = {k: (t or "").encode().lower().split() + [b" end"] for k, t, _ in docs}
    held = {k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(w for k in tokens for w in tokens[k] if not held[k])
    total, distinct = sum(counts.values()), len(counts)
    for r in rows:
        own = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-12) and math.isfinite(r.score)
    assert lm_scoring.scored(frame.limit(0), part).count() == 0
    none = lm_scoring.scored(frame.limit(3), F.lit("held_out")).collect()
    assert all(r.held_out and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(3)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def chain(seed):
        rng = random.Random(seed)
        word, out = rng.choice(WORDS), []
        for _ in range(80):
            out.append(word)
            word = rng.choice(follow[word])
        return " ".join(out)

    frame = spark.createDataFrame([(k, chain(k)) for k in range(200)], "doc_id long, text string")
    part = F.when(F.col("doc_id") % 7 == 2, "held_out").when(F.col("doc_id") % 7 == 3, "apart").otherwise("learn")
    held = lm_scoring.scored(frame, part).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > 0.6 * held[1]


@pytest.mark.parametrize("few", [0, 1000])
def test_weights_equal_plain_rounds_on_exact_estimates(spark, monkeypatch, few):
    monkeypatch.setattr(lm_scoring, "FEW_TALLIES", few)
    rng = random.Random(5)
    rows = [(k, rng.random() ** 3, rng.random() ** 4, rng.randint(1, 9)) for k in (0, 2, 3, 7) for _ in range(50)]
    rows += [(7, 0.0, 0.0, 3), (0, 0.0, 0.2, 1)]
    uniform = 0.001

    def fit(chosen, weights):
        for _ in range(lm_scoring.ROUNDS):
            sums = [0.0] * 3
            for _, two, one, n in chosen:
                shares = [w * e for w, e in zip(weights, (two, one, uniform), strict=True)]
                sums = [s + n * x / sum(shares) for s, x in zip(sums, shares, strict=True)]
            even, size = lm_scoring.EVEN, sum(r[3] for r in chosen)
            weights = [s / size * (1 - 3 * even) + even for s in sums]
        return weights

    common = fit(rows, [0.4, 0.5, 0.1])
    frame = spark.createDataFrame(rows, "kind int, two double, one double, n long").coalesce(2)
    got = lm_scoring.learned_weights(frame, uniform)
    for k in (1, 2, 3, 7):
        own = fit([r for r in rows if r[0] == k], common) if k != 1 else common
        assert list(got[k]) == pytest.approx(own, rel=1e-9)


def test_small_shards_and_chunks_agree(spark, monkeypatch):
    frame = spark.createDataFrame([(k, prose(k, 40)) for k in range(40)], "doc_id long, text string")
    part = F.when(F.col("doc_id") % 7 == 3, "apart").otherwise("learn")

    def scores():
        return sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in lm_scoring.scored(frame, part).collect())

    whole = scores()
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 100)
    assert scores() == whole


# ---- Jaccard join ----------------------------------------------------------------------------
def brute_components(docs):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if len(words) < 3:
            return frozenset([tuple(words)] if words else [])
        return frozenset(zip(words, words[1:], words[2:], strict=False))

    sets = [(k, shingles(t)) for k, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, one) in enumerate(sets):
        for b, (_, two) in enumerate(sets[:a]):
            common = len(one & two)
            if one and 100 * common >= 90 * (len(one) + len(two) - common):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for at, (k, _) in enumerate(sets):
        groups[root(at)].append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return sorted(((k, len(s), least[root(at)]) for at, (k, s) in enumerate(sets)), key=repr)


def near_copies():
    rng, docs = random.Random(11), []
    many = [f"w{i}" for i in range(400)]
    for family in range(25):
        words = [rng.choice(many) for _ in range(rng.choice([1, 2, 3, 5, 11, 14, 20, 25, 33, 60, 150, 400]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                at, kind = rng.randrange(len(copy) + 1), rng.choice("ird")
                if kind == "i":
                    copy.insert(at, rng.choice(many))
                elif copy and at < len(copy):
                    copy[at : at + 1] = [rng.choice(many)] if kind == "r" else []
            text = " ".join(copy)
            docs.append((len(docs) * 3 % 1009, text.upper() if family % 2 else text))
    docs += [(2000, None), (2001, ""), (2002, " \n "), (2003, "One"), (2004, "one"), (2005, "two words"), docs[0], docs[1]]
    docs += [(None, docs[2][1]), (2006, long_text()), (2007, long_text() + " more")]
    return docs


def test_components_equal_brute_force(spark):
    docs = near_copies()
    frame = spark.createDataFrame([(*d, 1, b"x") for d in docs], "doc_id long, text string, n_shingles int, node binary")
    rows = jaccard_join.linked_components(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_components(docs)
    assert jaccard_join.linked_components(frame.limit(0)).count() == 0


def test_small_units_and_shuffled_texts_agree(spark, monkeypatch):
    docs = near_copies()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "UNIT", 3)
    monkeypatch.setattr(jaccard_join, "FIRST_CLOSEST", 1)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    rows = jaccard_join.linked_components(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr) == brute_components(docs)


def test_linked_sets_share_a_list():
    rng = random.Random(2)
    for _ in range(300):
        size = rng.randint(10, 300)
        base = [rng.getrandbits(64) for _ in range(size)]
        other = base[rng.randint(0, size // 19) :]
        import numpy as np

        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, other))
        if len(b) >= jaccard_join.least_overlap(len(a), len(b)):
            assert set(jaccard_join.block_lists(a)) & set(jaccard_join.block_lists(b))


def brute_groups(docs, ngram, least):
    """Sorted (key, least key of its group) of texts with words, at any n-gram and similarity."""
    sets = []
    for key, text in docs:
        words = (text or "").encode().lower().split()
        size = min(ngram, len(words))
        grams = frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()
        sets.append((key, grams))
    group = list(range(len(sets)))
    for a, (_, one) in enumerate(sets):
        for b, (_, two) in enumerate(sets[:a]):
            common = len(one & two)
            if one and least[1] * common >= least[0] * (len(one) + len(two) - common):
                group = [group[b] if g == group[a] else g for g in group]
    smallest = {g: min(k for (k, _), h in zip(sets, group, strict=True) if h == g) for g in set(group)}
    return sorted((k, smallest[g]) for (k, _), g in zip(sets, group, strict=True))


@pytest.mark.parametrize("unit", [1000, 3])
def test_other_shingles_and_thresholds_equal_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    docs = [(k, t) for k, t in dict(near_copies()).items() if k is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    measure = jaccard_join.Measure(ngram=5, numerator=4, denominator=5)
    rows = jaccard_join.linked_components(frame, measure=measure).collect()
    expected = brute_groups(docs, 5, (4, 5))
    assert sorted((r.doc_id, r.component_id) for r in rows) == expected
    assert expected != brute_groups(docs, 3, (9, 10))
    with pytest.raises(ValueError):
        jaccard_join.Measure(numerator=2, denominator=3)


# ---- Quality rules -----------------------------------------------------------------------------
def brute_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen, covered, lines, repeated = Counter(windows), set(), set(), 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered |= {at, at + 1, at + 2}
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            repeated += line in lines
            lines.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, repeated, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", "one", "a b c a b c", "x\nx\nx \n", "é日\U0001f600 #*$ a\x0bb\x1cc\x85d", long_text(), "w " * 200]
    texts += ["".join(rng.choice("ab c\n#\t") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t, "en", "s", 5) for k, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_words int")
    rows = quality_rules.judged(docs.unionByName(docs)).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == brute_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_fences_follow_their_group(spark):
    many = [f"w{i}" for i in range(900)]
    rows = []
    for k in range(60):
        clean = prose(k, 120, many)
        rows.append((k, clean, "en", "plain"))
        rows.append((1000 + k, " | ".join(clean.split()), None, "tables"))
    rows.append((2000, " | ".join(prose(99, 120, many).split()), "en", "plain"))
    rows.append((2001, "#$%* " * 40 + prose(98, 120, many), "en", "plain"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert all(out[k].kept and out[1000 + k].kept for k in range(60))
    assert not out[2000].kept and out[2000].failed_rates == ["symbol_rate"]
    assert not out[2001].kept


def brute_kept(rows, good_ids, spreads=3.0, deviations=3.0):
    """Verdicts of (id, text, lang, source) with exact quantiles in place of sketches."""
    counted = []
    for key, text, lang, source in rows:
        words, chars, symbols, dups, repeats = brute_counts(text)
        lines = sum(bool(re.search("[^\x20\x09-\x0d]", line)) for line in (text or "").split("\n"))
        base_failed = words < 50 or 100 * repeats > 50 * words
        parts = {"symbol_rate": (symbols, words), "dup_line_rate": (dups, lines), "repeat_rate": (repeats, words), "word_length": (chars, words)}
        counted.append((key, lang, source, base_failed, parts))

    def quantile(values, rank):
        ordered = sorted(values)
        return ordered[max(0, math.ceil(rank * len(ordered)) - 1)]

    def rate(parts, name):
        top, bottom = parts[name]
        return top / bottom if bottom else 0.0

    verdicts, fences = {}, {}
    for key, lang, source, base_failed, parts in counted:
        kept = not base_failed
        for name, (top, bottom) in parts.items():
            if not kept:
                break
            if (lang, source, name) not in fences:
                group = [rate(p, name) for _, g, s, b, p in counted if (g, s, b) == (lang, source, False)]
                good = [rate(p, name) for k, g, _, b, p in counted if g == lang and not b and k in good_ids]
                upper = quantile(good, 0.99)
                fences[lang, source, name] = upper + spreads * max(upper - quantile(group, 0.5), 0.0)
            event = 6 if name == "repeat_rate" else 1
            allowed = fences[lang, source, name] * bottom / event
            kept = top / event <= allowed + deviations * math.sqrt(allowed) + deviations**2
        verdicts[key] = kept
    return verdicts, fences


def test_verdicts_equal_exact_quantiles_on_the_given_tables(spark):
    """The sketches decide: no rate has a cutoff of its own, and groups differ."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    verdicts, fences = brute_kept(rows, good)
    judged = quality_rules.judged(docs, labels=labels)
    got = {r.doc_id: r.kept for r in judged.select("doc_id", "kept").collect()}
    assert got == verdicts
    lengths = sorted({v for (_, _, name), v in fences.items() if name == "word_length"})
    assert lengths[-1] - lengths[0] > 0.5  # words that one group lets pass fail in another
    assert not any(got[k] for k in {r.doc_id for r in labels.filter("quality = 0").collect()})
    assert sum(got[k] for k in good) >= 0.97 * sum(brute_counts(t)[0] >= 50 for k, t, *_ in rows if k in good)


def test_equal_rates_get_the_verdict_of_their_group(spark):
    """Groups of the given tables, in one of which all words are longer."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IN ('en', 'de')")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    longer = F.when(F.col("lang") == "de", F.regexp_replace("text", r"(\pL{4,})", "$1$1")).otherwise(F.col("text"))
    docs = docs.withColumn("text", longer)
    sample = docs.filter("lang = 'de'").join(labels.filter("quality = 1"), "doc_id", "left_semi")
    sample = sample.orderBy("doc_id").limit(5)
    moved = sample.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.lit("en"))
    both = docs.unionByName(moved)
    got = {r.doc_id: r for r in quality_rules.judged(both, labels=labels).collect()}
    ids = [r.doc_id for r in sample.collect()]
    checked = [i for i in ids if got[i].n_words >= 300]
    assert checked and all(got[i].kept for i in checked)
    assert all(got[10**6 + i].failed_rates == ["word_length"] for i in checked)


# ---- Chat --------------------------------------------------------------------------------------
def test_snapshots_collapse(spark):
    def talk(conv, *texts):
        return [(conv, n, ("user", "assistant")[n % 2], t, 1) for n, t in enumerate(texts)]

    rows = talk(1, "hi", "hello") + talk(2, "hi", "hello", "more") + talk(3, "hi", "hello", "other", "end")
    rows += talk(4, "hi", "hello", "more") + talk(5, "hello") + talk(6, "hi there") + talk(7, "hi", None) + talk(8, "hi", "")
    rows += [(9, 3, "user", "hi", 1), (9, 4, "assistant", "hello", 1)]  # other numbers, same turns
    rows += [(10, None, None, "<|user|> trick", 1), (10, None, None, "<|user|> trick", 1), (None, 0, "user", "x" * 5000, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    out = {r.conv_id: r for r in chat_format.formatted(frame.unionByName(frame.filter("conv_id = 3"))).collect()}
    assert set(out) == {2, 3, 5, 6, 7, 8, 10, None}
    assert (out[2].n_copies, out[2].n_turns, out[3].n_turns, out[10].n_turns) == (2, 3, 4, 1)
    assert out[5].rendered == "<|user|>\nhello\n<|end|>\n"
    assert out[10].rendered == "<|unknown|>\n< |user|> trick\n<|end|>\n"
    assert out[2].rendered.count("<|end|>") == 3
    assert chat_format.formatted(frame.limit(0)).count() == 0


# ---- HTML --------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body class="has-sidebar"><nav><ul><li><a href=/>Home</a></ul></nav><header><p>Site name here</p></header>
<!-- <p>not this</p> --><div class="cookie-notice">We use cookies here</div><main><article><h1>A &amp; B</h1>
<p>First <b>bo</b>ld  para&shy;graph&nbsp;of the&#32;text.<br>Next line<p>Second one &lt;kept&gt; &am
<aside>See also these other things</aside><div class='advert'>Buy this now or never</div><form><label>Mail</label></form>
<table><tr><td>cell one<td>cell two</table><section class=comments><article><p>I like it a lot really</p></article></section>
<p>Last.</article></main><footer>&copy; us</footer></body></html>"""


def test_main_text():
    weights = html_extract.weights_from({})
    expected = "A & B First bold para\u00adgraph of the text. Next line Second one <kept> &am cell one cell two Last."
    assert html_extract.main_text(PAGE, weights) == expected
    soup = '<div id=menu><a href=x>Home</a></div><div class=content><h2>Title</h2>Some words of text<p>and a paragraph of it</div><div class=footer>end of page</div>'
    assert html_extract.main_text(soup, weights) == "Title Some words of text and a paragraph of it"
    for broken in ("", "<", "<p", "</p>", "<a href='", "plain words", "<!--", "<script>x", "<![CDATA[x]]>"):
        assert isinstance(html_extract.main_text(broken, weights), str)
    assert html_extract.main_text("plain words", weights) == "plain words"


def test_hostile_pages_are_read_in_linear_time():
    pieces = ["<div>", "<a ", "<!--", "<b><p>x", "<a b='>", '<a b=">x', "<", "</p>", "<script>", "&amp", "<ul><li>", "<a =", "</a "]
    weights = html_extract.weights_from({})
    started = time.perf_counter()
    for piece in pieces:
        html = piece * (1_000_000 // len(piece))
        html_extract.main_text(html, weights)
        html_extract.main_text(html + ">", weights)
    assert time.perf_counter() - started < 120  # a quadratic reader takes hours
    cases = {
        "<p>a < b and c > d": "a < b and c > d",
        "<p title=it's>x</p> y": "x y",
        '<p a="x>y">z': "z",
        "<p>x<!-- <p>no --> y": "x y",
        "<p>x<!doctype y>z<?php a ?>b": "xzb",
        "<script>a</scripty><p>no</script ><p>yes": "yes",
        "<p>a<br/>b</ p>c<p": "a bc<p",
        "<P CLASS=ad>x</P><p>y": "y",
    }
    for html, text in cases.items():
        assert html_extract.main_text(html, weights) == text, html


def test_best_region():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 12))]
        first, end = html_extract.best_region(scores)
        sums = [sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)]
        assert sum(scores[first:end]) == pytest.approx(max(sums))


def test_pages(spark):
    pages = [(k, "http://a.b/", PAGE.replace("Last.", f"Last {k}. " + prose(k, 30)), "mine") for k in range(20)]
    pages += [(30, None, None, "x"), (31, "", "", "x"), (32, "u", "<p>" + long_text(), "x"), pages[0]]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    labelled = frame.filter("page_id < 10").withColumn("article", F.lit("A & B First"))
    weights = html_extract.learned_weights(labelled)
    assert all(v < 0 for k, v in weights.items() if k.startswith("tag"))
    rows = html_extract.extracted(frame, weights).collect()
    assert len(rows) == len(pages) and all(r.text is not None for r in rows)
    by_id = {r.page_id: r.text for r in rows}
    assert (by_id[30], by_id[31]) == ("", "") and by_id[32] == " ".join(long_text().split())
    assert by_id[3].endswith("Last 3. " + prose(3, 30)) and "cookies" not in by_id[3]
    assert html_extract.learned_weights(labelled.limit(0)) == html_extract.weights_from({})
    assert html_extract.extracted(frame.limit(0), weights).count() == 0


# ---- WARC --------------------------------------------------------------------------------------
def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip_of_captures(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = [(5, "http://a/x y\r\nz", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "http://b/", "<p>same</p>"),
             (1, "http://c/é", None), (2, "", ""), (7, "http://d/", "é\r\n\r\nWARC/1.1\r\n" * 3), (8, "http://d/", long_text()),
             (7, "http://d/", "é\r\n\r\nWARC/1.1\r\n" * 3), (None, "http://e/", "<p>same</p>"), (11, "http://e/", long_text())]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, response string")
    rows = warc.round_trip(frame, least_bytes=least).collect()
    first = defaultdict(list)
    for page, _, html in pages:
        if page is not None:
            first[html or ""].append(page)
    expected = []
    for page, url, html in pages:
        data = (html or "").encode()
        origin = min(first[html or ""], default=None)
        revisit = page is not None and len(data) >= least and page != origin
        expected.append((page, len(data), b32(data), "revisit" if revisit else "response", origin if revisit else None))
    got = [(r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.kind, r.refers_to) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    for r in rows:
        assert r.request.record_id and r.metadata.record_id
        if r.response.kind == "response":
            assert r.response.intact and b32(bytes(r.response.payload)) == r.response.payload_digest
    assert {r.url for r in rows if r.page_id in (3, 2)} == {None, ""}
    assert warc.round_trip(frame.limit(0)).count() == 0


# ---- Byte BPE ------------------------------------------------------------------------------------
def test_ids_equal_the_library(spark):
    import tiktoken

    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    alphabets = ["ab ", "aé ñ\n", "日本語a b", "'st ll", "\U0001f600\u200d a", "0١²x ", "\x85\xa0  a\t", "aaa", "\x00\x1c'"]
    texts = [None, "", " ", "aaaa" * 500, "<|endoftext|>", long_text(), "ab" * 2000]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(40)]
    docs = spark.createDataFrame([(k % 50, t, [1]) for k, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    tokens = byte_bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    rows = byte_bpe.decoded(tokens, RANKS).collect()
    assert [r.text for r in rows] == texts
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")
    assert byte_bpe.decoded(byte_bpe.encoded(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(byte_bpe.decoded(nulls, RANKS).first().decoded) == b""


def test_merges_equal_the_plain_rule():
    ranks = {bytes([b]): b for b in range(256)}
    rng = random.Random(7)
    for _ in range(40):
        a, b = rng.choice(list(ranks)), rng.choice([k for k in ranks if k[0] in b"abc"])
        ranks.setdefault((a if a[0] in b"abc" else b"a") + b, len(ranks))

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks[x + y], at) for at, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(500):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        if piece not in ranks:
            assert byte_bpe.merged(piece, ranks) == plain(piece)
