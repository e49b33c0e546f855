"""Language-model scores by deleted interpolation of bigrams.

The probability of a word after a context mixes the maximum-likelihood bigram and unigram
estimates with the uniform one. The mixture weights depend on how often the context was seen
(in powers of two) and are learned by expectation-maximisation on documents whose counts are
deleted from the estimates meanwhile; the final estimates use all learning documents.

Texts are encoded once into chunks of some million tokens. A chunk sends each distinct key
(word or bigram hash) once, packed, to the key's shard; shards sum the counts of all chunks
and answer each chunk in the order it asked. So what is shuffled grows with the distinct keys
per chunk, a frequent key weighs one entry per chunk, and neither counts nor texts are ever
collected. The number of shards follows the number of tokens.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billwright.session import stored

CHUNK_TOKENS = 2_000_000
SHARD_TOKENS = 2_000_000
WORDS_REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Hashes of the text's begin and end: of strings with a blank, so of no word.
BEGIN = xxhash.xxh3_64_intdigest(b" begin")
END = xxhash.xxh3_64_intdigest(b" end")
#: Context-frequency classes: 0, 1, 2-3, 4-7, ... ; the last takes all larger ones.
CLASSES = 40
ROUNDS = 60
#: So few tallies (28 bytes each, counted first) are fitted in the driver, with the same result.
FEW_TALLIES = 200_000
#: Share of each weight that is spread evenly, so that no weight is zero.
EVEN = 1e-4

CHUNK_SCHEMA = (
    "chunk string, part string, n_tokens long, n_learning long, doc_ids array<long>, "
    "lengths array<int>, learning array<boolean>, words binary, tokens binary"
)
KEY_SCHEMA = "chunk string, shard int, width int, keys binary, seen binary, apart binary"
ANSWER_SCHEMA = "chunk string, shard int, width int, seen binary, apart binary, new_words long"
SCORE_SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
)


def pack(values: np.ndarray) -> bytes:
    """A number array as compressed bytes, the bytes of equal weight side by side."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# ---- Chunks ------------------------------------------------------------------------
class _Chunk:
    """Collects documents of one part until it is full."""

    def __init__(self, part: str):
        self.part, self.ids, self.lengths, self.learning, self.hashes, self.size = part, [], [], [], [], 0

    def add(self, doc_id, learning: bool, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(hashes))
        self.learning.append(learning)
        self.hashes.append(hashes)
        self.size += len(hashes)

    def batch(self) -> pa.RecordBatch:
        begin = np.array([BEGIN], np.uint64)
        words, tokens = np.unique(np.concatenate([*self.hashes, begin]), return_inverse=True)
        taught = sum(n for n, own in zip(self.lengths, self.learning, strict=True) if own)
        row = {
            "chunk": uuid.uuid4().hex,
            "part": self.part,
            "n_tokens": self.size,
            "n_learning": taught,
            "doc_ids": self.ids,
            "lengths": self.lengths,
            "learning": self.learning,
            "words": pack(np.diff(words, prepend=np.uint64(0))),
            "tokens": pack(tokens[:-1].astype(np.int32)),
        }
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        kinds += [pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        fields = [pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(fields, names=list(row))


def encoded(docs: DataFrame) -> DataFrame:
    """Stored chunks (``CHUNK_SCHEMA``) of documents (doc_id, text, part).

    ``part`` is ``held_out`` (scored only), ``apart`` (learned from; deleted while the
    weights are learned) or ``learn``. Parts ``apart`` have chunks of their own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        open_chunks: dict[str, _Chunk] = {}
        for batch in batches:
            columns = zip(batch.column("doc_id"), batch.column("text"), batch.column("part"), strict=True)
            for doc_id, text, part in columns:
                # lower() of bytes changes A-Z alone, split() cuts at the ASCII blanks
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                hashes = np.empty(len(words) + 1, np.uint64)
                for at, word in enumerate(words):
                    value = known.get(word)
                    if value is None:
                        value = xxhash.xxh3_64_intdigest(word)
                        if len(word) <= LONGEST_REMEMBERED:
                            if len(known) >= WORDS_REMEMBERED:
                                known.clear()
                            known[word] = value
                    hashes[at] = value
                hashes[-1] = END
                own = "apart" if part.as_py() == "apart" else "other"
                chunk = open_chunks.setdefault(own, _Chunk(own))
                chunk.add(doc_id.as_py(), part.as_py() != "held_out", hashes)
                if chunk.size >= CHUNK_TOKENS:
                    yield open_chunks.pop(own).batch()
        for chunk in open_chunks.values():
            yield chunk.batch()

    return stored(docs.select("doc_id", "text", "part").mapInArrow(encode, CHUNK_SCHEMA), "lm-chunks")


class _Opened:
    """A chunk's arrays: per token its word, context, bigram and whether it is learned from."""

    def __init__(self, row):
        self.words = np.cumsum(unpack(row.words, np.uint64), dtype=np.uint64)
        self.tokens = unpack(row.tokens, np.int32)
        lengths = np.asarray(row.lengths, np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.begin = int(np.searchsorted(self.words, np.uint64(BEGIN)))
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[self.starts] = self.begin
        self.learning = np.repeat(np.asarray(row.learning, bool), lengths)
        self.learning_docs = int(np.asarray(row.learning, bool).sum())
        keys = mixed(mixed(self.words[self.contexts]) + self.words[self.tokens])
        self.bigrams, self.bigram_of = np.unique(keys, return_inverse=True)


def _asked(chunks: DataFrame, shards: int) -> DataFrame:
    """Keys (``KEY_SCHEMA``) of all chunks, by shard, with the chunk's own counts."""
    bits = shards.bit_length() - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, shards, dtype=np.uint64) << np.uint64(64 - bits) if bits else []
        for batch in batches:
            for row in batch.to_pandas().itertuples():
                chunk, rows = _Opened(row), defaultdict(list)
                seen = np.bincount(chunk.tokens[chunk.learning], minlength=len(chunk.words))
                seen[chunk.begin] = chunk.learning_docs  # as often as the begin is a context
                both = np.bincount(chunk.bigram_of[chunk.learning], minlength=len(chunk.bigrams))
                apart = row.part == "apart"
                for width, keys, counts in ((1, chunk.words, seen), (2, chunk.bigrams, both)):
                    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    for shard in range(shards):
                        part = slice(cuts[shard], cuts[shard + 1])
                        if part.start == part.stop:
                            continue
                        rows["chunk"].append(row.chunk)
                        rows["shard"].append(shard)
                        rows["width"].append(width)
                        rows["keys"].append(pack(np.diff(keys[part], prepend=np.uint64(0))))
                        rows["seen"].append(pack(counts[part]))
                        rows["apart"].append(pack(counts[part] if apart else counts[part] * 0))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                arrays = [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=list(rows))

    return chunks.mapInArrow(ask, KEY_SCHEMA)


def _answered(asked: DataFrame) -> DataFrame:
    """Stored sums over all chunks for each asked key (``ANSWER_SCHEMA``)."""

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, rows in frame.groupby("width", sort=False):
            keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = {}
            for name in ("seen", "apart"):
                counts = np.concatenate([unpack(v) for v in rows[name]])
                sums[name] = np.zeros(len(distinct), np.int64)
                np.add.at(sums[name], place, counts)
            new = int(((sums["seen"] > 0) & (distinct != np.uint64(BEGIN))).sum()) if width == 1 else 0
            start = 0
            for chunk, shard, own in zip(rows["chunk"], rows["shard"], keys, strict=True):
                part = place[start : start + len(own)]
                start += len(own)
                out.append((chunk, shard, width, pack(sums["seen"][part]), pack(sums["apart"][part]), new))
                new = 0  # the shard's distinct words are told once
        names = ["chunk", "shard", "width", "seen", "apart", "new_words"]
        return pd.DataFrame(out, columns=names)

    return stored(asked.groupBy("shard").applyInPandas(total, ANSWER_SCHEMA), "lm-answers")


def _counts(answers: pd.DataFrame, width: int, name: str) -> np.ndarray:
    rows = answers[answers["width"] == width].sort_values("shard")
    return np.concatenate([unpack(v) for v in rows[name]])


def classes_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], CLASSES - 1)


# ---- Weights and scores --------------------------------------------------------------
def learned_weights(tallies: DataFrame, uniform: float) -> np.ndarray:
    """Weights (class, [bigram, unigram, uniform]) by expectation-maximisation.

    ``tallies`` (kind, two, one, n) counts held-out tokens by context class and by their exact
    bigram and unigram estimates. Each round is an aggregate over them: three sums a class
    reach the driver, or all of FEW_TALLIES rows once. Classes without tokens take the
    weights of all classes together.
    """
    estimates = (F.col("two"), F.col("one"), F.lit(uniform))
    few = tallies.toPandas() if tallies.count() <= FEW_TALLIES else None

    def fitted_here(start: dict[int, np.ndarray], kind: np.ndarray) -> dict[int, np.ndarray]:
        probabilities = np.stack([few["two"], few["one"], np.full(len(few), uniform)], axis=1)
        n, done = few["n"].to_numpy(float), {}
        for k, weights in start.items():
            own = kind == k
            for _ in range(ROUNDS):
                shares = probabilities[own] * weights
                shares /= shares.sum(axis=1, keepdims=True)
                weights = (shares * n[own, None]).sum(axis=0) / n[own].sum()
                weights = weights * (1 - 3 * EVEN) + EVEN
            done[k] = weights
        return done

    def fitted(start: dict[int, np.ndarray], kind) -> dict[int, np.ndarray]:
        weights = start
        for _ in range(ROUNDS):
            ordered = sorted(weights)
            at = F.array_position(F.array(*map(F.lit, ordered)), F.col("k")).cast("int")
            tables = (F.array(*(F.lit(float(weights[k][i])) for k in ordered)) for i in range(3))
            own = [F.element_at(table, at) for table in tables]
            shares = [w * e for w, e in zip(own, estimates, strict=True)]
            whole = shares[0] + shares[1] + shares[2]
            sums = tallies.withColumn("k", kind).groupBy("k").agg(
                F.sum("n").alias("n"), *(F.sum(F.col("n") * x / whole).alias(f"s{i}") for i, x in enumerate(shares))
            )
            weights = {
                r.k: np.array([r.s0, r.s1, r.s2]) / r.n * (1 - 3 * EVEN) + EVEN for r in sums.collect()
            }
        return weights

    common = np.array([0.4, 0.5, 0.1])
    weights = np.tile(common, (CLASSES, 1))
    if few is None:
        kinds = [r.kind for r in tallies.select("kind").distinct().collect()]
        common = fitted({0: common}, F.lit(0))[0]
        own = fitted(dict.fromkeys(kinds, common), F.col("kind"))
    elif len(few):
        common = fitted_here({0: common}, np.zeros(len(few), int))[0]
        own = fitted_here(dict.fromkeys(few["kind"].unique(), common), few["kind"].to_numpy())
    else:
        own = {}
    weights[:] = common
    for k, values in own.items():
        weights[k] = values
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]  # an unseen context
    return weights


def _estimates(chunk: _Opened, words: np.ndarray, bigrams: np.ndarray, total: int):
    """Per token: context count, bigram estimate, unigram estimate."""
    context = words[chunk.contexts]
    with np.errstate(divide="ignore", invalid="ignore"):
        two = np.where(context > 0, bigrams[chunk.bigram_of] / context, 0.0)
    one = words[chunk.tokens] / max(total, 1)
    return context, two, one


def _tallied(chunks: DataFrame, answers: DataFrame, total: int) -> DataFrame:
    """Stored (kind, two, one, n): tokens of the parts apart by class and exact estimates."""

    def tally(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["kind", "two", "one", "n"]
        if left.empty or right.empty:
            return pd.DataFrame([], columns=names)
        chunk = _Opened(next(left.itertuples()))
        words = _counts(right, 1, "seen") - _counts(right, 1, "apart")
        bigrams = _counts(right, 2, "seen") - _counts(right, 2, "apart")
        context, two, one = _estimates(chunk, words, bigrams, total)

        rows = pd.DataFrame({"kind": classes_of(context), "two": two, "one": one})
        return rows.groupby(names[:3], sort=False).size().reset_index(name="n")

    rows = (
        chunks.filter("part = 'apart'")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(tally, "kind int, two double, one double, n long")
        .groupBy("kind", "two", "one")
        .agg(F.sum("n").alias("n"))
    )
    return stored(rows, "lm-tallies")


def scored(docs: DataFrame, part, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``SCORE_SCHEMA`` plus ``train_tokens``.

    ``part`` is a column of the parts named at ``encoded``. Words are the runs without
    blanks, A-Z lower-cased; each text ends with one more token. Null and empty texts have
    only that. ``base_score`` is the unigram score with one added to each count, ``score``
    the model's log10 probability. Repeated rows are scored each and count each; a null part
    counts as ``learn``. Without learning documents all tokens are equally likely. Only
    three sums a class and round, or FEW_TALLIES rows, go to the driver.
    """
    named = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(part, F.lit("learn")).alias("part"),
    )
    chunks = encoded(named)
    size = chunks.agg(
        F.sum("n_tokens").alias("all"),
        F.sum("n_learning").alias("learning"),
        F.sum(F.when(F.col("part") == "apart", F.col("n_learning"))).alias("apart"),
    ).first()
    tokens, total, deleted = size["all"] or 0, size["learning"] or 0, size["apart"] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1, tokens / SHARD_TOKENS))))
    answers = _answered(_asked(chunks, shards))
    distinct = answers.agg(F.sum("new_words")).first()[0] or 0
    uniform = 1 / (distinct + 1)
    apart = answers.join(chunks.filter("part = 'apart'").select("chunk"), "chunk", "left_semi")
    weights = learned_weights(_tallied(chunks, apart, total - deleted), uniform)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples())
        chunk = _Opened(row)
        words, bigrams = _counts(right, 1, "seen"), _counts(right, 2, "seen")
        context, two, one = _estimates(chunk, words, bigrams, total)
        own = weights[classes_of(context)]
        logs = np.log10(own[:, 0] * two + own[:, 1] * one + own[:, 2] * uniform)
        seen = words[chunk.tokens]
        base = np.log10((seen + 1) / (total + distinct + 1))
        return pd.DataFrame(
            {
                "doc_id": pd.array(row.doc_ids, dtype="Int64"),
                "held_out": [not own for own in row.learning],
                "n_tokens": row.lengths,
                "n_known": np.add.reduceat((seen > 0).astype(np.int64), chunk.starts),
                "base_score": np.add.reduceat(base, chunk.starts),
                "score": np.add.reduceat(logs, chunk.starts),
            }
        )

    rows = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, SCORE_SCHEMA)
    return rows.withColumn("train_tokens", F.lit(total).cast("long"))
