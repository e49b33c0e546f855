"""Jaccard join of word n-gram sets at a high threshold, and its connected components.

Size-aware and heavy-light. Documents of equal sets are one node. *Light* nodes (small sets)
enumerate fixed-size subsets: for each pair of sizes, the subsets of the least overlap that
makes a link, so nodes that meet in a subset are linked without further checks. *Heavy* nodes
scan inverted lists: a set is cut into more blocks (by element hash) than a linked pair has
differing elements, so a linked pair shares a whole block, and the lists are kept by block
content. Where light ends is chosen by the rows both ways would make for the sizes at hand.

Lists are never expanded to pairs. Every member is compared with its list's first member;
linked nodes are merged; only lists that still hold several components are compared further,
in blocks of bounded size, on odd sketches whose distance is a lower bound of the true one,
and the closest pairs of each two components go on to the exact check, more of them in each
round, until no allowed pair is left untested. Lists without such pairs are not looked at again.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billwright.session import stored

#: Classes of set sizes grow by this factor; a class shares its number of blocks.
CLASS_FACTOR = 1.5
#: Blocks per element that a pair may differ in; above 1, so that empty blocks don't matter.
SPARE = 1.3
LARGEST_LIGHT = 40
#: Members of a list that are compared in one go; longer lists are cut into such blocks.
UNIT = 1000
ROWS_PER_TASK = 20_000
#: A unit first gives a spanning forest of its components; in the next round, so many pairs of
#: each two components that are still apart, then 16 times as many, until none is left.
FIRST_CLOSEST = 50
WORDS_REMEMBERED, LONGEST_REMEMBERED = 200_000, 64
#: Node lists (under 50 bytes a row) are broadcast up to so many rows, counted first; longer
#: ones meet the texts in a shuffle.
BROADCAST_ROWS = 400_000

SET_SCHEMA = "doc_id long, mark long, n_shingles long, node binary, sketch binary"


@dataclass(frozen=True)
class Measure:
    """N-grams of ``ngram`` words; linked sets have numerator * union <= denominator *
    intersection.

    The least similarity is above 1 / CLASS_FACTOR, so that linked sets are at most one class
    apart.
    """

    ngram: int = 3
    numerator: int = 9
    denominator: int = 10

    def __post_init__(self):
        if self.ngram < 1 or not self.denominator < CLASS_FACTOR * self.numerator:
            raise ValueError(f"least similarity must exceed 1 / {CLASS_FACTOR}, n-grams need a word")
        if self.numerator > self.denominator:
            raise ValueError("least similarity must not exceed 1")


#: Fixed values of ``op5_jaccard_join``.
TRIGRAMS = Measure()


def least_overlap(a: int, b: int, measure: Measure = TRIGRAMS) -> int:
    """Fewest common elements of linked sets of sizes a and b."""
    return -(-measure.numerator * (a + b) // (measure.numerator + measure.denominator))


def most_apart(a, b, measure: Measure = TRIGRAMS):
    """Most differing elements of linked sets of sizes a and b (numbers or arrays)."""
    apart = measure.denominator - measure.numerator
    return apart * (a + b) // (measure.numerator + measure.denominator)


def largest_partner(n: int, measure: Measure = TRIGRAMS) -> int:
    return measure.denominator * n // measure.numerator


@lru_cache(maxsize=200_000)
def size_class(n: int) -> int:
    k = max(0, int(math.log(n) / math.log(CLASS_FACTOR)))
    while CLASS_FACTOR ** (k + 1) <= n:
        k += 1
    while k and CLASS_FACTOR**k > n:
        k -= 1
    return k


@lru_cache(maxsize=10_000)
def blocks_of(k: int, measure: Measure = TRIGRAMS) -> int:
    largest = math.ceil(CLASS_FACTOR ** (k + 1)) - 1
    return int(SPARE * most_apart(largest, largest, measure)) + 2


@lru_cache(maxsize=1000)
def light_pairs(
    n: int, boundary: int, measure: Measure = TRIGRAMS
) -> tuple[tuple[int, int, int], ...]:
    """(smaller size, larger size, overlap) of the linkable pairs of a light set of size n."""
    pairs = []
    for other in range(1, boundary + 1):
        a, b = min(n, other), max(n, other)
        if least_overlap(a, b, measure) <= a:
            pairs.append((a, b, least_overlap(a, b, measure)))
    return tuple(pairs)


def light_rows(n: int, boundary: int, measure: Measure = TRIGRAMS) -> int:
    return sum(math.comb(n, c) for _, _, c in light_pairs(n, boundary, measure))


def heavy_rows(n: int, measure: Measure = TRIGRAMS) -> int:
    """List rows of a heavy set, and the elements to send for an exact check."""
    classes = {size_class(n), size_class(largest_partner(n, measure))}
    return sum(blocks_of(k, measure) for k in classes) + n


def boundary_of(sizes: dict[int, int], measure: Measure = TRIGRAMS) -> int:
    """Largest light size: the one that makes the fewest rows for so many sets by size."""

    def cost(boundary: int) -> int:
        total = 0
        for n, count in sizes.items():
            total += count * light_rows(n, boundary, measure) if n <= boundary else 0
            total += count * heavy_rows(n, measure) if largest_partner(n, measure) > boundary else 0
        return total

    return min(range(LARGEST_LIGHT + 1), key=cost)


# ---- Sets of texts -----------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """64-bit hashes of the distinct n-grams of a text's words; remembers word hashes."""

    def __init__(self, ngram: int = TRIGRAMS.ngram):
        self.ngram = ngram
        self.known: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        # lower() of bytes changes A-Z alone, and split() cuts at the ASCII blanks
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        found = list(map(self.known.get, words))
        if None in found:
            found = [self._hash(w) if v is None else v for v, w in zip(found, words, strict=True)]
        hashes = np.array(found, np.uint64)
        size = min(self.ngram, len(words))
        total = _mixed(hashes[: len(words) - size + 1] + np.uint64(size))
        for k in range(1, size):
            total = _mixed(total + hashes[k : len(words) - size + 1 + k])
        return np.unique(total)


    def _hash(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.known) >= WORDS_REMEMBERED:
                self.known.clear()
            self.known[word] = value
        return value


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of the set: sets differ in at least as many elements as in bits."""
    bits = 1 << max(3, (2 * len(hashes) - 1).bit_length())
    places = (_mixed(hashes) & np.uint64(bits - 1)).astype(np.int64)
    parity = (np.bincount(places, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").tobytes()


def block_lists(hashes: np.ndarray, measure: Measure = TRIGRAMS) -> list[int]:
    """Keys of the inverted lists that a heavy set stands in.

    Linked sets differ in fewer elements than there are blocks, so a block is equal in both.
    Equal empty blocks say nothing; a set with so many of them that they might be the only
    equal ones is listed under them too.
    """
    size, keys = len(hashes), []
    content = _mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    partner = largest_partner(size, measure)
    apart = most_apart(size, partner, measure)
    for k in sorted({size_class(size), size_class(partner)}):
        blocks = blocks_of(k, measure)
        places = (hashes % np.uint64(blocks)).astype(np.int64)
        sums = np.zeros(blocks, np.uint64)
        np.add.at(sums, places, content)
        filled = np.bincount(places, minlength=blocks) > 0
        if blocks - filled.sum() >= blocks - apart:
            filled[:] = True
        salt = np.arange(blocks, dtype=np.uint64) + np.uint64(k << 32)
        keys.extend(_mixed(_mixed(salt) + sums)[filled].view(np.int64).tolist())
    return keys


def subset_lists(
    hashes: np.ndarray, boundary: int, measure: Measure = TRIGRAMS
) -> tuple[list[int], list[int], list[int]]:
    """Keys of the subsets that a light set enumerates, with the two sizes each is for."""
    keys, smaller, larger = [], [], []
    values = hashes.tolist()
    for a, b, overlap in light_pairs(len(values), boundary, measure):
        for subset in combinations(values, overlap):
            data = np.array([a, b, *subset], np.uint64).tobytes()
            keys.append(xxhash.xxh3_64_intdigest(data) - (1 << 63))
            smaller.append(a)
            larger.append(b)
    return keys, smaller, larger


def node_sets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = TRIGRAMS
) -> DataFrame:
    """(doc_id, mark, n_shingles, node, sketch): a row per document, without texts.

    ``mark`` is the hash of the text; with the key it tells rows apart whose keys are null or
    repeated.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(measure.ngram)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, nodes, sketches = [], [], []
                for value in part.column("__text"):
                    hashes = shingler.hashes(value.as_py())
                    sizes.append(len(hashes))
                    nodes.append(_node_of(hashes))
                    sketches.append(odd_sketch(hashes) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__key"),
                        part.column("__mark"),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(sketches, pa.binary()),
                    ],
                    names=["doc_id", "mark", "n_shingles", "node", "sketch"],
                )

    return _named(docs, key, text).mapInArrow(read, SET_SCHEMA)


def mark_of(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string"))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    named = (F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    return docs.select(*named, mark_of(text).alias("__mark"))


# ---- Links -------------------------------------------------------------------------
def _texts_of(docs: DataFrame, owners: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of the nodes in ``owners`` (owner, mark, node), each from its owner's row."""
    if owners.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)
    same = F.col("__key").eqNullSafe(F.col("owner")) & (F.col("__mark") == F.col("mark"))
    met = _named(docs, key, text).join(owners, same)
    return met.select("node", F.col("__text").alias("text"))


def _node_of(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def _block_rows(texts: DataFrame, measure: Measure) -> DataFrame:
    """(node, key): the inverted lists of heavy nodes; ``texts`` has (node, text) of those.

    A set has hundreds of keys, so they are made where they are dealt out and never stored
    with their set. A node whose owner's row is repeated comes as often.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(measure.ngram)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                nodes, lists = [], []
                for node, value in zip(part.column("node"), part.column("text"), strict=True):
                    hashes = shingler.hashes(value.as_py())
                    if _node_of(hashes) == node.as_py():
                        nodes.append(node.as_py())
                        lists.append(block_lists(hashes, measure))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                    names=["node", "lists"],
                )

    rows = texts.mapInArrow(read, "node binary, lists array<long>")
    return rows.select("node", F.explode("lists").alias("key"))


def _light_links(texts: DataFrame, boundary: int, measure: Measure) -> DataFrame:
    """Links (u, v) among light nodes; ``texts`` has (node, text) of those."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(measure.ngram)
        for batch in batches:
            for node, value in zip(batch.column("node"), batch.column("text"), strict=True):
                hashes = shingler.hashes(value.as_py())
                if _node_of(hashes) != node.as_py():
                    continue
                keys, smaller, larger = subset_lists(hashes, boundary, measure)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([node.as_py()] * len(keys), pa.binary()),
                        pa.array([len(hashes)] * len(keys), pa.int64()),
                        pa.array(keys, pa.int64()),
                        pa.array(smaller, pa.int64()),
                        pa.array(larger, pa.int64()),
                    ],
                    names=["node", "n", "key", "smaller", "larger"],
                )

    rows = texts.mapInArrow(subsets, "node binary, n long, key long, smaller long, larger long")
    ends = rows.groupBy("key", "smaller", "larger").agg(
        F.min(F.when(F.col("n") == F.col("smaller"), F.col("node"))).alias("low"),
        F.min(F.when(F.col("n") == F.col("larger"), F.col("node"))).alias("high"),
        F.count("*").alias("members"),
    )
    # every member of the smaller size is linked with every one of the larger size
    ends = ends.filter("members > 1 AND low IS NOT NULL AND high IS NOT NULL")
    met = rows.join(ends.drop("members"), ["key", "smaller", "larger"])
    other = F.when(F.col("n") == F.col("smaller"), F.col("high")).otherwise(F.col("low"))
    pairs = met.select(F.col("node").alias("u"), other.alias("v"))
    return pairs.filter("u != v").distinct()


def _close_pairs(pairs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (u, v) whose sizes and sketches allow a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "sketch", "m", "sketch_v")]
            keep = [_allowed(*row, measure) for row in zip(*columns, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    one = nodes.select(F.col("node").alias("u"), "n", "sketch")
    two = nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("sketch").alias("sketch_v"))
    both = pairs.join(one, "u").join(two, "v")
    both_sides = measure.numerator + measure.denominator
    most = F.floor((F.col("n") + F.col("m")) * (measure.denominator - measure.numerator) / both_sides)
    both = both.filter(F.abs(F.col("n") - F.col("m")) <= most)
    return both.mapInArrow(near, "u binary, v binary")


def _folded(sketch: bytes, size: int) -> np.ndarray:
    bits = np.frombuffer(sketch, np.uint8)
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _allowed(n: int, one: bytes, m: int, two: bytes, measure: Measure) -> bool:
    size = min(len(one), len(two))
    apart = int(np.bitwise_count(_folded(one, size) ^ _folded(two, size)).sum())
    return apart <= most_apart(n, m, measure)


def _linked(pairs: DataFrame, texts, measure: Measure) -> DataFrame:
    """The pairs (u, v) that are links, checked on the whole sets.

    ``texts`` makes (node, text) of a table of nodes. Only sets of nodes in pairs are sent.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(measure.ngram)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                hashes = [shingler.hashes(t.as_py()) for t in part.column("text")]
                own = [_node_of(h) == n.as_py() for h, n in zip(hashes, part["node"], strict=True)]
                values = pa.array([h.tobytes() for h in hashes], pa.binary())
                made = pa.RecordBatch.from_arrays(
                    [part.column("node"), values], names=["node", "elements"]
                )
                yield made.filter(pa.array(own, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                a = np.frombuffer(one.as_py(), np.uint64)
                b = np.frombuffer(two.as_py(), np.uint64)
                common = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(common >= least_overlap(len(a), len(b), measure))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    named = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    made = texts(named).mapInArrow(sets, "node binary, elements binary").dropDuplicates(["node"])
    made = stored(made, "sets-in-pairs")
    one = made.select(F.col("node").alias("u"), F.col("elements").alias("one"))
    two = made.select(F.col("node").alias("v"), F.col("elements").alias("two"))
    return pairs.join(one, "u").join(two, "v").mapInArrow(check, "u binary, v binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (u, v): root is the component's least node.

    Alternates the large-star and small-star steps until the links are stars; each round
    writes the links anew, a logarithmic number of times.
    """
    spark = links.sparkSession
    turned = F.when(F.col("u") > F.col("v"), F.col("u")).otherwise(F.col("v"))
    other = F.when(F.col("u") > F.col("v"), F.col("v")).otherwise(F.col("u"))
    edges = stored(links.select(turned.alias("u"), other.alias("v")).filter("u != v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"))
        least = least.select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        after = small.unionByName(low.select("u", F.col("low").alias("v"))).filter("u != v").distinct()
        edges = stored(after, "links")
        state = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
            F.sum((F.xxhash64("u", "v") % 1000003).cast("long")).alias("s"),
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )


def _split_pairs(
    members: DataFrame, tested: DataFrame, closest: int, tasks: int, measure: Measure
) -> DataFrame:
    """(key, u, v): allowed pairs of different components in the same list, not yet tested.

    Of each two components in a unit, the ``closest`` pairs; with 0, a spanning forest of a
    unit's components (closest pairs first). The caller comes back for the rest; a list
    without any such pair has none later either, since components only grow.

    ``members`` has (key, node, n, sketch, root, place, members): ``place`` is the row's
    number in its list. Lists longer than UNIT are compared block against block; the units
    are dealt out over tasks by their hash.
    """
    block = F.floor((F.col("place") - 1) / UNIT)
    blocks = F.floor((F.col("members") - 1) / UNIT)
    before = tested.groupBy(F.col("v").alias("node")).agg(F.collect_set("u").alias("tested"))
    dealt = (
        members.join(before, "node", "left")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
    )
    task = F.pmod(F.xxhash64("key", "low", "high"), F.lit(tasks))
    dealt = dealt.drop("place", "members", "other").withColumn("task", task)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple[int, bytes, bytes]] = []
        for (key, low, high), unit in frame.groupby(["key", "low", "high"], sort=False):
            found = _compared(unit, low, high, measure)
            if closest:
                for near in found.values():
                    pairs.extend((key, a, b) for _, a, b in heapq.nsmallest(closest, near))
            else:
                pairs.extend((key, a, b) for a, b in _forest(found))
        return pd.DataFrame(pairs, columns=["key", "u", "v"])

    return dealt.groupBy("task").applyInPandas(compare, "key long, u binary, v binary")


def _compared(unit: pd.DataFrame, low: int, high: int, measure: Measure) -> dict[tuple, list]:
    """Allowed untested pairs of a unit, with their sketches' distance, by components."""
    pairs: dict[tuple[bytes, bytes], list[tuple[int, bytes, bytes]]] = defaultdict(list)
    sizes = unit["n"].to_numpy()
    sketches = unit["sketch"].tolist()
    width = min(map(len, sketches))
    bits = np.stack([_folded(s, width) for s in sketches])
    roots = unit["root"].tolist()
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    labels = np.array([number[r] for r in roots])
    nodes = unit["node"].tolist()
    tested = [set() if t is None else set(t) for t in unit["tested"]]
    left = np.nonzero(unit["block"].to_numpy() == low)[0]
    right = np.nonzero(unit["block"].to_numpy() == high)[0]
    for at in left:
        rest = right[right > at] if low == high else right
        rest = rest[labels[rest] != labels[at]]
        rest = rest[np.abs(sizes[rest] - sizes[at]) <= most_apart(sizes[rest], sizes[at], measure)]
        if not len(rest):
            continue
        apart = np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int64)
        near = apart <= most_apart(sizes[rest], sizes[at], measure)
        for other, distance in zip(rest[near], apart[near], strict=True):
            if nodes[at] in tested[other] or nodes[other] in tested[at]:
                continue
            roots_pair = tuple(sorted((roots[at], roots[other])))
            a, b = sorted((nodes[at], nodes[other]))
            pairs[roots_pair].append((int(distance), a, b))
    return pairs


def _forest(found: dict[tuple, list]) -> Iterator[tuple[bytes, bytes]]:
    """Pairs that join all components with allowed pairs, the closest ones first."""
    parent: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in parent:
            x = parent[x]
        return x

    for (_, a, b), roots in sorted((min(near), roots) for roots, near in found.items()):
        one, two = (top(r) for r in roots)
        if one != two:
            parent[max(one, two)] = min(one, two)
            yield a, b


def linked_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = TRIGRAMS
) -> DataFrame:
    """One row per row of ``docs``: (key, n_shingles, component_id).

    ``component_id`` is the smallest key reachable by links, itself included. Texts without
    words, empty and null texts have no n-grams and are linked with nothing; fewer words than
    an n-gram form one together. Repeated rows belong to the same component. A null key is
    larger than any key. Further columns don't matter; an empty table gives none.
    """
    rows = linked_rows(docs, key, text, measure)
    return rows.select(F.col("doc_id").alias(key), "n_shingles", "component_id")


def linked_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = TRIGRAMS
) -> DataFrame:
    """As ``linked_components``: (doc_id, mark, n_shingles, root, component_id).

    ``root`` names the component, also where its keys are null or stand in other components
    too; it is null for texts without words.
    """
    sets = stored(node_sets(docs, key, text, measure), "node-sets")
    filled = sets.filter("n_shingles > 0")
    classes = filled.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("owner"),
        F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    owner = (F.col("owner.doc_id").alias("first_doc"), F.col("owner.mark").alias("mark"))
    classes = stored(classes.select("*", *owner).drop("owner"), "nodes")
    nodes = classes.select("node", "n", "sketch")
    small = classes.filter(F.col("n") <= LARGEST_LIGHT * 2).groupBy("n").count().collect()
    boundary = boundary_of({r["n"]: r["count"] for r in small}, measure)

    owners = classes.select(F.col("first_doc").alias("owner"), "mark", "node", "n")

    def texts(wanted: DataFrame) -> DataFrame:
        return _texts_of(docs, owners.drop("n").join(wanted, "node", "left_semi"), key, text)

    small_texts = texts(owners.filter(F.col("n") <= boundary).select("node"))
    light = _light_links(small_texts, boundary, measure)
    order = Window.partitionBy("key").orderBy("node")
    whole = Window.partitionBy("key")
    heavy = owners.filter(F.floor(F.col("n") * measure.denominator / measure.numerator) > boundary)
    lists = (
        _block_rows(texts(heavy.select("node")), measure)
        .withColumn("first", F.first("node").over(order))
        .withColumn("place", F.dense_rank().over(order).cast("long"))
        .withColumn("before", F.lag("node").over(order))
        .filter("before IS NULL OR before != node")
        .drop("before")
        .withColumn("members", F.max("place").over(whole))
        .filter("members > 1")
    )
    lists = stored(lists, "block-lists")
    rows = lists.agg(F.sum(F.ceil(F.col("members") / UNIT))).first()[0] or 0
    tasks = max(1, math.ceil(rows / ROWS_PER_TASK))
    star = lists.filter("place > 1").select(F.col("first").alias("u"), F.col("node").alias("v"))
    star = stored(_close_pairs(star.distinct(), nodes, measure), "star-pairs")
    links = stored(_linked(star, texts, measure).unionByName(light), "star-links")
    tested, closest, live = star, 0, lists
    while True:
        parts = stored(components(links), "components")
        named_lists = live.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = named_lists.withColumn("low", F.min("root").over(whole)).withColumn(
            "high", F.max("root").over(whole)
        )
        members = mixed.filter("low != high").drop("low", "high", "first").join(nodes, "node")
        pairs = stored(_split_pairs(members, tested, closest, tasks, measure), "split-pairs")
        if pairs.isEmpty():
            break
        # the links found so far come down to their stars
        stars = parts.filter("node != root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        chosen = stored(pairs.select("u", "v").distinct(), "chosen-pairs")
        links = stored(stars.unionByName(_linked(chosen, texts, measure)), "links-so-far")
        live = live.join(pairs.select("key").distinct(), "key", "left_semi")
        tested, closest = tested.unionByName(chosen), max(FIRST_CLOSEST, closest * 16)
    smallest = (
        classes.select("node", "first_doc")
        .join(parts, "node")
        .groupBy("root")
        .agg(F.min("first_doc").alias("component"))
    )
    of_node = (
        classes.select("node", "first_doc")
        .join(parts, "node", "left")
        .join(smallest, "root", "left")
        .select(
            "node",
            F.coalesce("root", "node").alias("root"),
            F.coalesce("component", "first_doc").alias("component_id"),
        )
    )
    rows = sets.select("doc_id", "mark", "n_shingles", "node").join(of_node, "node", "left")
    return rows.select(
        "doc_id",
        "mark",
        "n_shingles",
        "root",
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
