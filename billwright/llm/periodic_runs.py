"""Maximal periodic runs of words, found with a suffix automaton and link-cut access.

The automaton of a stretch of words has a state for every class of substrings with the same
ends; its links form a tree in which the path from the state of a prefix to the root holds all
suffixes of that prefix. Each state is coloured with the last place where its substrings ended.
Appending a word is a link-cut *access* of the prefix's state: the path to the root falls into
segments of one colour each, which are then recoloured. A segment of colour p whose longest
suffix has l words says: the last l words also ended d = here - p words before. Where d <= l
that is a square of period d, reaching back l + d words. With at least three periods, d is the
smallest period and l + d reaches the run's first word (periodicity lemma), so a run is read
off at its last word, the one that the next word does not extend.

All substrings of a run recur, so only stretches whose n-grams all recur in the text are given
to the automaton; a run lies in one stretch whole. The number of segments is O(n log n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

LEAST_LENGTH = 24
LEAST_PERIODS = 3
#: Rows handed to Arrow at once hold about so many bytes of text (a longer text goes alone).
BYTES_PER_BATCH = 16 << 20

RUN = T.StructType(
    [T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]
)
_RUN_ARROW = pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def recurring_stretches(words: list[bytes], least_length: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """(start, end) of maximal stretches whose n-grams of least_length // 3 words all recur.

    Equal hashes of different n-grams only make stretches longer.
    """
    gram = max(1, least_length // 3)
    if len(words) < max(least_length, gram):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    total = hashes[: len(words) - gram + 1].copy()
    for k in range(1, gram):
        total *= _ODD
        total += hashes[k : len(words) - gram + 1 + k]
    order = np.argsort(total)
    ranked = total[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    recurs = np.zeros(len(total) + 2, np.int8)  # framed by zeros
    recurs[order[1:][same] + 1] = 1
    recurs[order[:-1][same] + 1] = 1
    edges = np.diff(recurs)
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    long = ends - starts + gram - 1 >= least_length
    return list(zip(starts[long].tolist(), (ends[long] + gram - 1).tolist(), strict=True))


def suffix_automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest, link, prefix): longest word count and link of each state, state of each prefix."""
    longest, link, moves, prefix = [0], [-1], [{}], []
    last = 0
    for word in ids:
        here = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        moves.append({})
        state = last
        while state != -1 and word not in moves[state]:
            moves[state][word] = here
            state = link[state]
        if state != -1:
            target = moves[state][word]
            if longest[target] != longest[state] + 1:
                clone = len(longest)
                longest.append(longest[state] + 1)
                link.append(link[target])
                moves.append(moves[target].copy())
                link[target] = clone
                while state != -1 and moves[state].get(word) == target:
                    moves[state][word] = clone
                    state = link[state]
                target = clone
            link[here] = target
        prefix.append(here)
        last = here
    return longest, link, prefix


class LinkTree:
    """Path colours of a rooted tree: preferred paths are splay trees ordered by depth.

    Every preferred path has one colour, kept at its splay tree's root.
    """

    def __init__(self, parent: list[int]):
        self.up = list(parent)  # parent in the splay tree, or above the path for its root
        self.left = [-1] * len(parent)
        self.right = [-1] * len(parent)
        self.colour = [0] * len(parent)

    def _rotate(self, node: int) -> None:
        up, left, right = self.up, self.left, self.right
        above = up[node]
        top = up[above]
        if left[above] == node:
            inner = left[above] = right[node]
            right[node] = above
        else:
            inner = right[above] = left[node]
            left[node] = above
        if inner != -1:
            up[inner] = above
        up[above] = node
        up[node] = top
        if top != -1:
            if left[top] == above:
                left[top] = node
            elif right[top] == above:
                right[top] = node

    def _splay(self, node: int) -> None:
        """Make a node the root of its splay tree, and carry the path's colour along."""
        up, left, right, rotate = self.up, self.left, self.right, self._rotate
        root = node
        while True:
            above = up[node]
            if above == -1 or (left[above] != node and right[above] != node):
                break
            top = up[above]
            if top == -1 or (left[top] != above and right[top] != above):
                root = above
                rotate(node)
                break
            root = top
            rotate(above if (left[top] == above) == (left[above] == node) else node)
            rotate(node)
        self.colour[node] = self.colour[root]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from a node to the root.

        Returns its old segments from below as (deepest node on the path, old colour).
        """
        segments, below, at = [], -1, node
        colours, right, up = self.colour, self.right, self.up
        while at != -1:
            self._splay(at)
            old = colours[at]
            if right[at] != -1:  # the deeper part becomes a path of its own
                colours[right[at]] = old
            right[at] = below
            segments.append((at, old))
            below, at = at, up[at]
        self._splay(node)
        colours[node] = colour
        return segments


def runs_of(
    ids: list[int], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS
) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs, sorted. ``least_periods`` is 3 or more."""
    if least_periods < 3:
        raise ValueError("runs are read off squares from three periods on")
    longest, link, prefix = suffix_automaton(ids)
    tree, found = LinkTree(link), []
    for end, state in enumerate(prefix, start=1):
        for node, before in tree.access(state, end):
            length, period = longest[node], end - before
            if (
                before
                and length >= (least_periods - 1) * period
                and length + period >= least_length
                and (end == len(ids) or ids[end] != ids[end - period])
            ):
                found.append((end - length - period, length + period, period))
    return sorted(found)


def runs_in_words(
    words: list[bytes], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS
) -> list[tuple[int, int, int]]:
    """The runs of a whole text, by its recurring stretches."""
    runs = []
    for start, end in recurring_stretches(words, least_length):
        numbers: dict[bytes, int] = {}
        ids = [numbers.setdefault(word, len(numbers)) for word in words[start:end]]
        runs.extend((start + s, n, p) for s, n, p in runs_of(ids, least_length, least_periods))
    return sorted(runs)


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those after the first period of a run."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [word for word, stays in zip(words, keep.tolist(), strict=True) if stays]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; of equals the first, then the shortest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_runs(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    least_length: int = LEAST_LENGTH,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Add ``runs``, ``strongest`` and ``collapsed`` to each row.

    A run is a stretch of words of smallest period p, of at least ``least_length`` words and
    ``least_periods`` periods, that no neighbouring word extends. ``runs``: array of (start,
    length, period) by start and period; ``strongest``: the run of greatest length / period
    (ties: smallest start, then period; null without runs); ``collapsed``: the words, joined
    by one space, without those that any run holds after its first period.

    Words are cut at ASCII blanks alone. Null and empty texts have no runs and an empty
    ``collapsed``; repeated rows each get their result; ``keep`` names the columns to carry
    (default all), of which those named like a result are replaced; an empty table gives an
    empty one. Row-local: memory follows the longest text, rows keep their partitions.
    """
    added = ("runs", "strongest", "collapsed")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    schema = T.StructType(
        [
            *docs.select(*kept).schema.fields,
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("strongest", RUN, True),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )

    def records(runs):
        return [dict(zip(RUN.names, run, strict=True)) for run in runs]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").cast(pa.large_binary())
            start, held, found, best, left = 0, 0, [], [], []
            for row, value in enumerate(texts):
                words = (value.as_py() or b"").split()
                runs = runs_in_words(words, least_length, least_periods)
                top = strongest(runs)
                found.append(records(runs))
                best.append(records([top])[0] if top else None)
                left.append(b" ".join(collapsed_words(words, runs)))
                held += len(left[-1])
                if held >= BYTES_PER_BATCH or row + 1 == batch.num_rows:
                    part = batch.slice(start, row + 1 - start)
                    columns = [
                        *(part.column(c) for c in kept),
                        pa.array(found, pa.list_(pa.field("element", _RUN_ARROW, False))),
                        pa.array(best, _RUN_ARROW),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])
                    start, held, found, best, left = row + 1, 0, [], [], []

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(find, schema)
