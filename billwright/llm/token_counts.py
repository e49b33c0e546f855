"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word in one pass; the
Viterbi recurrence carries, for each position, the best score and the number of pieces of
the best path. Words are counted once per task and remembered in a bounded table.

The tie rules are those of the usual unigram encoders: ends are visited from left to right,
candidates for an end from the longest piece to the shortest, and only a strictly better
score replaces a path. An unknown character costs the lowest score minus ``UNKNOWN_COST``
and is spelled out in UTF-8 bytes (one piece each) or, without byte pieces, counts as one
piece together with unknown characters beside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
UNKNOWN_COST = 10.0
#: Words remembered by one task; a full table is emptied. It bounds memory, not results.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 64
#: Zipf-Mandelbrot shift of the scores made from ranks.
SHIFT = 2.7


@lru_cache(maxsize=4)
def zipf_pieces(model_path: str) -> tuple[tuple[tuple[str, float], ...], bool]:
    """Pieces of a sentencepiece file with scores -log(rank + SHIFT), and whether it has bytes.

    The files at hand hold merge ranks and no unigram scores, so Zipf's law turns ranks into
    log-probabilities (up to a constant). Control, unknown and byte pieces are no candidates.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, with_bytes = [], False
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            with_bytes = True
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), -math.log(len(pieces) + 1 + SHIFT)))
    return tuple(pieces), with_bytes


class Counter:
    """Counts the pieces of texts; one per Python worker and vocabulary."""

    def __init__(self, pieces: tuple[tuple[str, float], ...], byte_pieces: bool):
        import ahocorasick

        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min((score for _, score in pieces), default=0.0) - UNKNOWN_COST
        self.byte_pieces = byte_pieces
        self.known: dict[str, int] = {}

    def text(self, text: str) -> int:
        """Pieces of a text: every blank opens a word, and the first word gets one too."""
        if not text:
            return 0
        words = text.split(" ")
        if not words[0] and len(words) > 1:
            words = words[1:]  # the text brings its own first blank
        known, total = self.known, 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.word(SPACE + word)
                if len(word) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = count
            total += count
        return total

    def word(self, word: str) -> int:
        size = len(word)
        best: list[float | None] = [None] * (size + 1)
        best[0] = 0.0
        counts = [0] * (size + 1)
        unknown_end = [False] * (size + 1)
        matches = iter(self.matches.iter(word))
        found = next(matches, None)
        for end in range(1, size + 1):
            single = False
            while found is not None and found[0] == end - 1:
                length, score = found[1]
                single |= length == 1
                start = end - length
                candidate = best[start] + score
                if best[end] is None or candidate > best[end]:
                    best[end], counts[end] = candidate, counts[start] + 1
                    unknown_end[end] = False
                found = next(matches, None)
            if not single:
                candidate = best[end - 1] + self.unknown
                if best[end] is None or candidate > best[end]:
                    if self.byte_pieces:
                        step = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    else:
                        step = 0 if unknown_end[end - 1] else 1
                    best[end], counts[end] = candidate, counts[end - 1] + step
                    unknown_end[end] = True
        return counts[size]


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    return Counter(*zipf_pieces(model_path))


def token_counts(
    docs: DataFrame, model_path: str, text: str = "text", name: str = "n_tokens"
) -> DataFrame:
    """Add the number of pieces of ``text`` as ``name``; null and empty texts have 0.

    ``model_path`` is a file that every executor has at the same place. Rows keep their
    partitions; repeated rows are counted each; an input column ``name`` is replaced; an empty
    table gives an empty one.
    """
    kept = [c for c in docs.columns if c != name]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            counts = [own.text(t) if t else 0 for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64())], names=[*kept, name]
            )

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(count, schema)
