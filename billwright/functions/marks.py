"""Finding many fixed strings in one pass over a text: one pattern, built as a prefix tree."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = ""


def _tree(marks: Iterable[str]) -> dict:
    root: dict = {}
    for mark in marks:
        node = root
        for ch in mark:
            node = node.setdefault(ch, {})
        node[_END] = True
    return root


def _pattern(tree: dict) -> str:
    """Longest string of a tree, written from the leaves up, so that depth is no limit."""
    order, todo = [], [tree]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(child for ch, child in node.items() if ch != _END)
    written: dict[int, str] = {}
    for node in reversed(order):
        ways = [re.escape(ch) + written[id(child)] for ch, child in sorted(node.items()) if ch != _END]
        if not ways:
            body = ""
        elif len(ways) == 1 and _END not in node:
            body = ways[0]
        else:
            body = f"(?:{'|'.join(ways)})"
        written[id(node)] = f"{body}?+" if _END in node and ways else body
    return written[id(tree)]


def longest_mark_pattern(marks: Iterable[str]) -> str:
    """Pattern whose group 1 is the longest mark that begins at a place.

    It matches without consuming, so marks that overlap or hold each other are all found: at
    one place, the marks that begin there are the beginnings of the longest one.
    """
    marks = sorted(set(marks))
    if not marks or "" in marks:
        raise ValueError("marks must be strings of one character or more")
    initials = "".join(sorted({re.escape(m[0]) for m in marks}))
    return f"(?=[{initials}])(?=({_pattern(_tree(marks))}))"


def longest_marks(text: Column, marks: Iterable[str]) -> Column:
    """The distinct longest marks of a text, over all places. Null text: null."""
    found = F.regexp_extract_all(text, F.lit(longest_mark_pattern(marks)), F.lit(1))
    return F.array_distinct(found)
