"""Shared text helpers: whitespace, line breaks, digits and number parsing.

All patterns are written so that a match attempt never rescans a stretch it
has already rejected (possessive quantifiers, look-behind anchors), which keeps
every regex linear in the text length, also on very long single-line texts.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip`` treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Bodies of Java character classes (use inside [...]). Latin-1 characters are listed
# one by one: they compile to one bit set, while every range or category in a class
# costs a further call per character.
INLINE_WS = r" \t\x0b\f\r\x1c\x1d\x1e\x1f\x85\p{Z}"
WS = r"\n" + INLINE_WS
# Line ends of Python's ``str.splitlines``.
BREAK = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029"
DIGIT = string.digits
ANY_DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"


def _decimal_digits_beyond_ascii() -> tuple[str, str]:
    chars = [
        chr(cp)
        for cp in range(0x80, 0x110000)
        if unicodedata.category(chr(cp)) == "Nd"
    ]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


_DIGITS_FROM, _DIGITS_TO = _decimal_digits_beyond_ascii()


def strip(col: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def non_empty(col: Column) -> Column:
    """The value, null when it is ''. Give a column name, not a costly expression."""
    return F.when(col != "", col)


def first_non_empty(*cols: Column) -> Column:
    """First value that is not '', each computed exactly once; null if any is null."""
    return F.get(F.array_remove(F.array(*cols), ""), F.lit(0))


def ascii_digits(text: Column) -> Column:
    """Replace decimal digits of other scripts by 0-9; other text is left alone."""
    return F.when(
        text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, _DIGITS_FROM, _DIGITS_TO)
    ).otherwise(text)


def to_double(digits: Column) -> Column:
    """Number from a string of 0-9 and dots; null when it is not one number.

    The shape is tested first because a failing cast is far dearer than a regex.
    Give a column or lambda variable, not a costly expression.
    """
    return F.when(digits.rlike(r"^[0-9]+(?:\.[0-9]*)?$|^\.[0-9]+$"), digits.try_cast("double"))


def contains_any(cased: Column, words: Iterable[str]) -> Column:
    """True when the text has one of the words; a cheap gate before a regex."""
    return reduce(or_, [F.contains(cased, F.lit(w)) for w in words])


def line_at(text: Column, number: Column) -> Column:
    """Line ``number`` (from 0) of a text broken on newlines."""
    up_to = F.call_function("substring_index", text, F.lit("\n"), number + 1)
    return F.substring_index(up_to, "\n", -1)


def newline_count(col: Column) -> Column:
    return F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n")))


def any_of(words: Iterable[str]) -> str:
    """Pattern for one of the words; a test of the first letter keeps scans fast."""
    words = list(words)
    initials = "".join(sorted({w[0] for w in words}))
    return rf"(?=[{initials}])(?:{'|'.join(words)})"
