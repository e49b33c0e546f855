"""Field extraction from document text, as plain Catalyst expressions.

Every function takes columns and returns a column. None of them needs a
shuffle, a Python worker or a per-line loop: each rule is one or two native
regex expressions over the whole text. Rules of several steps come as one
function per step, so that the caller can keep each step in its own column and
no step is computed twice. Functions that read numbers expect ``plain`` text:
:func:`billwright.functions.text.ascii_digits` of the text.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.functions.text import (
    ANY_DIGIT,
    BREAK,
    DIGIT,
    INLINE_WS,
    WORD,
    WS,
    any_of,
    contains_any,
    first_non_empty,
    line_at,
    newline_count,
    non_empty,
    strip,
    to_double,
)

# ---- Fixed values: patterns and word lists that define the results ----------
DATE_PATTERNS = (
    rf"{ANY_DIGIT}{{2}}[/-]{ANY_DIGIT}{{2}}[/-]{ANY_DIGIT}{{4}}",
    rf"{ANY_DIGIT}{{2}}[/-]{ANY_DIGIT}{{2}}[/-]{ANY_DIGIT}{{2}}(?!{ANY_DIGIT})",
    rf"{ANY_DIGIT}{{4}}[/-]{ANY_DIGIT}{{2}}[/-]{ANY_DIGIT}{{2}}",
)
COMPANY_SUFFIXES = ("SDN BHD", "INC", "LTD", "LLC", "PLC", "CORP", "PTY", "PVT")
NUMBER_LINE_WORDS = ("nvoice", "receipt", "bill", "no")
BILL_TO_HEADINGS = ("bill to", "billed to", "billing name", "customer")
ITEMS_START_WORDS = ("description", "item", "qty", "price", "amount")
ITEMS_END_WORDS = ("total", "subtotal", "tax", "gst")
TOTAL_WORDS = ("total", "amount", "balance")  # one of them is in every label
TOTAL_LABELS = r"TOTAL|GRAND[{ws}]*+TOTAL|AMOUNT[{ws}]*+DUE|BALANCE"
RULE_LINE_SYMBOLS = r"*\-=_# "
VENDOR_FALLBACK_LINES = 10
NUMBER_SEARCH_LINES = 15

# ---- Derived patterns --------------------------------------------------------
# A date lies within a run of digits, slashes and hyphens.
_DATE_RUN = rf"[{ANY_DIGIT}/\-]{{8,}}"
# A leading "Rs." is kept in the match because its dot makes the number unreadable.
_AMOUNT = rf"(?:Rs\.[{WS}]*+)?[0-9]{{1,3}}(?:,[0-9]{{3}})*[.,][0-9]{{2}}"
_TOTAL = (
    rf"(?i)(?=[TGAB])(?:{TOTAL_LABELS.format(ws=WS)})[{WS}]*+(?::[{WS}]*+)?([0-9]+[.,][0-9]{{2}})"
)
_UP_TO_SUFFIX = rf"(?s)^(.*?{any_of(COMPANY_SUFFIXES)})"
# First line with three or more characters that is not only ruling symbols.
_SUBSTANTIAL_LINE = (
    rf"(?md)^[{INLINE_WS}]*+"
    rf"(?![{RULE_LINE_SYMBOLS}]*+[{INLINE_WS}]*+(?:\n|\z))"
    rf"([^{WS}][^\n]+[^{WS}])"
)
# ASCII letters and the four letters Python equates with them when ignoring case.
_LETTER = string.ascii_letters + r"\u0130-\u0131\u017F\u212A"
_CODE = rf"{_LETTER}{DIGIT}\-"
# First code on a line with a digit and a number-like word. A code starts at the
# first pair of letters of a run, ends with the run, has five or more characters
# and a digit; each run is looked at from its start only.
_RECEIPT_NUMBER = (
    rf"(?md)^(?=[^0-9\n]*+[0-9])(?=.*?(?i:{any_of(NUMBER_LINE_WORDS)}))"
    rf".*?(?<![{_CODE}])(?:[{DIGIT}\-]|[{_LETTER}](?![{_LETTER}]))*+"
    rf"((?=[{_CODE}]{{5}})[{_LETTER}]{{2}}[{_LETTER}\-]*+[0-9][{_CODE}]*+)"
)
# First heading line: what follows its first colon or hyphen, else the next
# line that is not blank.
_BILL_TO = (
    rf"(?i)(?<![^{BREAK}])(?=[^{BREAK}]*?{any_of(BILL_TO_HEADINGS)})"
    rf"[^{BREAK}:\-]*+(?:[:\-]|[{WS}]*+)([^{BREAK}]*+)"
)
_EMAIL = rf"(?<![{WORD}.\-])[{WORD}.\-]++@[{WORD}.\-]+\.[{WORD}]+"
# First heading line; empty when that line also closes the section, otherwise
# all lines up to the first closing one.
_ITEM_SECTION = (
    rf"(?imd)^(?=.*?{any_of(ITEMS_START_WORDS)})"
    rf"(?:(?=.*?{any_of(ITEMS_END_WORDS)})"
    rf"|.*+((?s:.*?))(?:\n.*?{any_of(ITEMS_END_WORDS)}|\z))"
)
# Lines up to and including the next one that has a digit.
_ITEM_BLOCK = r"[^0-9]*+(?:[0-9][^\n]*+|\z)"
_NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


# ---- Dates ---------------------------------------------------------------------
def date_runs(text: Column) -> Column:
    """The few stretches of a text that can hold dates, separated by blanks."""
    return F.array_join(_all(text, _DATE_RUN), " ")


def dates(runs: Column) -> Column:
    """Date-like strings, ordered by pattern and then by position, without repeats."""
    found = F.array_distinct(F.concat(*[_all(runs, p) for p in DATE_PATTERNS]))
    return F.coalesce(found, F.array().cast("array<string>"))


def first_date(runs: Column) -> Column:
    """Head of :func:`dates`. An ISO date loses its century, by rule."""
    return first_non_empty(*[F.regexp_extract(runs, p, 0) for p in DATE_PATTERNS])


# ---- Amounts and totals ----------------------------------------------------------
def amounts(plain: Column) -> Column:
    """Every readable two-decimal amount in order of appearance."""
    cleaned = F.transform(
        _all(plain, _AMOUNT),
        lambda m: F.translate(F.regexp_replace(m, r"[^0-9.,]", ""), ",", "."),
    )
    values = F.transform(cleaned, to_double)
    return F.coalesce(F.array_compact(values), F.array().cast("array<double>"))


def total_digits(plain: Column, lower: Column) -> Column:
    """Number string after the first total-like label, '' or null when there is none."""
    return F.when(
        contains_any(lower, TOTAL_WORDS),
        F.translate(F.regexp_extract(plain, _TOTAL, 1), ",", "."),
    )


# ---- Vendor and number -----------------------------------------------------------
def through_company_suffix(upper: Column) -> Column:
    """Upper-cased text up to its first company form, null when it has none."""
    return F.when(
        contains_any(upper, COMPANY_SUFFIXES), F.regexp_extract(upper, _UP_TO_SUFFIX, 1)
    )


def vendor(text: Column, through_suffix: Column) -> Column:
    """First line naming a company form, else the first substantial line of ten."""
    head = F.substring_index(strip(text), "\n", VENDOR_FALLBACK_LINES)
    return F.when(
        through_suffix.isNotNull(), strip(line_at(text, newline_count(through_suffix)))
    ).otherwise(first_non_empty(F.regexp_extract(head, _SUBSTANTIAL_LINE, 1)))


def receipt_number(text: Column) -> Column:
    """First code with letters and a digit on a number-like line of the first fifteen."""
    head = F.substring_index(text, "\n", NUMBER_SEARCH_LINES)
    return first_non_empty(F.upper(F.regexp_extract(head, _RECEIPT_NUMBER, 1)))


# ---- Bill-to ---------------------------------------------------------------------
def bill_to_text(text: Column, lower: Column) -> Column:
    """Text that belongs to the first bill-to heading, '' or null when there is none."""
    return F.when(
        contains_any(lower, BILL_TO_HEADINGS), strip(F.regexp_extract(text, _BILL_TO, 1))
    )


def email(text: Column) -> Column:
    """First e-mail address, '' when there is none."""
    return F.regexp_extract(text, _EMAIL, 0)


def bill_to_name(bill_text: Column, mail: Column) -> Column:
    return F.when(mail == "", bill_text).otherwise(
        strip(F.replace(bill_text, mail, F.lit("")))
    )


def bill_to(name: Column, mail: Column) -> Column:
    """Name and e-mail; null when the name without the e-mail is too short."""
    return F.when(
        F.length(name) > 2,
        F.struct(name.alias("name"), non_empty(mail).alias("email")),
    )


# ---- Line items ------------------------------------------------------------------
def item_section(plain: Column, lower: Column) -> Column:
    """The lines between the item heading and the closing words ('' when none)."""
    return F.when(
        contains_any(lower, ITEMS_START_WORDS), F.regexp_extract(plain, _ITEM_SECTION, 1)
    ).when(plain.isNotNull(), "")


def line_numbers(line: Column) -> Column:
    """Numbers of a line once everything but digits, dots and blanks is removed."""
    return _all(F.regexp_replace(line, rf"[^{DIGIT}.{WS}]", ""), _NUMBER)


def leading_digits(line: Column) -> Column:
    return F.regexp_extract(line, rf"^[{WS}]*+([0-9]+)", 1)


def quantity(digits: Column) -> Column:
    """Whole number of the digits, 1 without digits; null when above BIGINT."""
    return F.when(digits == "", F.lit(1).cast("bigint")).otherwise(
        digits.try_cast("bigint")
    )


def description(block: Column) -> Column:
    """Text of one or more lines without digits, dots and blanks; lines joined by a blank."""
    bare = F.regexp_replace(block, rf"[{DIGIT}.{INLINE_WS}]+", "")
    return F.btrim(F.regexp_replace(bare, r"\n+", " "))


def line_items(section: Column) -> Column:
    """Items of an item section.

    A line with a number always closes the item gathered so far, so an item is
    a run of lines ending in the next line with a digit, and the runs are found
    by one linear regex. Runs without any description yield no item.
    """
    blocks = F.filter(_all(section, _ITEM_BLOCK), lambda b: b.rlike("[0-9]"))
    described = F.transform(
        blocks,
        lambda b: F.struct(
            description(b).alias("description"),
            F.substring_index(b, "\n", -1).alias("line"),
        ),
    )
    read = F.transform(
        F.filter(described, lambda d: d["description"] != ""),
        lambda d: F.struct(
            d["description"].alias("description"),
            leading_digits(d["line"]).alias("digits"),
            line_numbers(d["line"]).alias("numbers"),
        ),
    )
    return F.transform(
        read,
        lambda r: F.struct(
            r["description"].alias("description"),
            quantity(r["digits"]).alias("quantity"),
            F.coalesce(
                F.try_element_at(r["numbers"], F.lit(-2)), F.element_at(r["numbers"], -1)
            )
            .cast("double")
            .alias("unit_price"),
            F.element_at(r["numbers"], -1).cast("double").alias("total"),
        ),
    )
