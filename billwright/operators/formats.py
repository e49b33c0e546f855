"""Document formats from a table of templates, all tested in one pass over each text."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billwright.functions import quality
from billwright.functions.marks import longest_marks

#: Rows of a template table: it becomes one pattern, so its size is checked, not assumed.
MOST_TEMPLATES = 10_000
TEMPLATE_SCHEMA = (
    "mark string, priority int, name string, confidence double, supported boolean, indicators array<string>"
)


@dataclass(frozen=True)
class Template:
    """A format that a text has if it holds the mark (case-sensitive); high priorities win."""

    mark: str
    priority: int
    name: str
    confidence: float
    supported: bool
    indicators: tuple[str, ...]


def templates_of(table: DataFrame) -> list[Template]:
    """The templates of a table of ``TEMPLATE_SCHEMA``, the strongest first.

    Ties in priority go to the longer mark, then to the mark that sorts first, then by name.
    Rows without a mark are left out; of rows with equal marks the strongest counts.
    """
    rows = table.filter("mark != ''").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    made = [
        Template(r["mark"], r["priority"] or 0, r["name"], r["confidence"], r["supported"], tuple(r["indicators"] or ()))
        for r in rows
    ]
    return sorted(made, key=lambda t: (-t.priority, -len(t.mark), t.mark, t.name or ""))


def _strongest(templates: list[Template]) -> dict[str, int]:
    """Place of the best template for each mark, counting the marks that begin like it."""
    own: dict[str, int] = {}
    for place, template in enumerate(templates):
        own.setdefault(template.mark, place)
    return {
        mark: min(own[mark[:size]] for size in range(1, len(mark) + 1) if mark[:size] in own) for mark in own
    }


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def format_of(text: Column, templates: list[Template]) -> Column:
    """(name, confidence, supported, indicators, mark) of the strongest template of a text.

    Texts without any mark, and null texts, have the unknown format and a null mark. Give a
    column name, not a costly expression.
    """
    name, conf, supported, indicators = quality.UNKNOWN_FORMAT
    infos = [
        {"name": t.name, "confidence": t.confidence, "supported": t.supported, "indicators": t.indicators, "mark": t.mark}
        for t in templates
    ]
    unknown = {"name": name, "confidence": conf, "supported": supported, "indicators": indicators, "mark": None}
    kind = "struct<name:string,confidence:double,supported:boolean,indicators:array<string>,mark:string>"
    if not templates:
        return _literal(unknown, kind)
    strongest = _strongest(templates)
    marks = sorted(strongest)
    # marks by name, their templates by place: both are literals of the table's size
    places = _literal([strongest[m] for m in marks], "array<int>")
    names = _literal(marks, "array<string>")
    found = F.transform(
        longest_marks(text, marks), lambda m: F.element_at(places, F.array_position(names, m).cast("int"))
    )
    best = F.coalesce(F.array_min(found), F.lit(len(templates)))
    return F.element_at(_literal([*infos, unknown], f"array<{kind}>"), best + 1)


def with_format(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """Add ``format``, the strongest template of each text. Row-local: no shuffle, no join.

    An input column ``format`` is replaced; an empty template table makes every text unknown.
    """
    return docs.withColumn("format", format_of(F.col(text), templates_of(templates)))
