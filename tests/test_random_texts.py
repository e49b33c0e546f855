"""Random texts put together from parts whose outcome is known when they are chosen."""

from __future__ import annotations

import random

import pytest

from billwright.operators import records as R

FILLER = ["greetings", "counter 4", "- - -", "", "   ", "thank you for coming", "open daily", "\u00e9t\u00e9 \u00df"]
# A line and the date it stands for.
DATES = [("on 04/05/2021", "04/05/2021"), ("04-05-21 it was", "04-05-21"), ("at 2021/05/04", "21/05/04"), ("1/2", None)]
TOTALS = [("Total: 12.50", 12.5), ("BALANCE 7,25", 7.25), ("grand  total\n3.10", 3.1), ("Amount due : $4.00", None)]
NUMBERS = [("receipt QX-771", "QX-771"), ("Bill ab123", "AB123"), ("Invoice 5512", None)]
VENDORS = ["Northern Tools Ltd", "Lakeside Pte SDN BHD", "Plum INC"]
BILLED = [("Billed to: Mara Olt", ("Mara Olt", None)), ("Customer - Ivo Pell ivo@pell.org", ("Ivo Pell", "ivo@pell.org")),
          ("bill to\nSeven Oaks Cafe", ("Seven Oaks Cafe", None)), ("Customer: Al", None)]
# Item lines and the items they make.
ITEMS = [("2 Cup 1.50 3.00", ("Cup", 2, 1.5, 3.0)), ("Plate\nblue 4.25", ("Plate blue", 1, 4.25, 4.25)),
         ("Tray no digits", None), ("3x Fork 0.50", ("xFork", 3, 3.0, 0.5))]


def composed(seed: int):
    """A text, and the record that follows from the parts it was made of."""
    rng = random.Random(seed)
    vendor = rng.choice(VENDORS)
    lines, expected = [vendor], {"vendor": vendor}

    def add(name: str, choices, chance: float):
        lines.extend(rng.choices(FILLER, k=rng.randint(0, 2)))
        text, value = rng.choice(choices) if rng.random() < chance else (None, None)
        if text is not None:
            lines.append(text)
        expected[name] = value

    add("number", NUMBERS, 0.7)
    add("date", DATES, 0.7)
    add("bill_to", BILLED, 0.6)
    items = []
    if rng.random() < 0.7:
        lines.append("Description of goods")
        parts = [rng.choice(ITEMS) for _ in range(rng.randint(0, 4))]
        name = ""
        for text, item in parts:
            lines.append(text)
            if item is None:  # its words go before those of the next item
                name += "Traynodigits "
            else:
                items.append((name + item[0], *item[1:]))
                name = ""
        lines.append("Tax included")
    expected["items"] = items
    add("total", TOTALS, 0.8)
    return "\n".join(lines), expected


@pytest.fixture(scope="module")
def pairs(spark):
    made = [composed(seed) for seed in range(3000)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in R.structure_records(df).collect()}
    return [(text, expected, got[i]) for i, (text, expected) in enumerate(made)]


FIELDS = {
    "vendor": lambda r: r.vendor_rules,
    "number": lambda r: r.receipt_number,
    "date": lambda r: r.date,
    "bill_to": lambda r: r.bill_to and tuple(r.bill_to),
    "items": lambda r: [tuple(i) for i in r["items"]],
    "total": lambda r: r.total_amount,
}


@pytest.mark.parametrize("name", FIELDS)
def test_parts_come_back(pairs, name):
    wrong = [(t, e[name], FIELDS[name](r)) for t, e, r in pairs if e[name] != FIELDS[name](r)]
    assert not wrong, f"{len(wrong)} differ, e.g. {wrong[0]}"
    assert len({str(e[name]) for _, e, _ in pairs}) > 2


def test_validation_and_confidence(pairs):
    for text, expected, r in pairs:
        total, items = expected["total"], expected["items"]
        close = total is not None and abs(total - sum(i[3] for i in items)) < 0.01
        assert r.validation_passed == close, text
        found = sum(expected[n] is not None for n in ("number", "date", "bill_to", "total"))
        assert r.extraction_confidence == 20 * (found + bool(items))
