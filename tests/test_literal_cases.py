"""Literal cases of every text rule; expected values follow from reading the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from billwright.functions.quality import display_money
from billwright.operators import records as R

RECEIPT = (
    "== == ==\nHarbour Lamps SDN BHD\n12 Quay Road\n\nReceipt HL-20417\n"
    "issued 27-08-2022, counter 3\n\nGrand Total : 84.60\nthank you\n"
)

CASES = [
    ("dates", "2019-01-15", ["19-01-15", "2019-01-15"]),
    ("dates", "01/02/19 and 15/01/2019", ["15/01/2019", "01/02/19"]),
    ("dates", "15/01-2019 15/01-2019", ["15/01-2019"]),
    ("dates", "no date", []),
    ("dates", None, []),
    ("dates", "99/99/9999", ["99/99/9999"]),
    ("dates", "01/02/199", []),
    ("dates", "112/03/2019", ["12/03/2019"]),
    ("dates", "1/2-01/02/19-03/04/20", ["01/02/19", "03/04/20"]),
    ("amounts", "1,234.56", []),
    ("amounts", "Rs.123.45", []),
    ("amounts", "Rs 123.45", [123.45]),
    ("amounts", "Rs. \n 123.45 9.99", [9.99]),
    ("amounts", "1234.56", [234.56]),
    ("amounts", "1,234", [1.23]),
    ("amounts", "1.234,56", [1.23, 4.56]),
    ("amounts", "$12.50 12,50", [12.5, 12.5]),
    ("amounts", "RM 5.00 €7,25", [5.0, 7.25]),
    ("amounts", None, []),
    ("total_amount", "SUBTOTAL: 9.00\nTOTAL: 10.00", 9.0),
    ("total_amount", "TOTAL: RM 10.00", None),
    ("total_amount", "Total\n10.00", 10.0),
    ("total_amount", "Total 1,234.56", 1.23),
    ("total_amount", "BALANCE: 5", None),
    ("total_amount", "grand \n total : 7,50", 7.5),
    ("total_amount", "Amount Due : 12.34", 12.34),
    ("total_amount", "total: ١٢.٥٠", 12.5),
    ("total_amount", "TOTAL:: 5.00", None),
    ("vendor_rules", "***\nab\nPrince Cafe\nX LTD", "Prince Cafe"),
    ("vendor_rules", "\n\nhello\nx", "hello"),
    ("vendor_rules", "***\n---", None),
    ("vendor_rules", "\n".join(["--"] * 10 + ["Shop"]), None),
    ("vendor_rules", "\n".join(["--"] * 10 + ["Shop LTD"]), "Shop LTD"),
    ("vendor_rules", "  \n  a b \n", "a b"),
    ("vendor_rules", "* - = #\n  Acme Ltd.  \n", "Acme Ltd."),
    ("vendor_rules", "ﬁnc\nx", "ﬁnc"),
    ("vendor_rules", "   ", None),
    ("receipt_number", "snow AB-123", "AB-123"),
    ("receipt_number", "Invoice no: 12345", None),
    ("receipt_number", "no: A1B2C3", None),
    ("receipt_number", "receipt inv-007", "INV-007"),
    ("receipt_number", "\n" * 15 + "Bill AB123", None),
    ("receipt_number", "\n" * 14 + "Bill AB123", "AB123"),
    ("receipt_number", "no A1BC2DEF", "BC2DEF"),
    ("receipt_number", "no ABCDEF\nbill GH-12", "GH-12"),
    ("receipt_number", "no AB12", None),
    ("receipt_number", "AB-123\nno", None),
    ("bill_to", "Bill To: Jane Doe jane@x.com", ("Jane Doe", "jane@x.com")),
    ("bill_to", "Bill To\n\nJane", ("Jane", None)),
    ("bill_to", "Bill To:\nJane", None),
    ("bill_to", "Bill To: a@b.co", None),
    ("bill_to", "Customer - Al", None),
    ("bill_to", "Customer-care: Bob", ("care: Bob", None)),
    ("bill_to", "bill to\r\n\r\n  Jane \r\nx", ("Jane", None)),
    ("bill_to", "bill to Jane", ("Jane", None)),
    ("bill_to", "x\x1cbilled to: Jane\x1cy", ("Jane", None)),
    ("bill_to", "Customer: a@b.co Ann a@b.co", ("Ann", "a@b.co")),
    ("bill_to", "Customer\nbill to: Jane", ("bill to: Jane", None)),
    ("bill_to", "Customer", None),
    ("items", "Description Qty Price\nBlue Pen 2 5.00 10.00\nTotal 10.00", [("BluePen", 1, 5.0, 10.0)]),
    ("items", "Item\n2 x Blue Pen 5.00 10.00", [("xBluePen", 2, 5.0, 10.0)]),
    ("items", "Item\nRed\nChair 3.00", [("Red Chair", 1, 3.0, 3.0)]),
    ("items", "Item\nPen 1,234.50", [("Pen,", 1, 1234.5, 1234.5)]),
    ("items", "Item\n5.00\nPen 2.00", [("Pen", 1, 2.0, 2.0)]),
    ("items", "Item Qty Total\nPen 1.00", []),
    ("items", "Item\nTaxi 9.00\nPen 1.00", []),
    ("items", "Pen 1.00", []),
    ("items", "Item\nPen\n\n \nInk 1.2.3", [("Pen Ink", 1, 1.2, 3.0)]),
    ("items", "Item\r\nPen 1.00\r\nInk", [("Pen", 1, 1.0, 1.0)]),
    ("items", "Item\nPen 1.00", [("Pen", 1, 1.0, 1.0)]),
    ("items", "", []),
    ("items", "Item", []),
]


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame(
        [(i, text) for i, (_, text, _) in enumerate(CASES)], "doc_id long, text string"
    )
    out = R.with_amounts(R.with_dates(R.structure_records(df), "raw_text"), "raw_text")
    return {r.doc_id: r for r in out.collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_case(results, number):
    field, text, expected = CASES[number]
    value = results[number][field]
    if field == "bill_to" and value is not None:
        value = tuple(value)
    if field == "items":
        value = [tuple(i) for i in value]
    assert value == expected, text


def test_whole_receipt(texts):
    df = R.with_amounts(R.with_dates(R.with_quality(R.structure_records(texts([RECEIPT]))), "raw_text"), "raw_text")
    r = df.first()
    assert (r.dates, r.amounts, r.total_amount) == (["27-08-2022"], [84.6], 84.6)
    assert (r.vendor_rules, r.receipt_number) == ("Harbour Lamps SDN BHD", "HL-20417")
    assert (r.bill_to, r["items"]) == (None, [])
    assert (r.extraction_confidence, r.validation_passed) == (60, False)
    assert (r.format.name, r.format.confidence, r.format.supported) == ("Template A (Retail)", 95.0, True)
    assert (r.confidence_tier, r.validation_status) == ("Medium", False)
    assert r.recommendations == ["• Extraction should be highly accurate."]


def test_total_without_items_validates(texts):
    r = R.structure_records(texts(["TOTAL: 0.00"])).first()
    assert (r.validation_passed, r.extraction_confidence) == (True, 20)


def test_quarantine(texts):
    rows = texts([None, "Item\n99999999999999999999 Pen 1.00", "x", ""])
    good, bad = R.split_quarantine(R.structure_records(rows))
    assert {r.doc_id: r.error_class for r in bad.collect()} == {0: "null_text"}
    kept = {r.doc_id: r for r in good.collect()}
    assert set(kept) == {1, 2, 3}
    assert (kept[1].warning, kept[2].warning) == ("quantity_overflow", None)
    item = kept[1]["items"][0]
    assert (item.description, item.quantity, item.total) == ("Pen", None, 1.0)


def test_input_columns_stay_and_conditions_come_first(texts):
    rows = texts(["x", "y"]).selectExpr("doc_id AS _id", "text", "7 AS _corrupt_record", "8 AS _lower")
    out = R.structure_records(rows, only=F.col("_id") == 1)
    assert [(r._id, r.raw_text, r._corrupt_record, r._lower) for r in out.collect()] == [(1, "y", 7, 8)]


@pytest.mark.parametrize(
    "value, shown",
    [(0.125, "$0.12"), (2.675, "$2.67"), (0.375, "$0.38"), (1.115, "$1.11"), (-0.125, "$-0.12"), (1e15, "$1000000000000000.00"),
     (0.005, "$0.01"), (0.015, "$0.01"), (0.025, "$0.03"), (123456.785, "$123456.79"), (0.0, "$0.00"), (None, "N/A"), (2.999, "$3.00")],
)
def test_money_is_rounded_on_the_exact_value(spark, value, shown):
    row = spark.createDataFrame([(value,)], "v double").select(display_money(F.col("v")).alias("s")).first()
    assert row.s == shown
    if value is not None:
        assert row.s == f"${value:.2f}"


def test_full_confidence(texts):
    text = "Invoice AB-123\n01/02/2019\nBill To: Jane\nItem\n2 Pen 1.00 2.00\nTotal: 2.00"
    r = R.with_display(R.with_quality(R.structure_records(texts([text]))), "vendor_rules").first()
    assert (r.extraction_confidence, r.validation_passed, r.confidence_tier) == (100, True, "High")
    assert (r.show_total, r.show_bill_to, r.show_receipt_number) == ("$2.00", "Jane", "AB-123")


def test_display_of_missing(texts):
    r = R.with_display(R.structure_records(texts(["-"])), "vendor_rules").first()
    shown = (r.show_vendor, r.show_receipt_number, r.show_date, r.show_total, r.show_bill_to)
    assert shown == ("N/A",) * 5


def test_unknown_method():
    with pytest.raises(ValueError, match="Unknown extraction method"):
        R.check_method("other")
    assert R.check_method("rules") == "rules"
