"""Token-label arithmetic of the model path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billwright.functions.text import ascii_digits, to_double

# ---- Fixed values ------------------------------------------------------------
PADDING_LABEL = -100
TOKEN_LIMIT = 512
CONFIDENCE_ABOVE = 60
BOX_SCALE = 1000


def argmax(logits: Column) -> Column:
    """Index of the first largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def label_name(label_id: Column, id2label: dict[int, str]) -> Column:
    """Name of a label id from the model's label set; null for an unknown id."""
    pairs = [F.lit(x) for pair in sorted(id2label.items()) for x in pair]
    return F.try_element_at(F.create_map(*pairs), label_id)


def entity_type(label: Column) -> Column:
    """Type behind a B- or I- prefix; null for words outside any entity."""
    return F.when(label.rlike("^[BI]-"), F.regexp_replace(label, "^[BI]-", ""))


def is_begin(label: Column) -> Column:
    return F.startswith(label, F.lit("B-"))


def entity_total(text: Column) -> Column:
    """Amount of a TOTAL entity: its digits and dots, null when not one number."""
    return to_double(F.regexp_replace(ascii_digits(text), r"[^0-9.]", ""))


def box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(
        left.alias("x0"),
        top.alias("y0"),
        F.try_add(left, width).alias("x1"),
        F.try_add(top, height).alias("y1"),
    )


def normalized_box(b: Column, width: Column, height: Column) -> Column:
    """Box on a 0-1000 grid, truncated; null without a page size or beyond whole numbers."""

    def scaled(name: str, size: Column) -> Column:
        ratio = F.try_divide(b[name].cast("double"), size.cast("double"))
        return (F.lit(BOX_SCALE) * ratio).try_cast("int").alias(name)

    corners = [scaled(c, size) for c, size in zip(("x0", "y0", "x1", "y1"), (width, height) * 2)]
    usable = (width != 0) & (height != 0)
    for corner in corners:
        usable &= corner.isNotNull()
    return F.when(usable, F.struct(*corners))
