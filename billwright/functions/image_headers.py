"""Sizes and channels of PNG and JPEG files, read from their bytes by column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signatures and markers of the two formats, in hexadecimal.
PNG_SIGNATURE = "89504E470D0A1A0A"
PNG_HEADER = "0000000D49484452"
PNG_END = "0000000049454E44AE426082"
JPEG_START, JPEG_END = "FFD8", "FFD9"
#: Channels of a PNG's pixels by its colour type; a palette (3) stands for three.
PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}
PNG_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Frame markers FFC0 to FFCF but for tables (C4), extensions (C8) and conditioning (CC).
JPEG_FRAMES = tuple(f"{m:02X}" for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
#: Markers without a length: FF01 and the restarts FFD0 to FFD7.
JPEG_BARE = ("01", *(f"{m:02X}" for m in range(0xD0, 0xD8)))
#: Segments that are walked at first; a header of more is walked to its end in a second step.
FIRST_SEGMENTS = 64


def _hex(content: Column, start: Column | int, size: int) -> Column:
    """Bytes from ``start`` (from 1) on, as upper-case hexadecimal digits."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.hex(F.substring(content, start, F.lit(size)))


def _number(content: Column, start: Column | int, size: int) -> Column:
    """Big-endian number; null beyond the end of the file."""
    digits = _hex(content, start, size)
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))


def _ends_with(content: Column, digits: str) -> Column:
    size = len(digits) // 2
    return _hex(content, F.greatest(F.octet_length(content) - size + 1, F.lit(1)), size) == digits


def _info(kind: str, width: Column, height: Column, channels: Column, problem: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.when(problem.isNull(), width.cast("int")).alias("width"),
        F.when(problem.isNull(), height.cast("int")).alias("height"),
        F.when(problem.isNull(), channels.cast("int")).alias("channels"),
        problem.alias("problem"),
    )


def _png(content: Column) -> Column:
    width, height = _number(content, 17, 4), _number(content, 21, 4)
    depth, colour = _number(content, 25, 1), _number(content, 26, 1)
    channels, known = F.lit(None).cast("int"), F.lit(False)
    for kind, count in PNG_CHANNELS.items():
        channels = F.when(colour == kind, count).otherwise(channels)
        known = known | ((colour == kind) & depth.isin(*PNG_DEPTHS[kind]))
    checksum = F.crc32(F.substring(content, F.lit(13), F.lit(17)))
    problem = (
        F.when(F.octet_length(content) < 33, "cut_header")
        .when(_hex(content, 9, 8) != PNG_HEADER, "bad_header")
        .when(checksum != _number(content, 30, 4), "bad_checksum")
        .when(~known | (width < 1) | (height < 1) | (width >= 1 << 31) | (height >= 1 << 31), "bad_header")
        .when(~_ends_with(content, PNG_END), "cut_file")
    )
    return _info("png", width, height, channels, problem)


def _walk(content: Column, start: Column, steps: Column) -> Column:
    """(at, state) after up to ``steps`` segments: state is null while there are more to walk.

    A marker may be filled up with FF bytes in front; each of them counts as a step.
    """
    none = F.struct(start["at"].cast("long").alias("at"), start["state"].alias("state"))

    def step(done: Column, _: Column) -> Column:
        at = done["at"]
        marker = _hex(content, at.cast("int"), 2)
        code = F.substring(marker, 3, 2)
        size = _number(content, (at + 2).cast("int"), 2)
        state = (
            F.when(F.length(marker) < 4, "cut_header")
            .when(~F.startswith(marker, F.lit("FF")), "bad_header")
            .when(code.isin(*JPEG_FRAMES), "frame")
            .when(code.isin("D8", "D9", "DA"), "bad_header")  # image data before any frame
            .when((code != "FF") & ~code.isin(*JPEG_BARE) & size.isNull(), "cut_header")
            .when((code != "FF") & ~code.isin(*JPEG_BARE) & (size < 2), "bad_header")
        )
        jump = F.when(code == "FF", 1).when(code.isin(*JPEG_BARE), 2).otherwise(size + 2)
        further = F.struct(
            F.when(state.isNull(), at + jump).otherwise(at).alias("at"), state.alias("state")
        )
        return F.when(done["state"].isNull(), further).otherwise(done)

    return F.aggregate(F.sequence(F.lit(1), steps), none, step)


def jpeg_frame(content: Column) -> Column:
    """(at, state): where a JPEG's frame segment begins, and ``frame`` or what is wrong."""
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("string").alias("state"))
    return _walk(content, start, F.lit(FIRST_SEGMENTS))


def rest_of_header(content: Column, walked: Column) -> Column:
    """The walk to its end, for headers of many segments; each takes a byte or more."""
    left = F.when(walked["state"].isNull(), F.greatest(F.octet_length(content), F.lit(1))).otherwise(1)
    whole = _walk(content, walked, left)
    return F.when(walked["state"].isNull(), whole).otherwise(walked)


def _jpeg(content: Column, frame: Column) -> Column:
    at = frame["at"].cast("int")
    height, width = _number(content, at + 5, 2), _number(content, at + 7, 2)
    channels = _number(content, at + 9, 1)
    problem = (
        F.when(F.coalesce(frame["state"], F.lit("cut_header")) != "frame", F.coalesce(frame["state"], F.lit("cut_header")))
        .when(channels.isNull(), "cut_header")
        .when((width < 1) | (height < 1) | ~channels.isin(1, 3, 4), "bad_header")
        .when(~_ends_with(content, JPEG_END), "cut_file")
    )
    return _info("jpeg", width, height, channels, problem)


def image_info(content: Column, frame: Column) -> Column:
    """(kind, width, height, channels, problem) of a file's bytes.

    ``frame`` is the finished walk of :func:`jpeg_frame`, in a column of its own. ``problem``
    is null for sound headers of whole files, else ``no_content``, ``not_an_image``, ``cut_header``,
    ``bad_header``, ``bad_checksum`` or ``cut_file``; sizes are null then.
    """
    none = F.lit(None).cast("int")
    other = _info("none", none, none, none, F.lit("not_an_image"))
    missing = _info("none", none, none, none, F.lit("no_content"))
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), missing)
        .when(_hex(content, 1, 8) == PNG_SIGNATURE, _png(content))
        .when(_hex(content, 1, 2) == JPEG_START, _jpeg(content, frame))
        .otherwise(other)
    )


def is_jpeg(content: Column) -> Column:
    return _hex(content, 1, 2) == JPEG_START
