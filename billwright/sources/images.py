"""Image files of a landing folder: listing, naming, and a readability check."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billwright.functions import image_headers as header

# Supported extensions in their listing order, case as given.
EXTENSIONS = ("jpg", "png", "jpeg")
_GLOB = "*.{" + ",".join(EXTENSIONS) + "}"


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files directly in the folder, with their bytes."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _GLOB)
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path", "length", "content")
    )


def image_manifest(files: DataFrame, folder: str) -> DataFrame:
    """Listing of the supported files directly in the folder.

    Adds stem, extension, its rank in the listing order and a content hash. The
    bytes are hashed where they are read and not carried further.
    """
    return _hashed(_listed(files, folder))


def _directly_in(folder: str) -> Column:
    """Whether ``path`` is a file directly in the folder, however the folder is spelled.

    The folder may have a scheme, repeated or dotted parts, or be a glob pattern; then the
    depth of the path decides, as it does for a folder given relative to a working one.
    """
    plain = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", folder)
    plain = posixpath.normpath(plain)
    path = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*(?=/))?", "")
    path = F.regexp_replace(path, "//+", "/")
    if not plain.startswith("/"):
        inside = F.concat(F.lit(plain + "/"), F.substring_index("path", "/", -1))
        return F.endswith(path, inside)
    depth = F.size(F.split(path, "/"))
    same = depth == len(plain.rstrip("/").split("/")) + 1
    if re.search(r"[*?\[{]", plain):
        return same
    return same & F.startswith(path, F.lit(plain.rstrip("/") + "/"))


def _listed(files: DataFrame, folder: str) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    parts = files.withColumns({"name": name, "ext": ext})
    return parts.filter(F.col("ext").isin(*EXTENSIONS) & _directly_in(folder))


def _hashed(listed: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.col("ext"))
    return listed.select(
        "path",
        F.expr("substring(name, 1, length(name) - length(ext) - 1)").alias("stem"),
        "ext",
        order.cast("int").alias("ext_rank"),
        "length",
        F.sha2("content", 256).alias("sha256"),
    )


def scan_image_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return image_manifest(scan_files(spark, folder), folder)


def first_sample(files: DataFrame, folder: str) -> DataFrame:
    """The first image of a listing: its path goes to the driver, then one row is read.

    Only paths are compared, in each task first; no bytes are sorted or moved.
    """
    first = _listed(files.select("path"), folder).agg(F.min("path")).first()[0]
    chosen = files.filter(F.lit(False) if first is None else F.col("path") == first)
    return _hashed(_listed(chosen, folder)).limit(1)


def first_path(spark: SparkSession, folder: str) -> DataFrame:
    """Path of the first image of a folder; the scan lists files and reads none."""
    paths = scan_files(spark, folder).select("path")
    return _listed(paths, folder).select("path").orderBy("path").limit(1)


def scan_first_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first image of a folder: its path goes to the driver, then one file is read."""
    first = first_path(spark, folder).first()
    if first is None:
        return image_manifest(scan_files(spark, folder), folder)
    return _hashed(_listed(scan_files(spark, first.path), posixpath.dirname(first.path)))


def checked_headers(files: DataFrame) -> DataFrame:
    """(path, kind, width, height, channels, problem, error_class) of every file.

    Sizes are read from the bytes of PNG and JPEG headers, without decoding pixels and without
    Python; the bytes stay where they are read. ``error_class`` is ``bad_image`` where
    ``problem`` names a fault: no bytes, another format, a header that is cut, wrong or fails
    its checksum, or a file that lacks its end. An empty table gives an empty one.
    """
    content = F.col("content")
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.lit("bad_header").alias("state"))
    walked = files.withColumn(
        "__walk", F.when(header.is_jpeg(content), header.jpeg_frame(content)).otherwise(nothing)
    )
    walked = walked.withColumn("__frame", header.rest_of_header(content, F.col("__walk")))
    info = header.image_info(content, F.col("__frame"))
    return walked.select("path", info.alias("i")).select(
        "path", "i.*", F.when(F.col("i.problem").isNotNull(), "bad_image").alias("error_class")
    )


def scan_image_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``checked_headers`` of the image files directly in a folder."""
    return checked_headers(scan_files(spark, folder))


def scan_image_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Size of every image; files that cannot be decoded carry ``bad_image``.

    Pixels stay in the source's blue-green-red order, as ``channel_order`` records.
    """
    image = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .option("pathGlobFilter", _GLOB)
        .load(folder)
    )
    return image.select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.lit("BGR").alias("channel_order"),
        F.when(F.col("image.height") < 0, "bad_image").alias("error_class"),
        F.col("image.data").alias("data"),
    )
