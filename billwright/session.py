"""Session settings, shared work folders and stored intermediate tables."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings of a session that runs these jobs; a cluster may override any of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

FOLDER_KEY = "spark.billwright.sessionFolder"
SHIPPED_KEY = "spark.billwright.shipped"


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("billwright")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per session, for functions that run in Python there.

    A job submitted with the package (``--py-files``) has it anyway; this serves sessions
    that were started without it.
    """
    application = spark.sparkContext.applicationId
    if spark.conf.get(SHIPPED_KEY, None) == application:
        return
    package = Path(__file__).parent
    archive = f"{tempfile.mkdtemp(prefix='billwright-')}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set(SHIPPED_KEY, application)


def work_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` that the driver and all executors share.

    Where it is unset, only a single-JVM session (master ``local`` or
    ``local[...]``) gets one: a temporary folder, set once for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="billwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """The session's own folder under the work root, deleted when the session ends."""
    path = spark.conf.get(FOLDER_KEY, None)
    if not path:
        path = f"{work_root(spark)}/billwright-{uuid.uuid4().hex}"
        target, files = _file_system(spark, path)
        files.mkdirs(target)
        files.deleteOnExit(target)
        spark.conf.set(FOLDER_KEY, path)
    return path


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path of this run in the session's folder, not yet made."""
    return f"{session_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a work folder before the session ends."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    Without it each of them would run the whole lineage again. The table lies in
    the shared folder (or at ``path``), so it also survives the loss of executors.
    """
    path = path or shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal a table out over ``partitions`` tasks, or keep the partitions of its scan."""
    return df if partitions is None else df.repartition(partitions)


def input_partitions(spark: SparkSession) -> int | None:
    """The setting ``spark.billwright.inputPartitions``: for inputs of few files; unset: none."""
    setting = spark.conf.get("spark.billwright.inputPartitions", None)
    return int(setting) if setting else None


def tasks_for(df: DataFrame, size: Column, each: int) -> int:
    """How many tasks it takes for each to get about ``each`` of a size: one pass that sums it."""
    return max(1, math.ceil((df.agg(F.sum(size)).first()[0] or 0) / each))


def dealt(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Deal a table by its keys into a fixed number of tasks; None leaves it to the next step."""
    return df if partitions is None else df.repartition(partitions, *keys)


def bucketed(
    df: DataFrame, purpose: str, key: str | tuple[str, ...], buckets: int, is_dealt: bool = False
) -> DataFrame:
    """Write a table dealt by ``key`` into sorted buckets, one file each, and read it back.

    Tables with as many buckets by keys of the same type are joined on them, and grouped by
    them, without a further shuffle, as often as they are read. The files lie in the session's
    shared folder; the name is known to this session's catalog alone. A table that is dealt
    so already is written as it lies (``is_dealt``).
    """
    keys = (key,) if isinstance(key, str) else key
    spark = df.sparkSession
    name = f"billwright_{re.sub('[^0-9a-z]', '_', purpose)}_{uuid.uuid4().hex}"
    rows = df if is_dealt else dealt(df, buckets, *keys)
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    writer.option("path", shared_folder(spark, purpose)).saveAsTable(name)
    return spark.table(name)
