"""One indented JSON file per record, through a data source with Spark's two-phase commit.

A task attempt writes the files of its rows to a folder of its own under ``_staging``. Only when
all tasks have succeeded does the commit move the folder of each task's one successful attempt
to its place; an aborted job deletes the staging folder. Retried and speculative attempts
therefore leave nothing behind. The driver learns one message per task, not one per file.

Files are read back by the same source, a task per folder of at most FOLDER_FILES files: the
driver lists folders alone, and each task the files of its folder.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from billwright.session import ship_package
from billwright.sources.sinks import record_json, with_output_name

FORMAT = "record_files"
STAGING = "_staging"
#: Files of one folder: a task's files are split into such folders.
FOLDER_FILES = 2_000
#: Texts of one batch of files read.
BATCH_CHARS = 4_000_000


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an absolute path or a URI, and the path on it."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def indented(text: str) -> str:
    """A JSON object over several lines, two blanks to a level, characters as they are."""
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def safe_name(name: str) -> str:
    """A file name as it stands, without what would leave its folder or be hidden from readers."""
    name = name.replace("/", "_").replace("\x00", "_")
    return f"~{name}" if name[:1] in ("_", ".") or not name else name


@dataclass
class WrittenFolder(WriterCommitMessage):
    """The folder of one successful task attempt; None where the task had no rows."""

    folder: str | None
    files: int
    place: str


class RecordFilesWriter(DataSourceArrowWriter):
    """Writes rows of (output_name, value): a file of that name with the indented JSON."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.job = uuid.uuid4().hex
        self.staging = posixpath.join(self.path, STAGING, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenFolder:
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        part = context.partitionId() if context else 0
        files, root = _file_system(posixpath.join(self.staging, f"attempt-{attempt}"))
        used: dict[str, int] = {}
        count = 0
        for batch in iterator:
            for name, value in zip(batch.column("output_name"), batch.column("value"), strict=True):
                if count % FOLDER_FILES == 0:
                    folder = posixpath.join(root, f"{count // FOLDER_FILES:05d}")
                    files.create_dir(folder, recursive=True)
                name = safe_name(name.as_py() or "")
                same = used[name] = used.get(name, 0) + 1
                if same > 1:  # records of one stem are kept apart
                    stem, dot, ending = name.rpartition(".")
                    name = f"{stem or ending}~{same}{dot if stem else ''}{ending if stem else ''}"
                    used[name] = used.get(name, 0) + 1
                with files.open_output_stream(posixpath.join(folder, name)) as out:
                    out.write(indented(value.as_py()).encode("utf-8"))
                count += 1
        place = f"part-{part:05d}-{self.job}"
        return WrittenFolder(root if count else None, count, place)

    def commit(self, messages: list[WrittenFolder | None]) -> None:
        files, root = _file_system(self.path)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        for message in messages:
            if message and message.folder:
                files.move(message.folder, posixpath.join(root, message.place))
        self._drop_staging()

    def abort(self, messages: list[WrittenFolder | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        files, staging = _file_system(self.staging)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)
        above = posixpath.dirname(staging)
        left = files.get_file_info(fs.FileSelector(above, allow_not_found=True))
        if not left and files.get_file_info(above).type == fs.FileType.Directory:
            files.delete_dir(above)


class Folder(InputPartition):
    """A folder whose own files one task reads."""

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class RecordFilesReader(DataSourceReader):
    """Rows of (output_name, value): the JSON files of a folder and all below it, each whole."""

    def __init__(self, path: str):
        self.place = path.rstrip("/")

    def partitions(self) -> list[Folder]:
        files, root = _file_system(self.place)
        found = [root]
        for folder in found:  # grows while it is read
            for entry in files.get_file_info(fs.FileSelector(folder)):
                if entry.type == fs.FileType.Directory and entry.base_name[:1] not in ("_", "."):
                    found.append(entry.path)
        return [Folder(path) for path in found]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.place)
        names, values, size = [], [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(names, pa.string()), pa.array(values, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["output_name", "value"])

        for entry in files.get_file_info(fs.FileSelector(partition.path)):
            name = entry.base_name
            if entry.type != fs.FileType.File or name[:1] in ("_", ".") or not name.endswith(".json"):
                continue
            with files.open_input_stream(entry.path, compression=None) as source:
                value = source.read().decode("utf-8", "replace")
            names.append(name)
            values.append(value)
            size += len(value)
            if size >= BATCH_CHARS:
                yield batch()
                names, values, size = [], [], 0
        if names:
            yield batch()


class RecordFiles(DataSource):
    """``df.write.format("record_files").save(path)`` for rows of (output_name, value)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "output_name string, value string"

    def reader(self, schema) -> RecordFilesReader:
        return RecordFilesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> RecordFilesWriter:
        return RecordFilesWriter(self.options["path"], overwrite)


def sink_json_files(
    records: DataFrame, path: str, stem: str = "doc_id", keys: tuple[str, ...] = ("doc_id",),
    mode: str = "append",
) -> None:
    """Write every record as a file ``{stem}_{method}.json``, in a folder per task.

    Folders hold FOLDER_FILES files each. Objects hold the ``keys``, nulls and the fields of their
    method, indented by two. Records of
    one stem in one task get ``~2`` and so on before their ending, in others their folder tells
    them apart. Records of no known method hold their keys alone. ``mode`` is append or
    overwrite; readers see no file before the whole job is committed. Without rows nothing is
    written. The path must be one that Python's Arrow file systems can open.
    """
    spark = records.sparkSession
    ship_package(spark)
    spark.dataSource.register(RecordFiles)
    named = record_json(with_output_name(records, stem), *keys)
    rejected = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = named.select("output_name", F.coalesce("json", rejected).alias("value"))
    rows.write.format(FORMAT).mode(mode).save(path)


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the committed files of a folder, each whole."""
    ship_package(spark)
    spark.dataSource.register(RecordFiles)
    return spark.read.format(FORMAT).load(path).withColumnRenamed("output_name", "file")
