"""Corrected uploads: the newest version of a document counts, an older one is refused.

Keyed state per document holds its newest version alone, on whichever executor has the key;
a timer forgets documents that nobody has corrected for a while. Needs the RocksDB state store
(``with_keyed_state``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from billwright.operators.records import structure_records
from billwright.streaming.ingest import _write_batches

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"
UPLOAD_SCHEMA = "doc_id long, version long, text string, uploaded timestamp"
ACCEPTED, STALE = "accepted", "stale"
#: Uploads of one document that are put into the order of their versions at a time.
SORTED_ROWS = 10_000


class NewestVersion(StatefulProcessor):
    """Marks each upload of a document as accepted or stale, in the order of their versions."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "version long, forget long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.newest.get()
        version, forget = (held[0], held[1]) if held else (None, None)
        last = None
        while part := list(islice(rows, SORTED_ROWS)):
            part.sort(key=lambda row: row["version"])
            for row in part:
                own, at = row["version"], row["micros"]
                newer = version is None or own > version
                version = own if newer else version
                last = at if last is None else max(last, at)
                yield Row(
                    doc_id=row["doc_id"],
                    version=own,
                    text=row["text"],
                    micros=at,
                    verdict=ACCEPTED if newer else STALE,
                )
        until = last // 1000 + self.keep_ms
        if forget is None or until > forget:
            if forget is not None:
                self.handle.deleteTimer(forget)
            self.handle.registerTimer(until)
            forget = until
        self.newest.update((version, forget))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged_uploads(uploads: DataFrame, late_by: str, keep_days: int = 30) -> DataFrame:
    """A stream of ``UPLOAD_SCHEMA`` with ``verdict``: accepted, or stale.

    An upload is stale if its document has an upload of the same or a later version before
    it (in a micro-batch, uploads of a document are taken in the order of their versions). A
    document's version is forgotten ``keep_days`` after its last upload, by the watermark. Uploads
    without an id, a version or a time are left out here; see ``unversioned``.
    """
    sound = uploads.filter("doc_id IS NOT NULL AND version IS NOT NULL AND uploaded IS NOT NULL")
    # rows, not a pandas table per document; times as numbers, so that no time zone touches them
    judged = (
        sound.withWatermark("uploaded", late_by)
        .withColumn("micros", F.unix_micros("uploaded"))
        .groupBy("doc_id")
        .transformWithState(
            statefulProcessor=NewestVersion(keep_days * 86_400_000),
            outputStructType="doc_id long, version long, text string, micros long, verdict string",
            outputMode="append",
            timeMode="eventTime",
        )
    )
    uploaded = F.timestamp_micros("micros").alias("uploaded")
    return judged.select("doc_id", "version", "text", uploaded, "verdict")


def unversioned(uploads: DataFrame) -> DataFrame:
    """Uploads that no version can be told of, with their ``error_class``."""
    lacking = (
        F.when(F.col("doc_id").isNull(), "no_id")
        .when(F.col("version").isNull(), "no_version")
        .when(F.col("uploaded").isNull(), "no_time")
    )
    return uploads.withColumn("error_class", lacking).filter("error_class IS NOT NULL")


def with_keyed_state(
    spark: SparkSession, start: Callable[[], StreamingQuery], partitions: int | None = None
) -> StreamingQuery:
    """Start a query whose state lies in RocksDB; other queries of the session keep theirs.

    ``partitions`` of the state are fixed by the first run (default: the session's shuffle
    partitions).
    """
    wanted = {PROVIDER_KEY: PROVIDER}
    if partitions is not None:
        wanted[PARTITIONS_KEY] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        return start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def ingest_corrections(
    uploads: DataFrame,
    output: str,
    checkpoint: str,
    late_by: str = "1 day",
    keep_days: int = 30,
    partitions: int | None = None,
) -> StreamingQuery:
    """Extract the records of accepted uploads into a table; stale ones are kept with their verdict.

    One run over what has come; a later run goes on from the checkpoint, with its state, of which
    each of the ``partitions`` is a Python worker's task in every micro-batch.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        return structure_records(batch)

    judged = judged_uploads(uploads, late_by, keep_days)
    writer = (
        judged.writeStream.outputMode("append")
        .foreachBatch(_write_batches(output, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    return with_keyed_state(uploads.sparkSession, writer.start, partitions)


def current_records(table: DataFrame) -> DataFrame:
    """The record of each document's newest accepted version, from the table of all runs."""
    accepted = table.filter(F.col("verdict") == ACCEPTED)
    newest = accepted.groupBy("doc_id").agg(F.max("version").alias("__newest"))
    newest = newest.withColumnRenamed("doc_id", "__doc")
    same = (F.col("doc_id") == F.col("__doc")) & (F.col("version") == F.col("__newest"))
    return accepted.join(newest, same).drop("__doc", "__newest")
