"""Incremental extraction: the batch operators on a file stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from billwright.operators.records import structure_records
from billwright.operators.reports import processed_per_day, processed_per_session
from billwright.session import spread


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: str,
    name_filter: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New parquet files of a landing folder, as a stream; ``max_files`` to a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def drop_repeats(docs: DataFrame, key: list[str], ts: str, within: str) -> DataFrame:
    """Documents uploaded again within the given time count once."""
    return docs.withWatermark(ts, within).dropDuplicatesWithinWatermark(key)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished run's watermarks left out, counted over its stateful steps.

    A watermark is how late a row may come; rows later than that are no part of the result,
    and this is their number.
    """
    steps = [s for p in query.recentProgress for s in p["stateOperators"]]
    return sum(s["numRowsDroppedByWatermark"] for s in steps)


def _write_batches(
    output: str, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch, replaced as a whole when a batch is retried.
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return write


def incremental_ingest(
    docs: DataFrame,
    output: str,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame] = structure_records,
    partitions: int | None = None,
) -> StreamingQuery:
    """Extract records from a stream of texts into a table, without any state.

    ``partitions`` deals each micro-batch out, for batches of few files.
    Failed documents are written too, with their ``error_class``.
    """

    def prepare(batch: DataFrame) -> DataFrame:
        return extract(spread(batch, partitions))

    return (
        docs.writeStream.foreachBatch(_write_batches(output, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_counts(
    docs: DataFrame, output: str, checkpoint: str, ts: str, late_by: str
) -> StreamingQuery:
    """Documents per day from a stream; each batch writes the days it changed."""
    return (
        processed_per_day(docs.withWatermark(ts, late_by), ts)
        .writeStream.outputMode("update")
        .foreachBatch(_write_batches(output))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_daily_counts(spark: SparkSession, output: str) -> DataFrame:
    """Current count of each day: the one its last micro-batch wrote."""
    return (
        spark.read.parquet(output)
        .groupBy("day")
        .agg(F.max_by("documents", "batch_id").alias("documents"))
    )


def session_counts(
    docs: DataFrame, output: str, checkpoint: str, key: str, ts: str, gap: str, late_by: str
) -> StreamingQuery:
    """Sessions of a stream, each written once it is closed: no row within ``late_by`` can join it.

    State is one row per open session; rows that join two of them merge both.
    """
    sessions = processed_per_session(docs.withWatermark(ts, late_by), key, ts, gap)
    return append_table(sessions, output, checkpoint)


def unanswered(
    uploads: DataFrame, results: DataFrame, key: str, uploaded: str, finished: str, within: str, late_by: str
) -> DataFrame:
    """Uploads of a stream without a result of another stream in the given time.

    ``uploads`` and ``results`` are streams with the key and a time each, which may come
    ``late_by`` out of order. An upload is given out, with its columns, once no result can come
    any more; state holds the uploads and results of that time alone. Rows of a null key are
    never answered.
    """
    up = uploads.withWatermark(uploaded, late_by)
    done = results.select(F.col(key).alias("__key"), F.col(finished).alias("__finished"))
    done = done.withWatermark("__finished", late_by)
    in_time = F.col("__finished").between(F.col(uploaded), F.col(uploaded) + F.expr(f"INTERVAL {within}"))
    met = up.join(done, (F.col(key) == F.col("__key")) & in_time, "left")
    return met.filter(F.col("__key").isNull()).select(*uploads.columns)


def append_table(rows: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream gives out to a folder per micro-batch."""
    return (
        rows.writeStream.outputMode("append")
        .foreachBatch(_write_batches(output))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks left out, over whole runs.

    Add it with ``spark.streams.addListener`` before a query starts. It keeps one sum per run
    (``recentProgress`` forgets all but the last hundred micro-batches).
    """

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.counts.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        dropped = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.counts[run] = self.counts.get(run, 0) + dropped

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        """Late rows of a run so far; complete a moment after the run has ended."""
        return self.counts.get(str(query.runId), 0)
