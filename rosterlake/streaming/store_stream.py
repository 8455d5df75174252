"""Results stored as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rosterlake import schema
from rosterlake.operators.ledger import run_counters
from rosterlake.sources.store import RosterStore

#: Result records as files in the stream source; pos orders records of one key.
RESULT_STREAM_SCHEMA = T.StructType([
    *[schema.STORE_SCHEMA[c] for c in schema.RECORD_COLUMNS],
    T.StructField("pos", T.LongType()),
])


def read_results(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(RESULT_STREAM_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


@dataclass
class StreamRun:
    """A running stream and the ledger that its events go to."""

    spark: SparkSession
    query: StreamingQuery
    run_id: str
    ledger_path: str
    state: str | None = None
    stream: str | None = None
    stopped: bool = False

    def stop(self) -> None:
        """End the run before its source does; what is stored stays."""
        self.stopped = True
        self.query.stop()

    def finish(self) -> str:
        """Wait for the end, append the terminal event and return its status.

        completed, cancelled after ``stop``, or failed, with the reason as a note. A
        run that is started again has another end of its own; the latest counts.
        """
        status, notes = "completed", None
        try:
            self.query.awaitTermination()
            status = "cancelled" if self.stopped else status
        except StreamingQueryException as problem:
            status, notes = "failed", str(problem)
        none = self.spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("processed", "succeeded", "failed")])
        _append(none, self.ledger_path, self.run_id, f"end {self.query.runId}", 0, status, notes, self.state, self.stream)
        return status


def _append(
    counters: DataFrame, path: str, run_id: str, source: str, seq: int, status: str, notes: str | None, state: str | None, stream: str | None
) -> None:
    """Append one event to a run ledger; ``counters`` is one row of processed, succeeded, failed."""
    values = {
        "run_id": F.lit(run_id), "source": F.lit(source), "seq": F.lit(seq), "at": F.current_timestamp(), "state": F.lit(state),
        "stream": F.lit(stream), "status": F.lit(status), "total_colleges": F.lit(0), "notes": F.lit(notes),
    }
    event = counters.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.RUN_EVENT_SCHEMA])
    event.write.mode("append").parquet(path)


def count_results(
    results: DataFrame, *, run_id: str, ledger_path: str, checkpoint: str, state: str | None = None, stream: str | None = None,
    trigger: dict | None = None, store: RosterStore | None = None,
) -> StreamRun:
    """Append the counters of each micro-batch to the run ledger, after upserting it into ``store`` if there is one.

    ``results`` has a ``status``. A batch that is delivered again merges into the same
    keys and repeats the event (run, stream, batch), which counts once.
    """

    def take(batch: DataFrame, number: int) -> None:
        if store is not None:
            store.upsert(batch)
        _append(run_counters(batch, ()), ledger_path, run_id, "stream", number, "running", None, state, stream)

    query = (
        results.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    return StreamRun(results.sparkSession, query, run_id, ledger_path, state, stream)


def store_results(results: DataFrame, store: RosterStore, **options) -> StreamRun:
    """Upsert each micro-batch and append its counters; see ``count_results``.

    A run that stops or fails keeps what it stored, and goes on from there when it is
    started again with the same checkpoint.
    """
    return count_results(results, store=store, **options)
