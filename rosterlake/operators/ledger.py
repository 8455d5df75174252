"""Call spending and run bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.operators.ranges import running_sums


def spend_by_endpoint(calls: DataFrame, order: str = "seq") -> DataFrame:
    """Calls, credits and latest balance per endpoint and in total.

    ``calls`` has endpoint, credits_charged, balance and an order column. ``is_total``
    tells the total from calls without an endpoint; credits are summed in decimals.
    """
    return (
        calls.groupingSets([[F.col("endpoint")], []], "endpoint")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.coalesce("credits_charged", F.lit(0.0)).cast("decimal(18,6)")).alias("credits"),
            F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col(order))).alias("balance"),
            (F.grouping("endpoint") == 1).alias("is_total"),
        )
    )


def admitted_calls(calls: DataFrame, cap: float, keys: Sequence[str] = ("run_id",),
                   order: Sequence[str] = ("seq",)) -> DataFrame:
    """Calls a spend cap lets through: those made while the spend before is below it.

    The last call may overshoot the cap. Credits are summed in decimals, so the
    result does not depend on how rows are spread.
    """
    credits = F.coalesce("credits_charged", F.lit(0.0)).cast("decimal(18,6)")
    summed = running_sums(calls, {"_through": credits}, order, keys)
    return (
        summed.withColumn("spent_before", F.col("_through") - credits)
        .where(F.col("spent_before") < F.lit(cap))
        .drop("_through")
    )


def run_counters(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("status") != "Failed").alias("succeeded"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
    )


def current_runs(events: DataFrame) -> DataFrame:
    """State of each run from its events.

    An event counts once however often it was delivered: (run_id, source, seq) names it,
    so batch runs, streams and their ends may each number their events from 0.
    Events of one source are ordered by seq; where there is a ``source`` column, by time
    first. Without one all events are of one source.
    """
    sourced = "source" in events.columns
    named = events if sourced else events.withColumn("source", F.lit(""))
    told = [c for c in named.columns if c not in ("run_id", "source", "seq")]
    once = (
        named.where(F.col("status").isin(*vocab.RUN_STATUSES)).groupBy("run_id", "source", "seq")
        .agg(F.min_by(F.struct(*told), F.struct("at", *[c for c in told if c != "at"])).alias("e"))
        .select("run_id", "e.*", (F.struct("at", "seq", "source") if sourced else F.struct("seq")).alias("place"))
    )
    ended = F.col("status") != "running"
    return once.groupBy("run_id").agg(
        F.min_by("state", "place").alias("state"),
        F.min_by("stream", "place").alias("stream"),
        F.min("at").alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("finished_at"),
        F.max_by("status", "place").alias("status"),
        F.max(F.coalesce("total_colleges", F.lit(0))).alias("total_colleges"),
        F.sum(F.coalesce("processed", F.lit(0))).alias("processed"),
        F.sum(F.coalesce("succeeded", F.lit(0))).alias("succeeded"),
        F.sum(F.coalesce("failed", F.lit(0))).alias("failed"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("place"))).alias("notes"),
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger at ``path``; events of ledgers without sources are of batch runs."""
    return spark.read.schema(schema.RUN_EVENT_SCHEMA).parquet(path).fillna("batch", ["source"])


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The latest runs."""
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
