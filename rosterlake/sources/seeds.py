"""The seed list between runs."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rosterlake import schema, vocab

_CACHE_SCHEMA = T.StructType([
    *[f for f in schema.SEED_SCHEMA if f.name not in ("state", "stream")],
    T.StructField("pos", T.LongType()),
    T.StructField("generated_at", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stream", T.StringType()),
])


def write_seeds(seeds: DataFrame, path: str, now: datetime | None = None) -> None:
    """Replace the seed lists of the states and streams in ``seeds``."""
    stamp = (now or datetime.now(timezone.utc)).isoformat()
    rows = seeds.select(
        *schema.SEED_COLUMNS, F.col("pos").cast("bigint").alias("pos"),
        F.lit(stamp).alias("generated_at"),
    )
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("state", "stream")
        .parquet(path)
    )


def read_seeds(
    spark: SparkSession, path: str, state: str, stream: str, *,
    ttl_days: int = vocab.SEED_TTL_DAYS, now: datetime | None = None,
) -> DataFrame | None:
    """The seed list of a state and stream if it is fresh, else None.

    Fresh means its first row's stamp is at most ``ttl_days`` old; a stamp
    without a zone is UTC, an unreadable one or an empty list is not fresh.
    """
    try:
        rows = spark.read.schema(_CACHE_SCHEMA).parquet(path)
        chosen = rows.where((F.col("state") == state) & (F.col("stream") == stream))
        first = chosen.agg(F.min_by("generated_at", "pos").alias("g")).first()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    try:
        stamp = datetime.fromisoformat(first["g"] or "")
    except ValueError:
        return None
    if stamp.tzinfo is None:
        stamp = stamp.replace(tzinfo=timezone.utc)
    if (now or datetime.now(timezone.utc)) - stamp > timedelta(days=ttl_days):
        return None
    return chosen.select(*schema.SEED_COLUMNS, "pos")
