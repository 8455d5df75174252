"""Whole-store snapshots as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rosterlake import schema
from rosterlake.operators.roster import is_complete
from rosterlake.sources.store import RosterStore

#: Unlike the store, all text; the full key travels along.
SNAPSHOT_COLUMNS = tuple(c for c in schema.STORE_COLUMNS if c not in ("created_at", "updated_at"))
_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in SNAPSHOT_COLUMNS])


def counts(roster: DataFrame) -> tuple[int, int]:
    """(rows, rows seen outside)."""
    row = roster.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_complete()).alias("v")).first()
    return row["n"], row["v"]


def snapshot_rows(roster: DataFrame) -> DataFrame:
    """The store as text columns, missing values empty."""

    def text(name: str):
        c = F.col(name)
        if name in schema.LIST_COLUMNS:
            c = F.array_join(c, ", ")
        elif name == "email_verified":
            c = F.when(c, F.lit("1")).otherwise(F.lit("0"))
        elif name == "last_scraped":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        return F.coalesce(c.cast("string"), F.lit("")).alias(name)

    return roster.select(*[text(c) for c in SNAPSHOT_COLUMNS])


def export_snapshot(roster: DataFrame, path: str) -> tuple[int, int]:
    """Write all rows ordered by name; returns (rows, rows seen outside)."""
    (
        snapshot_rows(roster.orderBy("college_name", *schema.KEY))
        .write.mode("overwrite")
        .csv(path, header=True, quote='"', escape='"', emptyValue="")
    )
    return counts(roster)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot as records for the store."""
    raw = _snapshot_text(spark, path)

    def listed(name: str):
        parts = F.split(F.coalesce(F.col(name), F.lit("")), ",")
        return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    return raw.withColumns({
        **{c: listed(c) for c in schema.LIST_COLUMNS},
        "confidence_score": F.coalesce(F.col("confidence_score").try_cast("int"), F.lit(0)),
        "email_verified": F.coalesce(F.trim("email_verified").isin("1", "True", "true"), F.lit(False)),
        "last_scraped": F.try_to_timestamp("last_scraped"),
    }).drop("normalized_name").withColumn("pos", F.monotonically_increasing_id())


def restore_snapshot(store: RosterStore, path: str) -> tuple[int, int]:
    """Upsert a snapshot; rows are added or filled, never deleted."""
    records = read_snapshot(store.spark, path)
    read = records.count()
    store.upsert(records)
    return read, counts(store.read())[1]


def _snapshot_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(_SCHEMA).csv(path, header=True, quote='"', escape='"', multiLine=True)
    return raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in SNAPSHOT_COLUMNS])


def snapshot_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The rows that differ: the key, ``found`` (store, snapshot or both) and the columns that changed.

    Both sides have the snapshot's text columns. Rows are matched by key in one
    aggregation over the union, with a hash of each column folded before the exchange; a key that
    stands several times on a side counts as changed unless its rows agree.
    """
    rest = [c for c in SNAPSHOT_COLUMNS if c not in schema.KEY]
    tagged = ours.select(*SNAPSHOT_COLUMNS, F.lit(True).alias("is_ours")).unionByName(theirs.select(*SNAPSHOT_COLUMNS, F.lit(False).alias("is_ours")))
    both = tagged.groupBy(*schema.KEY).agg(
        F.count_if("is_ours").alias("n_ours"), F.count_if(~F.col("is_ours")).alias("n_theirs"),
        *[F.min(c).alias(f"lo_{c}") for c in rest], *[F.max(c).alias(f"hi_{c}") for c in rest],
    )
    changed = F.array_compact(F.array(*[F.when(F.col(f"lo_{c}") != F.col(f"hi_{c}"), F.lit(c)) for c in rest]))
    found = F.when(F.col("n_theirs") == 0, "store").when(F.col("n_ours") == 0, "snapshot").otherwise("both")
    alone = F.col("found") != "both"
    return both.select(*schema.KEY, found.alias("found"), changed.alias("changed"), "n_ours", "n_theirs").where(
        alone | (F.size("changed") > 0) | (F.col("n_ours") != F.col("n_theirs"))
    ).withColumn("changed", F.when(alone, F.array().cast("array<string>")).otherwise(F.col("changed")))


def compare_snapshot(store: RosterStore, path: str) -> DataFrame:
    """Rows and outwardly visible rows of store and snapshot, and how many rows stand in one only or differ."""
    ours, theirs = snapshot_rows(store.read()), _snapshot_text(store.spark, path)
    counted = [
        rows.agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.count_if(is_complete()).alias(f"{name}_visible"))
        for name, rows in (("store", ours), ("snapshot", theirs))
    ]
    differ = snapshot_diff(ours, theirs).agg(
        *[F.count_if(F.col("found") == x).alias(n) for x, n in (("store", "only_store"), ("snapshot", "only_snapshot"), ("both", "changed"))]
    )
    # Three frames of one row each.
    return counted[0].crossJoin(counted[1]).crossJoin(differ)
