"""Running totals and ranks over groups of any size.

A plain window puts one whole group into one task. Here the rows are cut into
even ranges of (group, order) first; each range is summed on its own and the
totals of the ranges before it are added afterwards, so a group holding a third
of all rows is spread over a third of the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlake.session import cut_lineage


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums``.

    ``order`` must be unique within ``keys``. The ranged rows are written to the
    checkpoint folder because they are read twice and the range borders must be
    the same both times.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    widened = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    ranged = cut_lineage(
        widened.repartitionByRange(count, *[F.col(c) for c in (*keys, *order)]).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    # A struct is never NULL, so a group with a NULL key joins like any other.
    keyed = ranged.withColumn("_group", F.struct(*keys, F.lit(0).alias("_")))
    inside = (
        Window.partitionBy("_group", "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # One row per group and range: at most (number of groups + number of ranges).
    before = (
        Window.partitionBy("_group")
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = keyed.groupBy("_group", "_range").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    offsets = totals.select(
        "_group", "_range",
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    local = keyed.select(
        "*", *[F.sum(f"_v_{name}").over(inside).alias(f"_l_{name}") for name in sums]
    )
    return local.join(offsets, ["_group", "_range"], "inner").select(
        *df.columns,
        *[(F.col(f"_l_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums],
    )


def rank_rows(
    df: DataFrame, out: str, order: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Row number within ``keys`` by ``order``, without a one-task group."""
    return running_sums(df, {out: F.lit(1).cast("bigint")}, order, keys)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
               number: str = "row_no") -> DataFrame:
    """The first ``limit`` rows per group, numbered from 1.

    Spark prunes each map task to ``limit`` rows per group before the exchange,
    so the size of a group does not matter.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(number, F.row_number().over(by)).where(F.col(number) <= limit)
