"""Growing the roster: new candidates and where a growth run stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.text import normalize_name
from rosterlake.operators.ranges import running_sums


def with_name_key(rows: DataFrame, name: str = "college_name", out: str = "name_key") -> DataFrame:
    """Add the match key of a name, worked out once for each distinct name."""
    keys = rows.select(F.col(name).alias("_name")).distinct().withColumn(out, normalize_name(F.col("_name")))
    return rows.join(keys, F.col(name).eqNullSafe(F.col("_name"))).drop("_name")


def new_candidates(
    seeds: DataFrame, stored: DataFrame, targets: Sequence[tuple[str, str]] = vocab.GROW_TARGETS,
    *, by: Sequence[str] = ("name_key",), pos: str = "pos",
) -> DataFrame:
    """Seeds the store does not hold yet, each name once, in target order.

    ``by`` are the columns that make two rows the same; the default is the
    normalised name alone. Copies of a name as written fold first, so that names are
    normalised once each; then those of one key fold, before the anti-join.
    """
    order = F.coalesce(*[
        F.when((F.col("state") == state) & (F.col("stream") == stream), F.lit(i))
        for i, (state, stream) in enumerate(targets)
    ])

    def first_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        columns = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct("target_no", pos)).alias("f")).select(*keys, "f.*")

    wanted = seeds.withColumn("target_no", order).where(F.col("target_no").isNotNull())
    spelled = first_of(wanted, ["college_name", *[c for c in by if c != "name_key"]])
    keyed = spelled.withColumn("name_key", normalize_name(F.col("college_name"))).where(F.col("name_key") != "")
    have = stored.withColumn("name_key", F.col("normalized_name")).select(*by).distinct()
    columns = [*seeds.columns, "name_key", "target_no"]
    return first_of(keyed, list(by)).join(have, list(by), "left_anti").select(*columns)


def grow_report(seeds: DataFrame, fresh: DataFrame) -> DataFrame:
    """Seeded and new rows per state and stream."""
    both = seeds.select("state", "stream", F.lit(1).alias("s"), F.lit(0).alias("n")).unionByName(
        fresh.select("state", "stream", F.lit(0).alias("s"), F.lit(1).alias("n"))
    )
    return both.groupBy("state", "stream").agg(
        F.sum("s").alias("seeded"), F.sum("n").alias("new")
    )


def grow_until(
    attempts: DataFrame, target: int, *, start: int = 0, order: Sequence[str] = ("seq",),
    abort_after: int = vocab.ABORT_AFTER, abort_below: float = vocab.ABORT_BELOW,
) -> DataFrame:
    """Attempts up to the one that ends a growth run.

    ``attempts`` has an order and ``complete`` (both contacts found). The run
    ends with the attempt that reaches the target, or with the first attempt
    from number ``abort_after`` on that finds fewer than ``abort_below`` of the
    attempts so far complete; an aborting attempt's own contacts do not count.
    """
    done = F.when(F.col("complete"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = running_sums(
        attempts, {"attempted": F.lit(1).cast("bigint"), "completed": done}, order
    )
    before = F.col("completed") - done
    aborts = (F.col("attempted") >= abort_after) & (before / F.col("attempted") < abort_below)
    reaches = F.col("completed") + F.lit(start) >= F.lit(target)
    judged = counted.withColumn(
        "outcome",
        F.when(aborts, F.lit("aborted")).when(reaches, F.lit("target reached")).otherwise(F.lit("continue")),
    )
    last = judged.where(F.col("outcome") != "continue").agg(F.min("attempted").alias("last"))
    return judged.where(
        F.col("attempted") <= F.coalesce(last.scalar(), F.lit((1 << 63) - 1))
    )
