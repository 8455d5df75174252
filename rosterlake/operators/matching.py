"""Attach phone numbers of one roster to the organisations of another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rosterlake.functions.phones import phones_in_roster_cell
from rosterlake.functions.text import clean_cell, normalize_name, repair_name

#: Strictest first: the columns two rows must agree on.
STAGES = (
    ("name_state_stream", ("k_name", "k_state", "k_stream")),
    ("name_state", ("k_name", "k_state")),
    ("name", ("k_name",)),
)


def match_keys(df: DataFrame) -> DataFrame:
    """Key columns from ``name``, ``state`` and ``stream`` cells."""

    def folded(name: str):
        return F.lower(F.coalesce(clean_cell(F.col(name)), F.lit("")))

    return df.withColumns({
        "k_name": normalize_name(repair_name(clean_cell(F.col("name")))),
        "k_state": folded("state"),
        "k_stream": folded("stream"),
    })


def phone_sightings(contacts: DataFrame) -> DataFrame:
    """One row per number in a contact roster with its place in the file.

    ``contacts`` has pos, name, state, stream and phones. Rows without a name or
    without a usable number yield nothing.
    """
    listed = match_keys(contacts).where(clean_cell(F.col("name")).isNotNull()).select(
        "k_name", "k_state", "k_stream", "pos",
        F.posexplode(phones_in_roster_cell(clean_cell(F.col("phones")))).alias("i", "phone"),
    )
    return listed.select("k_name", "k_state", "k_stream", "phone", F.struct("pos", "i").alias("at"))


def phone_indexes(sightings: DataFrame) -> dict[str, DataFrame]:
    """Distinct numbers per key at each stage, first seen first.

    Each coarser stage is built from the finer one, so every repetition is
    folded once, before its exchange.
    """
    indexes, finer = {}, sightings
    for stage, keys in STAGES:
        finer = finer.groupBy(*keys, "phone").agg(F.min("at").alias("at"))
        indexes[stage] = finer
    return indexes


def stage_matches(
    orgs: DataFrame, indexes: dict[str, DataFrame], *, allow_name_only: bool = False,
) -> DataFrame:
    """Organisations with the strictest stage that matches, its first number and how many there are.

    Every lookup side has one row per key, so the row count of ``orgs`` never
    changes however often a key occurs on either side. Only two small values come from
    a key, folded before the exchange; its numbers stay rows of the index.
    """
    stages = STAGES if allow_name_only else STAGES[:-1]
    joined = match_keys(orgs)
    for stage, keys in stages:
        one = indexes[stage].groupBy(*keys).agg(F.struct(
            F.lit(stage).alias("stage"), F.min_by("phone", "at").alias("first_phone"), F.count(F.lit(1)).alias("n_phones")
        ).alias(f"hit_{stage}"))
        joined = joined.join(one, list(keys), "left")
    hit = F.coalesce(*[F.col(f"hit_{stage}") for stage, _ in stages])
    return joined.withColumn("_hit", hit).select(
        *orgs.columns, "k_name", "k_state", "k_stream",
        F.coalesce("_hit.stage", F.lit("unmatched")).alias("match_stage"),
        F.col("_hit.first_phone").alias("first_phone"),
        F.coalesce("_hit.n_phones", F.lit(0)).alias("n_phones"),
    )


def matched_phones(staged: DataFrame, indexes: dict[str, DataFrame]) -> DataFrame:
    """One row per organisation key and number of its stage: k_name, k_state, k_stream, match_stage, phone, at.

    Keys that organisations share appear once, and no key's numbers are gathered.
    """
    keyed = staged.select("k_name", "k_state", "k_stream", "match_stage").distinct()
    found = [keyed.where(F.col("match_stage") == stage).join(indexes[stage].select(*keys, "phone", "at"), list(keys)) for stage, keys in STAGES]
    return reduce(DataFrame.unionByName, found)


def staged_match(
    orgs: DataFrame, indexes: dict[str, DataFrame], *, allow_name_only: bool = False,
) -> DataFrame:
    """``stage_matches`` with all numbers of the stage as one cell of text, as files want them.

    The cell is the one place where the numbers of a key come together; use
    ``matched_phones`` for anything but writing.
    """
    staged = stage_matches(orgs, indexes, allow_name_only=allow_name_only)
    listed = F.array_sort(F.collect_list(F.struct("at", "phone")))
    key = ["k_name", "k_state", "k_stream", "match_stage"]
    cells = matched_phones(staged, indexes).groupBy(*key).agg(
        F.array_join(F.transform(listed, lambda x: x["phone"]), ", ").alias("cell")
    )
    return staged.join(cells, key, "left").select(
        *orgs.columns, "match_stage", "first_phone", "n_phones", F.coalesce("cell", F.lit("")).alias("all_phones_found")
    )


def match_report(matched: DataFrame, sightings: DataFrame | None = None) -> DataFrame:
    """(match_stage, n): rows per match stage; an unmatched row without a name is counted apart.

    The items ``rows`` and ``matched`` count all organisations and those with any match;
    with ``sightings``, ``with_phones`` counts the contact rows that gave a number.
    """
    nameless = clean_cell(F.col("name")).isNull() & (F.col("match_stage") == "unmatched")
    stages = (
        matched.withColumn("match_stage", F.when(nameless, "no_name").otherwise(F.col("match_stage")))
        .groupBy("match_stage")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = matched.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("match_stage") != "unmatched").alias("matched")
    ).unpivot([], ["rows", "matched"], "match_stage", "n")
    report = stages.unionByName(totals)
    if sightings is None:
        return report
    contact_rows = sightings.select("at.pos").distinct().agg(F.count(F.lit(1)).alias("n"))
    return report.unionByName(contact_rows.select(F.lit("with_phones").alias("match_stage"), "n"))


def unmatched_sample(matched: DataFrame, limit: int = 25) -> DataFrame:
    """The first unmatched names in row order."""
    return (
        matched.where((F.col("match_stage") == "unmatched") & clean_cell(F.col("name")).isNotNull())
        .orderBy("pos")
        .select(clean_cell(F.col("name")).alias("name"))
        .limit(limit)
    )
