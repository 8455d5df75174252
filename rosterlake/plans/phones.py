"""Merge a phone roster into an organisation roster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake.operators.matching import (
    match_report, phone_indexes, phone_sightings, stage_matches, staged_match, unmatched_sample,
)
from rosterlake.session import cut_lineage
from rosterlake.sources.tables import read_contact_files, read_roster


@dataclass
class PhoneMerge:
    matched: DataFrame
    report: DataFrame
    unmatched: DataFrame
    numbers: DataFrame


def merge_phones(orgs: DataFrame, contacts: DataFrame, *, allow_name_only: bool = False) -> PhoneMerge:
    """``numbers`` holds every number per name; ``matched`` one row per organisation."""
    sightings = cut_lineage(phone_sightings(contacts))
    indexes = phone_indexes(sightings)
    staged = stage_matches(orgs, indexes, allow_name_only=allow_name_only)
    matched = staged_match(orgs, indexes, allow_name_only=allow_name_only)
    return PhoneMerge(matched, match_report(staged, sightings), unmatched_sample(staged), indexes["name_state_stream"])


def merge_phone_files(
    spark: SparkSession, orgs_path: str, contacts_path: str, out_path: str | None = None, *,
    allow_name_only: bool = False,
) -> PhoneMerge:
    """The file job: all columns of the organisation file plus ``all_phones_found``."""
    found = read_contact_files(spark, orgs_path)
    keys = found.mapped(("college_name", "state", "stream")).withColumnRenamed("college_name", "name")
    result = merge_phones(
        keys, read_roster(spark, contacts_path, with_phones=True), allow_name_only=allow_name_only
    )
    if out_path is not None:
        phones = result.matched.select("pos", "all_phones_found")
        names = [h for h in found.headers() if h != "all_phones_found"]
        # Cells are taken by place; columns get their own names at the very end.
        places = [i for i, h in enumerate(found.headers()) if h != "all_phones_found"]
        joined = found.cells.join(phones, "pos").orderBy("pos")
        columns = [F.get("cells", F.lit(i)).alias(n) for i, n in zip(places, names, strict=True)]
        joined.select(*columns, "all_phones_found").write.mode("overwrite").csv(
            out_path, header=True, quote='"', escape='"', emptyValue=""
        )
    return result
