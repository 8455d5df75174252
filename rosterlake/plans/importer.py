"""Import contact files into the store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.functions.emails import emails_in_cell
from rosterlake.functions.phones import phones_in_cell
from rosterlake.functions.text import clean_cell, classify_stream, present, with_scheme
from rosterlake.operators.merge import first_filled, with_key
from rosterlake.sources.store import RosterStore
from rosterlake.sources.tables import ContactFiles, read_contact_files, unmapped_headers

_FIELDS = tuple(field for field, _ in vocab.HEADER_ALIASES)


def _rest(values):
    return F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))


def import_rows(cells: DataFrame, *, default_state: str = "", default_stream: str = "Engineering") -> DataFrame:
    """Mapped cells as records, each with a ``reject`` reason (NULL = accepted)."""
    clean = cells.select("pos", *[clean_cell(F.col(f)).alias(f) for f in _FIELDS])
    listed = clean.withColumns({
        "_emails": emails_in_cell(F.col("placement_email")),
        "_more_emails": emails_in_cell(F.col("fallback_contact_email")),
        "_phones": phones_in_cell(F.col("placement_phone")),
        "_more_phones": phones_in_cell(F.col("fallback_contact_phone")),
    })
    name, state = F.col("college_name"), F.coalesce("state", F.nullif(F.lit(default_state), F.lit("")))
    return listed.select(
        "pos",
        name,
        state.alias("state"),
        classify_stream(F.col("stream"), default_stream).alias("stream"),
        "district",
        "affiliation",
        with_scheme(F.col("website")).alias("website"),
        "placement_officer_name",
        F.get("_emails", F.lit(0)).alias("placement_email"),
        F.get("_phones", F.lit(0)).alias("placement_phone"),
        F.concat(_rest(F.col("_emails")), _rest(F.col("_more_emails"))).alias("backup_emails_found"),
        F.concat(_rest(F.col("_phones")), _rest(F.col("_more_phones"))).alias("backup_phones_found"),
        F.get("_more_emails", F.lit(0)).alias("fallback_contact_email"),
        F.get("_more_phones", F.lit(0)).alias("fallback_contact_phone"),
        F.lit(0).alias("confidence_score"),
        F.array().cast("array<string>").alias("source_urls"),
        F.lit(False).alias("email_verified"),
        F.lit(None).cast("timestamp").alias("last_scraped"),
        F.lit("Needs Follow-up").alias("status"),
        F.when(~present(name) | (F.length(name) < 3), F.lit("no_name"))
        .when(~present(state), F.lit("no_state"))
        .alias("reject"),
    )


def import_counts(rows: DataFrame) -> DataFrame:
    """Rows per state, per stream, in total and per reject reason, in one pass.

    Columns: scope, item, n, complete.
    """
    has_email = present(F.col("placement_email")) | present(F.col("fallback_contact_email"))
    has_phone = present(F.col("placement_phone")) | present(F.col("fallback_contact_phone"))
    taken = F.col("reject").isNull()
    flagged = rows.select(
        F.when(taken, F.col("state")).alias("state"),
        F.when(taken, F.col("stream")).alias("stream"),
        F.coalesce("reject", F.lit("accepted")).alias("verdict"),
        (taken & has_email & has_phone).cast("int").alias("complete"),
    )
    sets = [["state"], ["stream"], ["verdict"], []]
    counted = flagged.groupingSets(
        [[F.col(c) for c in s] for s in sets], "state", "stream", "verdict"
    ).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("complete").alias("complete"),
    )
    scope = (
        F.when(F.col("g") == 3, F.lit("state")).when(F.col("g") == 5, F.lit("stream"))
        .when(F.col("g") == 6, F.lit("verdict")).otherwise(F.lit("all"))
    )
    item = F.coalesce("state", "stream", "verdict")
    return counted.select(
        scope.alias("scope"), item.alias("item"), "n", "complete"
    ).where(~(F.col("scope").isin("state", "stream") & F.col("item").isNull()))


def dedupe_file(rows: DataFrame) -> DataFrame:
    """Accepted rows folded to one per key, with the number of ``copies``."""
    accepted = with_key(rows.where(F.col("reject").isNull()).drop("reject"))
    return first_filled(accepted, schema.KEY)


@dataclass
class ImportPlan:
    """What an import would write, and what it says about the files.

    ``files``: file, utf8, headers and the fields they feed; ``unmapped``: (file,
    header) of the headers that feed none; ``pos`` orders the rows of a file.
    """

    files: DataFrame
    unmapped: DataFrame
    rows: DataFrame
    records: DataFrame

    def report(self) -> DataFrame:
        """Counts per scope; the ``file`` scope counts key merges.

        ``merged_states`` are keys that bring together rows of several states:
        the state is not part of the key.
        """
        accepted = with_key(self.rows.where(F.col("reject").isNull()))
        keyed = accepted.groupBy(*schema.KEY).agg(
            F.count(F.lit(1)).alias("copies"), F.min("state").alias("lo"), F.max("state").alias("hi")
        )
        merged = keyed.agg(
            F.struct(F.lit("records").alias("item"), F.count(F.lit(1)).alias("n")).alias("a"),
            F.struct(F.lit("duplicates").alias("item"),
                     F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).alias("b"),
            F.struct(F.lit("merged_states").alias("item"),
                     F.count_if(F.col("lo") != F.col("hi")).alias("n")).alias("c"),
        ).select(F.explode(F.array("a", "b", "c")).alias("x"))
        return import_counts(self.rows).unionByName(
            merged.select(F.lit("file").alias("scope"), "x.item", "x.n",
                          F.lit(None).cast("bigint").alias("complete"))
        )


def plan_import(found: ContactFiles, *, default_state: str = "", default_stream: str = "Engineering") -> ImportPlan:
    rows = import_rows(found.mapped(_FIELDS), default_state=default_state, default_stream=default_stream)
    return ImportPlan(found.files, unmapped_headers(found.files), rows, dedupe_file(rows))


def import_files(
    store: RosterStore, path: str | Sequence[str], *, default_state: str = "", default_stream: str = "Engineering",
    dry_run: bool = False, multiline: bool = True,
) -> ImportPlan:
    """Read, map, clean, dedupe and (unless ``dry_run``) upsert contact files."""
    spark: SparkSession = store.spark
    plan = plan_import(
        read_contact_files(spark, path, multiline=multiline),
        default_state=default_state, default_stream=default_stream,
    )
    if not dry_run:
        # One record per key is left, so their order no longer matters.
        store.upsert(plan.records.select(*schema.RECORD_COLUMNS, F.lit(0).cast("bigint").alias("pos")))
    return plan
