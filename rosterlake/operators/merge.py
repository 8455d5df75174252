"""Folding records into one row per key: upsert, corrections, file dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rosterlake import schema, vocab
from rosterlake.functions.text import normalize_district, normalize_name, present


def with_key(records: DataFrame) -> DataFrame:
    """Derive the match key: normalised name and district beside the stream."""
    return records.withColumns({
        "normalized_name": normalize_name(F.col("college_name")),
        "district": normalize_district(F.col("district")),
    })


def _holds_something(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return present(c)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def first_filled(
    records: DataFrame, keys: Sequence[str], pos: str = "pos", count: str = "copies"
) -> DataFrame:
    """One row per key; each column takes its first non-empty value in row order.

    A two-stage aggregation: copies of a key are folded on the map side first.
    """
    kinds = {f.name: f.dataType for f in records.schema}
    return records.groupBy(*keys).agg(
        *[
            F.min_by(c, F.when(_holds_something(c, kinds[c]), F.col(pos))).alias(c)
            for c in records.columns
            if c not in keys and c != pos
        ],
        F.min(pos).alias(pos),
        F.count(F.lit(1)).alias(count),
    )


def require_streams(records: DataFrame) -> DataFrame:
    """Fail the job on a record whose stream is not a known one."""
    known = F.col("stream").isin(*vocab.STREAMS)
    return records.withColumn(
        "stream",
        F.when(F.coalesce(known, F.lit(False)), F.col("stream")).otherwise(
            F.raise_error(F.concat(F.lit("invalid stream: "), F.coalesce("stream", F.lit("NULL"))))
        ),
    )


def upsert(stored: DataFrame, incoming: DataFrame, now: Column, pos: str = "pos") -> DataFrame:
    """Stored rows with the incoming records merged in, one row per key.

    ``incoming`` carries the key, the record columns and ``pos``, the order in
    which records apply. Contact and site fields keep their last non-empty
    value, the score its maximum, the other columns their last value; state,
    outreach status and creation time stay as first stored. The stored row takes
    part as the record before all others, so one aggregation does the folding
    and the merge, and copies of a hot key are folded before the exchange.
    """
    offered = (
        F.col("outreach_status") if "outreach_status" in incoming.columns else F.lit(None).cast("string")
    )
    old = stored.select(*schema.STORE_COLUMNS, F.lit(-1).cast("bigint").alias("_pos"))
    new = incoming.select(
        *[F.col(c) for c in schema.STORE_COLUMNS if c in schema.RECORD_COLUMNS or c in schema.KEY],
        offered.alias("outreach_status"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.col(pos).cast("bigint").alias("_pos"),
    )
    at = F.col("_pos")
    was_stored = at == -1
    folded = old.unionByName(new).groupBy(*schema.KEY).agg(
        F.max_by(F.struct(*schema.OVERWRITE_COLUMNS), at).alias("last"),
        *[F.max_by(c, F.when(present(F.col(c)), at)).alias(c) for c in schema.FILL_COLUMNS],
        F.max(F.coalesce("confidence_score", F.lit(0))).alias("confidence_score"),
        F.min_by("state", at).alias("state"),
        F.min_by(
            F.struct("outreach_status", "created_at", "updated_at"), F.when(was_stored, at)
        ).alias("kept"),
        F.min_by("outreach_status", F.when(F.col("outreach_status").isin(*vocab.OUTREACH), at))
        .alias("offered"),
        F.max(at).alias("last_pos"),
    )
    final = {
        **{c: F.col(f"last.{c}") for c in schema.OVERWRITE_COLUMNS},
        "outreach_status": F.coalesce("kept.outreach_status", "offered", F.lit(vocab.OUTREACH[0])),
        "created_at": F.coalesce("kept.created_at", now),
        "updated_at": F.when(F.col("last_pos") == -1, F.col("kept.updated_at")).otherwise(now),
    }
    return folded.select(*[
        final.get(c, F.col(c)).cast(schema.STORE_SCHEMA[c].dataType).alias(c)
        for c in schema.STORE_COLUMNS
    ])


def require_edits(corrections: DataFrame) -> DataFrame:
    """Fail the job on a key of which no column at all may be edited: an empty edit is a mistake of its sender."""
    editable = F.coalesce(F.col("column").isin(*schema.EDITABLE), F.lit(False))
    empty = corrections.groupBy(*schema.KEY).agg(F.bool_or(editable).alias("some")).where(~F.col("some"))
    first = empty.select(F.concat_ws("|", *schema.KEY).alias("key")).head(1)
    if first:
        raise ValueError(f"nothing to edit for {first[0]['key']}")
    return corrections


def apply_corrections(stored: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """Set hand-edited columns of stored rows.

    ``corrections`` has the key columns, ``column``, ``value`` and ``seq``; the
    last value per column wins. Columns that may not be edited, unknown outreach
    values and unknown keys change nothing.
    """
    allowed = corrections.where(
        F.col("column").isin(*schema.EDITABLE)
        & ((F.col("column") != "outreach_status") | F.col("value").isin(*vocab.OUTREACH))
    )
    edits = allowed.groupBy(*schema.KEY).agg(*[
        F.max_by(F.struct("value"), F.when(F.col("column") == c, F.col("seq"))).alias(f"_{c}")
        for c in schema.EDITABLE
    ], F.lit(True).alias("_edited"))
    joined = stored.join(edits, list(schema.KEY), "left")
    changed = {
        c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.value")).otherwise(F.col(c)).alias(c)
        for c in schema.EDITABLE
    }
    stamp = F.when(F.col("_edited"), now).otherwise(F.col("updated_at")).alias("updated_at")
    return joined.select(*[
        changed.get(c, stamp if c == "updated_at" else F.col(c)) for c in schema.STORE_COLUMNS
    ])
