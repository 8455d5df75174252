"""Views over the roster: projections, filters, order, counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import schema, vocab
from rosterlake.functions.text import blank_to_null, normalize_district, normalize_name


def best_email() -> Column:
    """Placement address, else fallback address, else NULL."""
    return F.coalesce(
        blank_to_null(F.col("placement_email")), blank_to_null(F.col("fallback_contact_email"))
    )


def best_phone() -> Column:
    return F.coalesce(
        blank_to_null(F.col("placement_phone")), blank_to_null(F.col("fallback_contact_phone"))
    )


def is_complete() -> Column:
    """Both an address and a number: the condition for being seen outside."""
    return best_email().isNotNull() & best_phone().isNotNull()


def _check(value: str | None, allowed, name: str) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


def by_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored rows of the given (normalized_name, district, stream) keys; a key that isn't stored gives none."""
    return rows.join(keys.select(*schema.KEY).distinct(), list(schema.KEY), "left_semi")


def one_org(rows: DataFrame, name: str, district: str, stream: str) -> DataFrame:
    """The row of one organisation, its name and district in any spelling; the key filters reach the scan."""
    key = zip(schema.KEY, (normalize_name(F.lit(name)), normalize_district(F.lit(district)), F.lit(stream)), strict=True)
    return rows.where(reduce(and_, [F.col(c) == value for c, value in key]))


def roster_filter(
    *, state: str | None = None, stream: str | None = None, status: str | None = None,
    outreach_status: str | None = None, search: str | None = None,
) -> Column:
    """All given conditions together; TRUE if none is given.

    ``search`` is literal containment, ignoring case.
    """
    _check(stream, vocab.STREAMS, "stream")
    _check(status, vocab.STATUSES, "status")
    _check(outreach_status, vocab.OUTREACH, "outreach_status")
    given = [
        F.col(name) == value
        for name, value in (
            ("state", state), ("stream", stream), ("status", status),
            ("outreach_status", outreach_status),
        )
        if value
    ]
    if search:
        given.append(F.lower("college_name").contains(search.lower()))
    return reduce(and_, given, F.lit(True))


def roster_order(sort: str | None, direction: str = "asc") -> list[Column]:
    """Order by one permitted column (default: name), key as tie-break."""
    column = F.col(sort if sort in schema.SORTABLE else "college_name")
    first = column.desc() if direction.lower() == "desc" else column.asc()
    return [first, *[F.col(k).asc() for k in schema.KEY]]


def page_of(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    paged = df.offset(offset) if offset else df
    return paged if limit is None else paged.limit(limit)


def admin_view(
    roster: DataFrame, *, sort: str | None = None, direction: str = "asc",
    limit: int | None = None, offset: int = 0, **filters,
) -> DataFrame:
    """The full record."""
    rows = roster.where(roster_filter(**filters)).orderBy(*roster_order(sort, direction))
    return page_of(rows, limit, offset)


def guard_marketing(df: DataFrame) -> DataFrame:
    """Refuse an output that carries an internal column."""
    leaked = sorted(set(df.columns) & set(schema.INTERNAL_ONLY))
    if leaked:
        raise ValueError(f"internal columns in a marketing output: {leaked}")
    return df


def _as_text(name: str, df: DataFrame) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.array_join(F.col(name), ", ") if kind == "array" else F.col(name)


def marketing_projection(roster: DataFrame) -> DataFrame:
    """Ten outward columns; the outreach column always leaves empty."""
    return guard_marketing(
        roster.select(
            "college_name", "state", "stream", "affiliation", "website",
            best_email().alias("email"),
            best_phone().alias("phone"),
            _as_text("backup_emails_found", roster).alias("all_emails_found"),
            _as_text("backup_phones_found", roster).alias("all_phones_found"),
            F.lit("").alias("outreach_status"),
        )
    )


def marketing_rows(roster: DataFrame, **filters) -> DataFrame:
    """Complete rows that pass the filters, in outward form, in no order."""
    if filters.get("status"):
        raise ValueError("the marketing view has no status filter")
    return marketing_projection(roster.where(roster_filter(**filters) & is_complete()))


def marketing_view(
    roster: DataFrame, *, sort: str | None = None, direction: str = "asc",
    limit: int | None = None, offset: int = 0, **filters,
) -> DataFrame:
    """Complete rows, filtered and ordered by any permitted column.

    The outreach column is empty in this view, so ordering by it leaves the key.
    """
    if filters.get("status"):
        raise ValueError("the marketing view has no status filter")
    chosen = roster.where(roster_filter(**filters) & is_complete())
    keys = roster_order(sort, direction)
    ordered = chosen.orderBy(*(keys[1:] if sort == "outreach_status" else keys))
    return marketing_projection(page_of(ordered, limit, offset))


def status_counts(roster: DataFrame, state: str | None = None) -> DataFrame:
    return (
        roster.where(roster_filter(state=state))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def coverage(roster: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, rows seen outside, rows hidden, and what the hidden ones lack."""
    return roster.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_complete()).alias("visible"),
        F.count_if(~is_complete()).alias("hidden"),
        F.count_if(best_email().isNull()).alias("missing_email"),
        F.count_if(best_phone().isNull()).alias("missing_phone"),
    )
