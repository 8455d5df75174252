"""Seed channels: from search results and listing pages to one seed list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.html import candidate_names
from rosterlake.functions.payloads import table_rows
from rosterlake.functions.text import (
    blank_to_null, clean_listing_name, normalize_district, normalize_name, present,
)
from rosterlake.functions.urls import is_aggregator, is_authoritative
from rosterlake.operators.places import plausibly_in_state
from rosterlake.operators.ranges import first_rows, rank_rows

#: Trust order of the channels.
CHANNELS = ("maps", "directory", "aggregator")
RUN = ("state", "stream")


def listing_pages(results: DataFrame, channel: str, limit: int | None = None) -> DataFrame:
    """The first distinct usable URLs of a channel's searches, per state and stream.

    ``results`` has state, stream, query_no, rank and url. All pages are read
    unless a ``limit`` is given.
    """
    usable = {"directory": is_authoritative, "aggregator": is_aggregator}[channel]
    urls = (
        results.withColumn("url", F.trim("url"))
        .where(present(F.col("url")) & usable(F.col("url")))
        .groupBy(*RUN, "url")
        .agg(F.min(F.struct("query_no", "rank")).alias("first"))
    )
    if limit is not None:
        return first_rows(urls, RUN, [F.col("first"), F.col("url")], limit, "page_no").drop("first")
    return rank_rows(urls.select(*RUN, "url", "first.*"), "page_no", ["query_no", "rank", "url"], RUN).drop("query_no", "rank")


def _seed(df: DataFrame, channel: str, pos) -> DataFrame:
    """Names-and-district seeds of a page channel; contact fields stay empty."""
    return df.select(
        F.lit(channel).alias("channel"),
        pos.alias("pos"),
        "college_name", "state", "stream",
        F.col("district"),
        *[F.lit("").alias(c) for c in ("address", "phone", "website", "affiliation")],
        F.lit(channel).alias("source"),
        F.array("url").alias("source_urls"),
    )


def directory_seeds(chosen: DataFrame, tables: DataFrame) -> DataFrame:
    """Seeds in the tables of the chosen directory pages.

    ``tables`` has url and payload (the table extraction of that page as JSON).
    """
    rows = chosen.join(tables.where(present(F.col("payload"))), "url").select(
        *RUN, "url", "page_no", F.posexplode(table_rows(F.col("payload"))).alias("i", "row")
    )
    named = rows.select(
        *RUN, "url", "page_no", "i",
        F.col("row.name").alias("college_name"), F.col("row.district").alias("district"),
    )
    return _seed(named, "directory", F.struct(F.col("page_no").cast("bigint").alias("a"),
                                              F.col("i").cast("bigint").alias("b")))


def aggregator_seeds(chosen: DataFrame, pages: DataFrame, reference: DataFrame) -> DataFrame:
    """Names on the chosen listing pages, cleaned, placed and distinct.

    Names are taken from the markup first, so page text never reaches a shuffle.
    """
    spotted = pages.where(present(F.col("html"))).select(
        "url", F.posexplode(candidate_names(F.col("html"))).alias("i", "raw")
    )
    cleaned = (
        spotted.withColumn("college_name", clean_listing_name(F.col("raw")))
        .where(F.col("college_name").isNotNull())
        .join(chosen, "url")
    )
    local = plausibly_in_state(cleaned, reference).where("in_state")
    first = (
        local.withColumn("k", normalize_name(F.col("college_name")))
        .groupBy(*RUN, "k")
        .agg(F.min(F.struct(
            F.col("page_no").cast("bigint").alias("a"), F.col("i").cast("bigint").alias("b"),
            "college_name", "url",
        )).alias("f"))
        .select(*RUN, "f.*", F.lit("").alias("district"))
    )
    return _seed(first, "aggregator", F.struct("a", "b"))


def maps_seeds(places: DataFrame) -> DataFrame:
    """Seeds from a places table: state, stream, district, pos, name, address, phone, website."""
    named = places.where(present(F.trim("name")))
    return named.select(
        F.lit("maps").alias("channel"),
        F.struct(F.col("pos").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("pos"),
        F.trim("name").alias("college_name"), "state", "stream", "district",
        *[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("address", "phone", "website")],
        F.lit("").alias("affiliation"),
        F.lit("maps").alias("source"),
        F.array().cast("array<string>").alias("source_urls"),
    )


def union_channels(*channels: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)


def merge_channels(seeds: DataFrame) -> DataFrame:
    """One row per organisation from all channels.

    ``seeds`` has channel, pos (order within the channel) and the seed columns.
    Rows of one name form one organisation per district; rows without a district
    join the district of the name's first row, and if that one has none the
    whole name is one organisation. The first row is the base. Further map rows
    fill phone, address and website, further directory rows fill affiliation and
    district, directory and aggregator rows add their page URLs and their mark;
    aggregator rows give no contact field.

    Two aggregations: first by (name, district), which folds all copies before
    anything is compared per name, then by organisation.
    """
    rank = F.coalesce(*[F.when(F.col("channel") == c, F.lit(i)) for i, c in enumerate(CHANNELS)])
    keyed = seeds.withColumns({
        "name_key": normalize_name(F.col("college_name")),
        "district_key": normalize_district(F.col("district")),
        "ord": F.struct(rank.alias("channel_no"), F.col("pos").alias("pos")),
    })

    def first_from(channel: str, column: str):
        wanted = (F.col("channel") == channel) & present(F.col(column))
        return F.min(F.when(wanted, F.struct("ord", F.col(column).alias("v")))).alias(f"f_{column}")

    fills = {"maps": ("phone", "address", "website"), "directory": ("affiliation", "district")}
    parts = keyed.withColumn("one_url", F.explode_outer("source_urls")).groupBy(
        *RUN, "name_key", "district_key"
    ).agg(
        F.min_by(
            F.struct("ord", "college_name", "district", "address", "phone", "website",
                     "affiliation", "source", "source_urls"),
            F.col("ord"),
        ).alias("base"),
        *[first_from(channel, c) for channel, cs in fills.items() for c in cs],
        F.bool_or(F.col("channel") == "directory").alias("in_directory"),
        F.bool_or(F.col("channel") == "aggregator").alias("in_aggregator"),
        # Distinct listing pages only: a handful per state and stream.
        F.collect_set(F.when(F.col("channel") != "maps", F.col("one_url"))).alias("urls"),
    )
    # Per name there is now one row per district.
    anchor = parts.groupBy(*RUN, "name_key").agg(
        F.min_by("district_key", "base.ord").alias("anchor")
    )
    placed = parts.join(anchor, [*RUN, "name_key"]).withColumn(
        "org",
        F.when((F.col("anchor") == "") | (F.col("district_key") == ""), F.col("anchor")).otherwise(
            F.col("district_key")
        ),
    )
    merged = placed.groupBy(*RUN, "name_key", "org").agg(
        F.min_by("base", "base.ord").alias("base"),
        *[F.min(f"f_{c}").alias(f"f_{c}") for cs in fills.values() for c in cs],
        F.bool_or("in_directory").alias("in_directory"),
        F.bool_or("in_aggregator").alias("in_aggregator"),
        F.array_distinct(F.flatten(F.collect_list("urls"))).alias("urls"),
    )

    def filled(column: str):
        own = blank_to_null(F.col(f"base.{column}"))
        return F.coalesce(own, F.col(f"f_{column}.v"), F.lit("")).alias(column)

    def mark(flag: str, channel: str):
        missing = F.col(flag) & ~F.contains(F.col("base.source"), F.lit(channel))
        return F.when(missing, F.lit("+" + channel)).otherwise(F.lit(""))

    return merged.select(
        "state", "stream", "name_key",
        F.col("org").alias("district_key"),
        F.col("base.ord").alias("ord"),
        F.col("base.college_name").alias("college_name"),
        filled("district"), filled("address"), filled("phone"), filled("website"),
        filled("affiliation"),
        F.concat(
            F.col("base.source"), mark("in_directory", "directory"), mark("in_aggregator", "aggregator")
        ).alias("source"),
        F.array_sort(F.array_union(
            F.coalesce("base.source_urls", F.array().cast("array<string>")), F.col("urls")
        )).alias("source_urls"),
    )


def channel_yield(seeds: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows found per channel and rows after the merge, per state and stream."""
    found = seeds.groupBy(*RUN, "channel").agg(F.count(F.lit(1)).alias("found"))
    total = merged.groupBy(*RUN).agg(F.count(F.lit(1)).alias("found")).select(
        *RUN, F.lit("merged").alias("channel"), "found"
    )
    return found.unionByName(total)


def corroboration(merged: DataFrame) -> DataFrame:
    """Organisations by the channels that named them."""
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
