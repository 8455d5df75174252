"""Build the seed list of a state and stream."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.operators import channels
from rosterlake.operators.ranges import rank_rows
from rosterlake.sources.seeds import read_seeds, write_seeds


@dataclass
class SeedInputs:
    """Input tables of the seed channels; a missing one switches its channel off.

    results: state, stream, query_no, rank, url. tables: url, payload.
    pages: url, html. districts: state, district. places: see ``maps_seeds``.
    """

    results: DataFrame
    districts: DataFrame
    tables: DataFrame | None = None
    pages: DataFrame | None = None
    places: DataFrame | None = None


def channel_seeds(inputs: SeedInputs) -> DataFrame:
    """Seeds of all channels, unmerged, for every state and stream in the inputs."""
    found = []
    if inputs.places is not None:
        found.append(channels.maps_seeds(inputs.places))
    if inputs.tables is not None:
        chosen = channels.listing_pages(inputs.results, "directory")
        found.append(channels.directory_seeds(chosen, inputs.tables))
    if inputs.pages is not None:
        chosen = channels.listing_pages(inputs.results, "aggregator")
        found.append(channels.aggregator_seeds(chosen, inputs.pages, inputs.districts))
    if not found:
        raise ValueError("no seed channel has an input")
    return channels.union_channels(*found)


def merged_seeds(seeds: DataFrame) -> DataFrame:
    """Merged seeds numbered within their state and stream by first appearance."""
    merged = channels.merge_channels(seeds)
    flat = merged.select(
        *schema.SEED_COLUMNS, "name_key", "district_key",
        F.col("ord.channel_no").alias("o1"), F.col("ord.pos").alias("o2"),
    )
    return rank_rows(flat, "pos", ("o1", "o2", "name_key", "district_key"), channels.RUN).drop("o1", "o2")


def build_seed_list(
    spark: SparkSession, state: str, stream: str, inputs: SeedInputs, cache_path: str, *,
    force_refresh: bool = False, ttl_days: int = vocab.SEED_TTL_DAYS, now: datetime | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(seeds, yield report): the cached list while fresh, else a new one.

    The report is None where the cache was used.
    """
    if not force_refresh:
        cached = read_seeds(spark, cache_path, state, stream, ttl_days=ttl_days, now=now)
        if cached is not None:
            return cached, None
    here = (F.col("state") == state) & (F.col("stream") == stream)
    seeds = channel_seeds(SeedInputs(
        inputs.results.where(here), inputs.districts, inputs.tables, inputs.pages,
        None if inputs.places is None else inputs.places.where(here),
    ))
    merged = merged_seeds(seeds)
    write_seeds(merged, cache_path, now)
    written = read_seeds(spark, cache_path, state, stream, ttl_days=ttl_days, now=now)
    fresh = merged.select(*schema.SEED_COLUMNS, "pos") if written is None else written
    return fresh, channels.channel_yield(seeds, merged)
