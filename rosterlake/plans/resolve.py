"""Resolve the contacts of organisations from search results and fetched pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import schema
from rosterlake.functions.text import blank_to_null, normalize_district, normalize_name, present
from rosterlake.functions.urls import domain_of, trim_slash
from rosterlake.operators import contacts as C
from rosterlake.operators.crawl import choose_pages
from rosterlake.operators.sites import (
    best_sites, page_facts, page_index, pages_of_sites, score_candidates, site_table,
)
from rosterlake.session import cut_lineage


@dataclass
class ResolveInputs:
    """results: org_id, rank, url, title. pages: url, html[, markdown, payload].
    site_urls: site, url, pos. verification and places as in ``operators.contacts``."""

    results: DataFrame
    pages: DataFrame
    site_urls: DataFrame | None = None
    verification: DataFrame | None = None
    places: DataFrame | None = None


#: Columns of a result that a row of organisations may bring too: the found ones count.
_FOUND = (
    "website", "site", "site_score", "placement_officer_name", "placement_email", "placement_phone", "backup_emails_found",
    "backup_phones_found", "fallback_contact_email", "fallback_contact_phone", "confidence_score", "source_urls",
    "email_verified", "last_scraped", "status", "notes",
)


def with_org_id(orgs: DataFrame) -> DataFrame:
    """Rows with an ``org_id``: their own, else one made of the store key, so seeds and stored rows agree."""
    if "org_id" in orgs.columns:
        return orgs
    key = (normalize_name(F.col("college_name")), normalize_district(F.col("district")), F.coalesce("stream", F.lit("")))
    return orgs.withColumn("org_id", F.concat_ws("|", *key))


def choose_sites(orgs: DataFrame, results: DataFrame) -> DataFrame:
    """Add ``site`` and ``site_score``; a stored website needs no choice."""
    known = present(F.col("website"))
    picked = best_sites(score_candidates(orgs.where(~known), results)).select(
        "org_id", F.col("url").alias("_site"), F.col("score").alias("site_score")
    )
    return orgs.join(picked, "org_id", "left").withColumn(
        "site", F.coalesce(blank_to_null(F.col("website")), F.col("_site"))
    ).drop("_site")


def facts_of_sites(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Page facts on hosts of the sites, one row per URL, written once and read often."""
    facts = page_facts(pages)
    hosts = pages.select(
        trim_slash(F.col("url")).alias("url_key"), domain_of(F.col("url")).alias("host")
    )
    wanted = pages_of_sites(hosts, sites).select("url_key").distinct()
    columns = [c for c in facts.columns if c != "url_key"]
    return cut_lineage(
        facts.join(wanted, "url_key", "left_semi")
        .groupBy("url_key").agg(F.max(F.struct(*columns)).alias("f"))
        .select("url_key", "f.*")
    )


def site_contacts(sites: DataFrame, facts: DataFrame, site_urls: DataFrame | None) -> DataFrame:
    """Contacts and source pages per site; a site without any page is absent.

    Sites are resolved once, however many organisations share one.
    """
    chosen = cut_lineage(choose_pages(sites, page_index(facts), site_urls))
    sources = chosen.groupBy("site").agg(
        # All pages of one site: its row lists them.
        F.transform(F.array_sort(F.collect_list(F.struct("page_no", "url"))), lambda p: p["url"])
        .alias("source_urls")
    )
    ranked = C.best_sightings(C.page_sightings(chosen, facts))
    return sources.join(C.split_contacts(ranked), "site", "left")


def resolve(orgs: DataFrame, inputs: ResolveInputs, now: Column | None = None) -> DataFrame:
    """One result per organisation.

    ``orgs`` has org_id, college_name, state, stream, district, website and
    affiliation; without org_id it is made of the key, and other columns are carried
    along unless the result has one of that name. Without an acceptable site, or without a page of it, the result
    is Failed and says why.
    """
    orgs = with_org_id(orgs)
    carried = [c for c in orgs.columns if c not in _FOUND]
    placed = cut_lineage(choose_sites(orgs.select(*carried, "website"), inputs.results))
    sites = cut_lineage(site_table(placed))
    facts = facts_of_sites(inputs.pages, sites)
    found = site_contacts(sites, facts, inputs.site_urls)
    joined = placed.join(found, "site", "left")
    none = F.array().cast("array<string>")
    record = joined.select(
        *carried,
        F.col("site").alias("website"),
        F.lit(None).cast("string").alias("placement_officer_name"),
        "placement_email", "placement_phone",
        F.coalesce("backup_emails_found", none).alias("backup_emails_found"),
        F.coalesce("backup_phones_found", none).alias("backup_phones_found"),
        "fallback_contact_email", "fallback_contact_phone",
        C.confidence().alias("confidence_score"),
        F.coalesce("source_urls", none).alias("source_urls"),
        F.lit(False).alias("email_verified"),
        (F.current_timestamp() if now is None else now).alias("last_scraped"),
        F.when(F.col("site").isNull(), F.lit("no confident official website found"))
        .when(F.col("source_urls").isNull(), F.lit("site discovered but no page could be fetched"))
        .alias("notes"),
    )
    if inputs.places is not None:
        reached = record.where(F.col("notes").isNull())
        record = C.fill_from_places(reached, inputs.places).unionByName(
            record.where(F.col("notes").isNotNull())
        )
    if inputs.verification is not None:
        record = C.verify_emails(record, inputs.verification)
    return record.withColumn("status", C.run_status()).withColumn(
        "notes",
        F.when(F.col("notes").isNotNull(), F.col("notes")).otherwise(F.concat(
            F.format_string("crawled %d pages", F.size("source_urls")),
            F.when(F.col("status") == "Failed", F.lit("; no contact details found anywhere"))
            .otherwise(F.lit("")),
        )),
    )


def as_records(results: DataFrame) -> DataFrame:
    """Results in the shape the store takes."""
    extra = ["pos"] if "pos" in results.columns else []
    return results.select(*schema.RECORD_COLUMNS, *extra)
