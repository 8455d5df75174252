"""Official sites: choosing one per organisation, and pages that belong to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.emails import emails_in_text, emails_obfuscated
from rosterlake.functions.html import page_text
from rosterlake.functions.payloads import payload_emails, payload_phones
from rosterlake.functions.phones import phones_in_text
from rosterlake.functions.score import has_placement_wording, name_facts, named_site_candidate
from rosterlake.functions.text import any_of, present
from rosterlake.functions.urls import domain_of, host_suffixes, page_hrefs, trim_slash


def score_candidates(orgs: DataFrame, results: DataFrame) -> DataFrame:
    """Search results scored as own sites.

    ``orgs`` has org_id and college_name; ``results`` has org_id, rank, url, title.
    """
    hits = results.withColumn("url", F.trim("url")).where(present(F.col("url")))
    # A name is normalised once, not once per result, and by as many tasks as there are rows for.
    named = orgs.select("org_id", "college_name").repartition("org_id").select("org_id", name_facts(F.col("college_name")).alias("of"))
    scored = hits.join(named, "org_id").withColumn("c", named_site_candidate(F.col("url"), F.col("of"), F.col("title")))
    return scored.select("org_id", "rank", "url", "c.domain", "c.score", "c.reasons")


def best_sites(candidates: DataFrame, threshold: int = vocab.MIN_SITE_SCORE) -> DataFrame:
    """Best candidate per organisation: highest score, then search rank.

    Below the threshold there is none. One aggregation, no per-group sort.
    """
    best = candidates.groupBy("org_id").agg(
        F.max_by(F.struct("url", "domain", "score", "reasons"),
                 F.struct(F.col("score"), (-F.col("rank")).alias("r"))).alias("b")
    )
    return best.select("org_id", "b.*").where(F.col("score") >= threshold)


def page_facts(pages: DataFrame) -> DataFrame:
    """Everything later steps need from a page, taken in one pass over its text.

    ``pages`` has url, html and optionally markdown and payload (a contact
    extraction as JSON). The text itself goes no further than this scan: links,
    addresses, numbers and flags are what gets shuffled. Pages without any body
    are left out.
    """
    blank = F.lit(None).cast("string")
    markdown = F.col("markdown") if "markdown" in pages.columns else blank
    payload = F.col("payload") if "payload" in pages.columns else blank
    html = F.col("html")
    text = page_text(markdown, html)
    bodies = pages.where(present(html) | present(markdown))
    return bodies.select(
        trim_slash(F.col("url")).alias("url_key"),
        "url",
        domain_of(F.col("url")).alias("host"),
        page_hrefs(html).alias("hrefs"),
        has_placement_wording(text).alias("wording"),
        F.array_distinct(F.concat(
            payload_emails(payload),
            emails_in_text(F.coalesce(text, F.lit(""))),
            F.transform(emails_obfuscated(html), lambda a: F.lower(F.trim(a))),
        )).alias("emails"),
        F.array_distinct(F.concat(payload_phones(payload), phones_in_text(text))).alias("phones"),
    )


def page_index(facts: DataFrame) -> DataFrame:
    """One narrow row per page URL: the links worth following.

    A link that does not depend on the folder of the site (absolute or from the
    root) and names no hinted path can never be followed and is left out. Copies
    of a page fold into one row before the exchange.
    """
    fixed = r"(?i)^(?:/|[a-z][a-z0-9+.\-]*:)"
    hinted = "(?i)" + any_of(vocab.LINK_HINTS)
    useful = F.filter("hrefs", lambda h: ~h.rlike(fixed) | h.rlike(hinted))
    return facts.groupBy("url_key").agg(F.max(useful).alias("hrefs"))


def site_table(websites: DataFrame) -> DataFrame:
    """Distinct sites with their host."""
    return (
        websites.select("site")
        .where(present(F.col("site")))
        .distinct()
        .withColumn("site_host", domain_of(F.col("site")))
    )


def pages_of_sites(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_host, page) pairs: the page host equals a site host or lies below it.

    Distinct page hosts are matched to sites by their parents; pages then meet
    their sites by whole host, so no page is sent under its top-level domain. A
    page pairs at most once per label of its own host.
    """
    hosts = sites.select("site_host").where(F.col("site_host") != "").distinct()
    seen = facts.select("host").distinct()
    matched = seen.withColumn("site_host", F.explode(host_suffixes(F.col("host")))).join(hosts, "site_host")
    return facts.join(matched, "host")


