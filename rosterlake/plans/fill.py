"""Fill missing contacts of stored organisations from their known sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlake import schema, vocab
from rosterlake.functions.emails import email_domain, emails_in_text
from rosterlake.functions.html import page_text
from rosterlake.functions.payloads import payload_emails, payload_phones
from rosterlake.functions.phones import phones_in_text
from rosterlake.functions.score import owns_page
from rosterlake.functions.text import present
from rosterlake.functions.urls import domain_of, trim_slash
from rosterlake.operators.crawl import guessed_urls
from rosterlake.operators.roster import is_complete
from rosterlake.session import cut_lineage
from rosterlake.sources.store import RosterStore


def incomplete_orgs(roster: DataFrame, *, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with a website that lack an address or a number, in name order."""
    rows = roster.where(present(F.col("website")) & ~is_complete())
    if state:
        rows = rows.where(F.col("state") == state)
    return rows if limit is None else rows.orderBy("college_name", *schema.KEY).limit(limit)


def page_bodies(pages: DataFrame) -> DataFrame:
    """url_key, text, payload and ``mark``, which names one of the copies of a page."""
    blank = F.lit(None).cast("string")
    markdown = F.col("markdown") if "markdown" in pages.columns else blank
    payload = F.col("payload") if "payload" in pages.columns else blank
    text = page_text(markdown, F.col("html"))
    bodies = pages.select(trim_slash(F.col("url")).alias("url_key"), text.alias("text"), payload.alias("payload"))
    return bodies.where(present(F.col("text"))).withColumn("mark", F.xxhash64("text", "payload"))


def candidate_pages(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """The candidate URLs of each site that exist: site, pos, url_key, mark and the contacts found there.

    Contacts are taken where a page is scanned, so what moves are addresses and numbers.
    Spark's runtime filter keeps pages that no target asks for from being searched.
    """
    urls = guessed_urls(_sites(targets).select("site").distinct(), vocab.FILL_PATHS)
    wanted = urls.select("site", "pos", trim_slash(F.col("url")).alias("url_key"))
    text, payload = F.col("text"), F.col("payload")
    finds = page_bodies(pages).select(
        "url_key", "mark",
        F.array_distinct(F.concat(payload_emails(payload), emails_in_text(text))).alias("emails"),
        F.array_distinct(F.concat(payload_phones(payload), phones_in_text(text))).alias("phones"),
    )
    read = (
        finds.join(wanted.select("url_key").distinct(), "url_key", "left_semi")
        .groupBy("url_key").agg(F.max(F.struct("mark", "emails", "phones")).alias("f")).select("url_key", "f.*")
    )
    return wanted.join(read, "url_key")


def _sites(targets: DataFrame) -> DataFrame:
    return targets.withColumn("site", F.trim("website")).select(*schema.KEY, "college_name", "site")


def owned_sites(targets: DataFrame, found: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether the first existing page of each target's site names the target.

    Only the texts of first pages meet targets; other texts stay at their scan.
    """
    first = found.groupBy("site").agg(F.min_by(F.struct("url_key", "mark"), "pos").alias("p")).select("site", "p.*")
    texts = page_bodies(pages).select("url_key", "mark", "text").join(first.select("url_key", "mark").distinct(), ["url_key", "mark"], "left_semi")
    one = texts.dropDuplicates(["url_key", "mark"])
    asked = _sites(targets).join(first, "site").join(one, ["url_key", "mark"])
    return asked.select(*schema.KEY, owns_page(F.col("text"), F.col("college_name"), F.col("site")).alias("owned"))


def fill_contacts(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """What each target's own pages offer.

    Pages are read in candidate order. The first page decides whether the site
    is the organisation's own; reading stops after the page with which both an
    address and a number are known. Addresses on the site's own domain come
    first, then placement addresses, then first seen. At most five pages per
    site take part, so the per-site lists stay small; organisations that share a
    site share its list.
    """
    found = cut_lineage(candidate_pages(targets, pages))
    per_site = found.groupBy("site").agg(
        # First page with an address, first page with a number: reading goes on
        # until the later of the two.
        F.min(F.when(F.size("emails") > 0, F.col("pos"))).alias("email_from"),
        F.min(F.when(F.size("phones") > 0, F.col("pos"))).alias("phone_from"),
        F.array_sort(F.collect_list(F.struct("pos", "emails", "phones"))).alias("read"),
    )
    by_pos = _sites(targets).join(per_site, "site").join(owned_sites(targets, found, pages), list(schema.KEY))
    stop = F.when(
        F.col("email_from").isNotNull() & F.col("phone_from").isNotNull(),
        F.greatest("email_from", "phone_from"),
    ).otherwise(F.lit(len(vocab.FILL_PATHS)))
    used = by_pos.withColumn("read", F.filter("read", lambda p: p["pos"] <= stop))
    own = used.select(
        *schema.KEY, "owned",
        F.when(F.col("owned"), F.size("read")).otherwise(F.lit(1)).alias("pages_tried"),
        domain_of(F.col("site")).alias("host"),
        *[
            F.when(
                F.col("owned"),
                F.array_distinct(F.flatten(F.col(f"read.{k}"))),
            ).otherwise(F.array().cast("array<string>")).alias(k)
            for k in ("emails", "phones")
        ],
    )
    host, stem = F.col("host"), F.substring_index("host", ".", 1)

    def preference(address, place):
        domain = email_domain(address)
        on_domain = (host != "") & (
            (domain == host)
            | domain.endswith(F.concat(F.lit("."), host))
            | ((F.length(stem) > 3) & F.contains(domain, stem))
        )
        placement = address.rlike("^(?:" + "|".join(vocab.FILL_PLACEMENT_PREFIXES) + ")")
        return F.struct(
            (~on_domain).alias("a"), (~placement).alias("b"), place.alias("c"), address.alias("address")
        )

    ranked = F.transform(F.array_sort(F.transform("emails", preference)), lambda r: r["address"])
    return own.withColumn("emails", ranked).select(
        *schema.KEY,
        F.col("owned").alias("site_verified"),
        "pages_tried",
        F.get("emails", F.lit(0)).alias("email"),
        F.slice("emails", 2, F.size("emails")).alias("extra_emails"),
        F.get("phones", F.lit(0)).alias("phone"),
        F.slice("phones", 2, F.size("phones")).alias("extra_phones"),
    )


def fill_report(targets: DataFrame, fills: DataFrame, *, written: bool = False) -> DataFrame:
    """Targets, targets with a find, targets whose site was not confirmed, and finds that went into the store."""
    joined = targets.select(*schema.KEY).join(fills, list(schema.KEY), "left")
    found = F.count_if(F.col("email").isNotNull() | F.col("phone").isNotNull())
    return joined.agg(
        F.count(F.lit(1)).alias("targets"),
        found.alias("found"),
        F.count_if(~F.coalesce("site_verified", F.lit(False))).alias("unverified"),
        (found if written else F.lit(0).cast("bigint")).alias("written"),
    )


def as_corrections(fills: DataFrame) -> DataFrame:
    """Finds as corrections of the fallback fields; what was not found stays."""
    pairs = F.array(
        F.struct(F.lit("fallback_contact_phone").alias("column"), F.col("phone").alias("value")),
        F.struct(F.lit("fallback_contact_email").alias("column"), F.col("email").alias("value")),
    )
    return (
        fills.select(*schema.KEY, F.explode(pairs).alias("edit"), F.lit(0).alias("seq"))
        .select(*schema.KEY, "edit.*", "seq")
        .where(F.col("value").isNotNull())
    )


def fill_store(store: RosterStore, pages: DataFrame, *, state: str | None = None,
               limit: int | None = None, dry_run: bool = False) -> DataFrame:
    """Fill the store from fetched pages; returns the fills."""
    targets = cut_lineage(incomplete_orgs(store.read(), state=state, limit=limit))
    fills = cut_lineage(fill_contacts(targets, pages))  # the store's files are replaced below
    if not dry_run:
        store.correct(as_corrections(fills))
    return fills
