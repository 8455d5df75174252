"""From contact sightings on pages to the contacts of an organisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.score import email_reasons, email_score, phone_reasons, phone_score
from rosterlake.functions.text import normalize_name, present
from rosterlake.functions.urls import domain_of


def page_sightings(chosen: DataFrame, facts: DataFrame) -> DataFrame:
    """Scored contacts on the chosen pages.

    Columns: site, page_no, source_url, kind, value, i (place on the page before
    scoring), score, reasons.
    """
    pages = chosen.join(
        facts.select("url_key", "wording", "emails", "phones"), "url_key"
    )

    def of(kind: str) -> DataFrame:
        return pages.select(
            "site", "page_no", F.col("url").alias("source_url"), "wording",
            F.lit(kind).alias("kind"),
            F.posexplode(kind + "s").alias("i", "value"),
        )

    return score_sightings(
        of("email").unionByName(of("phone")).withColumn("site_domain", domain_of(F.col("site")))
    ).drop("wording", "site_domain")


def score_sightings(sightings: DataFrame) -> DataFrame:
    """Add score and reasons to (kind, value, source_url, wording, site_domain) rows."""
    args = F.col("value"), F.col("source_url"), F.col("wording"), F.col("site_domain")
    is_email = F.col("kind") == "email"
    return sightings.withColumns({
        "score": F.when(is_email, email_score(*args)).otherwise(phone_score(args[1], args[2])),
        "reasons": F.when(is_email, email_reasons(*args)).otherwise(phone_reasons(args[1], args[2])),
    })


def best_sightings(sightings: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Each contact once per group with its best score.

    Ties keep the first sighting. ``seen`` is the place of the first sighting:
    page, then rank on that page. One aggregation, folded before the exchange.
    """
    seen = F.struct("page_no", (-F.col("score")).alias("down"), "i")
    best = F.struct("score", (-F.col("page_no")).alias("a"), (-F.col("i")).alias("b"))
    return (
        sightings.groupBy(*keys, "kind", "value")
        .agg(
            F.max_by(F.struct("score", "reasons", "source_url"), best).alias("best"),
            F.min(seen).alias("seen"),
        )
        .select(*keys, "kind", "value", "best.score", "best.reasons", "best.source_url", "seen")
    )


def leading_contacts(contacts: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Best contact per group and kind: highest score, then first seen."""
    first = F.struct((-F.col("score")).alias("down"), F.col("seen"))
    return (
        contacts.groupBy(*keys, "kind")
        .agg(
            F.min_by(F.struct("value", "score"), first).alias("lead"),
            F.count(F.lit(1)).alias("n_contacts"),
        )
        .select(*keys, "kind", "lead.value", "lead.score", "n_contacts")
    )


def split_contacts(contacts: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Placement, fallback and backup contacts per group.

    The best address in the placement band is the placement contact and all
    others are backups; without one, the top of the list is the fallback contact
    and stays among the backups. The list of a group holds the distinct contacts
    of the pages that were chosen for it.
    """
    by_kind = {
        kind: F.transform(
            F.array_sort(F.collect_list(F.when(
                F.col("kind") == kind,
                F.struct((-F.col("score")).alias("down"), F.col("seen"), F.col("value")),
            ))),
            lambda c: F.struct((-c["down"]).alias("score"), c["value"].alias("value")),
        ).alias(kind)
        for kind in ("email", "phone")
    }
    lists = contacts.groupBy(*keys).agg(*by_kind.values())
    values = {}
    for kind in ("email", "phone"):
        top = F.get(F.col(kind), F.lit(0))
        placed = F.coalesce(top["score"] >= vocab.PLACEMENT_SCORE, F.lit(False))
        everyone = F.transform(F.col(kind), lambda c: c["value"])
        values[f"placement_{kind}"] = F.when(placed, top["value"])
        values[f"fallback_contact_{kind}"] = F.when(~placed, top["value"])
        values[f"backup_{kind}s_found"] = F.when(
            placed, F.slice(everyone, 2, F.greatest(F.size(everyone), F.lit(1)))
        ).otherwise(everyone)
        if kind == "email":
            values["placement_score"] = F.when(placed, top["score"])
    return lists.select(*keys, *[c.alias(name) for name, c in values.items()])


def _spread_null(c: Column, by: Column) -> Column:
    """A join key whose missing values do not all meet in one partition."""
    return F.coalesce(c, F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string")))


def verify_emails(results: DataFrame, verification: DataFrame) -> DataFrame:
    """Set ``email_verified`` from a table of checks (email, deliverable, valid, status)."""
    good = (
        F.coalesce(F.col("deliverable"), F.lit(False))
        | F.coalesce(F.col("valid"), F.lit(False))
        | F.coalesce(F.col("status").isin("valid", "deliverable"), F.lit(False))
    )
    checks = verification.where(F.col("email").isNotNull()).groupBy(
        F.col("email").alias("_email")
    ).agg(F.bool_or(good).alias("_good"))
    chosen = F.coalesce("placement_email", "fallback_contact_email")
    keyed = results.withColumn("_email", _spread_null(chosen, F.col("college_name")))
    return keyed.join(checks, "_email", "left").select(
        *[c for c in results.columns if c != "email_verified"],
        F.coalesce("_good", F.lit(False)).alias("email_verified"),
    )


def fill_from_places(results: DataFrame, places: DataFrame) -> DataFrame:
    """Fill an empty fallback phone from a places table (name, place, pos, phone).

    Only where the site gave no phone at all. The place is the district, or the
    state of an organisation without one.
    """
    best = (
        places.where(present(F.trim("phone")))
        .groupBy(normalize_name(F.col("name")).alias("_name"), F.lower(F.trim("place")).alias("_place"))
        .agg(F.min_by(F.trim("phone"), "pos").alias("_phone"))
    )
    place = F.when(present(F.col("district")), F.col("district")).otherwise(F.col("state"))
    keyed = results.withColumns({
        "_name": normalize_name(F.col("college_name")), "_place": F.lower(F.trim(place)),
    })
    lacking = ~present(F.col("placement_phone")) & ~present(F.col("fallback_contact_phone"))
    joined = keyed.join(best, ["_name", "_place"], "left")
    filled = F.when(lacking & F.col("_phone").isNotNull(), F.col("_phone")).otherwise(
        F.col("fallback_contact_phone")
    )
    return joined.withColumn("fallback_contact_phone", filled).select(*results.columns)


def run_status() -> Column:
    """Verified with both placement contacts, Needs Follow-up with any, else Failed."""
    names = ("placement_email", "placement_phone", "fallback_contact_email", "fallback_contact_phone")
    has = {n: present(F.col(n)) for n in names}
    return (
        F.when(has[names[0]] & has[names[1]], F.lit("Verified"))
        .when(has[names[0]] | has[names[1]] | has[names[2]] | has[names[3]], F.lit("Needs Follow-up"))
        .otherwise(F.lit("Failed"))
    )


def confidence() -> Column:
    """The better of the site score and the placement address score."""
    return F.greatest(F.coalesce("site_score", F.lit(0)), F.coalesce("placement_score", F.lit(0)))
