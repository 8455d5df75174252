"""Confidence scores for contacts and site candidates."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.emails import email_domain, local_part
from rosterlake.functions.text import acronym, any_of, bind, normalize_name, present
from rosterlake.functions.urls import domain_of, is_blocked_domain, url_path

_WORDING = "(?iU)" + vocab.PLACEMENT_WORDING


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def _sum_of(signals) -> Column:
    """Points of all signals that hold, later signals excluding earlier ones."""
    return reduce(add, [F.when(test, F.lit(points)).otherwise(F.lit(0)) for test, points, _ in signals])


def _names_of(signals) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, _, name in signals]))


def has_placement_wording(text: Column) -> Column:
    """Placement wording anywhere in the text; computed once per page."""
    return F.coalesce(text.rlike(_WORDING), F.lit(False))


def on_placement_page(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike("|".join(vocab.PLACEMENT_URL_HINTS))


def _email_signals(email, page_url, wording, site_domain):
    local = F.regexp_replace(local_part(email), r"[._\-]", "")
    placement = local.rlike(any_of(vocab.PLACEMENT_LOCALS))
    generic = ~placement & local.rlike("^(?:" + any_of(vocab.GENERIC_LOCALS) + ")")
    own = present(site_domain) & email_domain(email).endswith(F.lower(site_domain))
    own = F.coalesce(own, F.lit(False))
    junk = local.rlike(any_of(vocab.JUNK_LOCALS))
    return junk, [
        (placement, 60, "placement local-part"),
        (generic, 10, "generic local-part"),
        (~placement & ~generic, 20, "unrecognised local-part"),
        (on_placement_page(page_url), 25, "found on a placement page"),
        (wording, 10, "placement wording nearby"),
        (own, 10, "college domain"),
        (~own & email_domain(email).isin(*vocab.FREE_MAIL_HOSTS), -10, "free mail host"),
    ]


def email_score(email: Column, page_url: Column, wording: Column, site_domain: Column) -> Column:
    """0-100: how likely an address is the placement contact."""
    junk, signals = _email_signals(email, page_url, wording, site_domain)
    return F.when(junk, F.lit(0)).otherwise(_clamp(_sum_of(signals)))


def email_reasons(email: Column, page_url: Column, wording: Column, site_domain: Column) -> Column:
    junk, signals = _email_signals(email, page_url, wording, site_domain)
    return F.when(junk, F.array(F.lit("junk local-part"))).otherwise(_names_of(signals))


def _phone_signals(page_url, wording):
    return [
        (F.lit(True), 15, "phone found"),
        (on_placement_page(page_url), 45, "found on a placement page"),
        (wording, 25, "placement wording nearby"),
    ]


def phone_score(page_url: Column, wording: Column) -> Column:
    return _clamp(_sum_of(_phone_signals(page_url, wording)))


def phone_reasons(page_url: Column, wording: Column) -> Column:
    return _names_of(_phone_signals(page_url, wording))


def band(score: Column) -> Column:
    """Confidence band of a contact score."""
    return (
        F.when(score >= vocab.PLACEMENT_SCORE, F.lit("placement"))
        .when(score >= vocab.PROBABLE_SCORE, F.lit("probable"))
        .otherwise(F.lit("generic"))
    )


def _ends_with_any(c: Column, endings) -> Column:
    return c.rlike("(?:" + any_of(endings) + ")$")


def _shares_long_word(name_key: Column, text: Column) -> Column:
    return F.exists(
        F.split(name_key, " "), lambda w: (F.length(w) > 3) & F.contains(text, w)
    )


def name_facts(name: Column) -> Column:
    """struct(key, initials): what candidates are compared with; costly, so once per organisation."""
    return F.struct(normalize_name(name).alias("key"), acronym(name).alias("initials"))


def site_candidate(url: Column, name: Column, title: Column) -> Column:
    """struct(domain, score, reasons): is this URL the organisation's own site?"""
    return named_site_candidate(url, name_facts(name), title)


def named_site_candidate(url: Column, named: Column, title: Column) -> Column:
    """``site_candidate`` for an organisation whose ``name_facts`` are at hand."""
    # Each step is bound: what it finds is used several times by the next one.
    parts = F.struct(
        domain_of(url).alias("domain"),
        named.alias("of"),
        F.coalesce(title, F.lit("")).alias("title"),
        url_path(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))).alias("path"),
    )

    def tests(p: Column) -> Column:
        domain, title, key = p["domain"], p["title"], p["of"]["key"]
        return F.struct(
            domain.alias("domain"),
            p["path"].alias("path"),
            p["of"]["initials"].alias("initials"),
            F.regexp_replace(F.substring_index(domain, ".", 1), "[^a-z]", "").alias("host"),
            key.alias("key"),
            _ends_with_any(domain, vocab.EDU_TLDS).alias("educational"),
            ((title != "") & _shares_long_word(key, bind(title, normalize_name))).alias("by_title"),
            F.when(domain == "", F.lit("unparseable URL"))
            .when(is_blocked_domain(domain), F.lit("blocked aggregator domain"))
            .alias("unusable"),
        )

    def ties(t: Column) -> Column:
        key, host, initials = t["key"], t["host"], t["initials"]
        comparable = key.rlike("[a-z]") & (host != "")
        return F.struct(
            t.alias("t"),
            (comparable & _shares_long_word(key, host)).alias("by_name"),
            (comparable & (F.length(initials) >= 3) & F.contains(host, initials)).alias("acronym_inside"),
        )

    def judge(f: Column) -> Column:
        t, by_name = f["t"], f["by_name"]
        domain, path, educational, by_title, unusable = t["domain"], t["path"], t["educational"], t["by_title"], t["unusable"]
        acronym_inside = ~by_name & f["acronym_inside"]
        by_acronym = acronym_inside & F.startswith(t["host"], t["initials"])
        signals = [
            (domain.rlike(any_of(vocab.AGGREGATOR_DOMAIN_WORDS)), -15, "aggregator-like domain word"),
            (educational, 40, "educational TLD"),
            (~educational & _ends_with_any(domain, vocab.WEAK_TLDS), 10, "generic TLD"),
            (by_name, 35, "college name in domain"),
            (by_acronym, 30, "acronym in domain"),
            (acronym_inside & ~by_acronym, 5, "weak partial acronym match"),
            (path.rlike("(?i)" + vocab.LISTING_PATH), -20, "listing-style path"),
            (path.isin("", "/"), 10, "root path"),
            (by_title, 15, "college name in page title"),
        ]
        tied = by_name | by_acronym | by_title
        total = _sum_of(signals)
        capped = F.when(tied, total).otherwise(F.least(total, F.lit(vocab.MIN_SITE_SCORE - 1)))
        note = F.when(~tied, F.array(F.lit("no name match — capped below threshold"))).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(
            domain.alias("domain"),
            F.when(unusable.isNotNull(), F.lit(0)).otherwise(_clamp(capped)).alias("score"),
            F.when(unusable.isNotNull(), F.array(unusable))
            .otherwise(F.concat(_names_of(signals), note))
            .alias("reasons"),
        )

    return bind(bind(bind(parts, tests), ties), judge)


def owns_page(text: Column, name: Column, website: Column, head_chars: int | None = None) -> Column:
    """Does a page name its supposed owner?

    The whole text is searched; ``head_chars`` restricts the search to the
    start of the page for callers that want that rule.
    """
    seen = F.coalesce(text, F.lit(""))
    if head_chars is not None:
        seen = F.substring(seen, 1, head_chars)
    haystack = F.lower(F.regexp_replace(seen, r"(?U)[\s\x1c-\x1f]+", " "))
    facts = F.struct(
        haystack.alias("hay"),
        normalize_name(name).alias("key"),
        acronym(name).alias("long"),
        acronym(name, vocab.ACRONYM_SKIP + vocab.INSTITUTION_ACRONYM_SKIP).alias("short"),
        domain_of(website).alias("host"),
    )

    def judge(f: Column) -> Column:
        hay = f["hay"]
        named = F.exists(F.split(f["key"], " "), lambda w: (F.length(w) > 4) & F.contains(hay, w))
        initials = reduce(
            or_, [(F.length(f[k]) >= 3) & F.contains(hay, f[k]) for k in ("long", "short")]
        )
        stem = F.substring_index(f["host"], ".", 1)
        by_host = (
            _ends_with_any(f["host"], vocab.OWNERSHIP_TLDS)
            & (F.length(stem) >= 5)
            & F.contains(hay, stem)
        )
        return (seen != "") & (named | initials | by_host)

    return F.coalesce(bind(facts, judge), F.lit(False))
