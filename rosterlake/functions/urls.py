"""URL parts, link resolution, link and site predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.text import any_of, bind

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\x00-\x20]+|[\t\r\n]", "")


def _assume_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def authority(url: Column) -> Column:
    """Lowered network location, '' where there is none."""
    found = F.lower(F.regexp_extract(_tidy(url), _AUTHORITY, 1))
    return bind(found, lambda host: F.when(host.contains("[") != host.contains("]"), F.lit("")).otherwise(host))


def drop_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def domain_of(url: Column) -> Column:
    """Host of a URL, scheme optional, without ``www.``; '' if malformed."""
    return drop_www(authority(_assume_scheme(F.coalesce(url, F.lit("")))))


def url_path(url: Column) -> Column:
    """Path without query, fragment and last-segment parameters."""
    return F.regexp_replace(F.regexp_extract(_tidy(url), _PATH, 1), r";[^/]*$", "")


def trim_slash(url: Column) -> Column:
    return F.regexp_replace(url, r"/+$", "")


def host_suffixes(host: Column) -> Column:
    """The host and each parent domain of it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def same_site(url: Column, base_authority: Column) -> Column:
    """Host equals the base host or lies below it; ``www.`` does not count."""
    base = drop_www(base_authority)
    return bind(drop_www(authority(url)), lambda host: (host == base) | host.endswith(F.concat(F.lit("."), base)))


# --- links -------------------------------------------------------------------

def page_hrefs(html: Column) -> Column:
    """Link targets of a page as written, in order, without dead schemes."""
    raw = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(vocab.ANCHOR_HREF), F.lit(1))
    trimmed = F.transform(raw, lambda h: F.regexp_replace(h, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    dead = "^(?:" + "|".join(vocab.SKIP_SCHEMES) + ")"
    return F.filter(trimmed, lambda h: (h != "") & ~h.rlike(dead))


def _drop_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        )
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` seen from ``base`` (no fragments in either)."""
    return bind(_base_parts(base), lambda b: _resolve(href, b))


def _base_parts(base: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(base, _SCHEME, 1)).alias("scheme"),
        F.regexp_extract(base, _AUTHORITY, 1).alias("place"),
        F.regexp_extract(base, _PATH, 1).alias("path"),
    )


def _resolve(href: Column, base: Column) -> Column:
    """``resolve_link`` with the parts of the base; whatever a step uses twice is bound."""
    scheme, place, base_path = base["scheme"], base["place"], base["path"]

    def rooted(path: Column) -> Column:
        folder = F.regexp_replace(base_path, r"[^/]+$", "")
        beside = F.regexp_replace(F.concat(F.lit("/"), folder, F.lit("/"), path), r"/{2,}(?!$)", "/")
        beside = F.regexp_replace(beside, r"/{2,}$", "/")
        merged = F.when(path.startswith("/"), path).otherwise(beside)
        dotted = r"(?:^|/)\.\.?(?:/|$)"
        plain = bind(merged, lambda m: F.when(m.rlike(dotted), _drop_dot_segments(m)).otherwise(m))
        return bind(plain, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))

    def resolve(link: Column) -> Column:
        tail = F.regexp_extract(link, r"^[^?]*(\?.+)$", 1)
        path = F.regexp_extract(link, r"^([^?]*)", 1)
        full = bind(path, lambda p: F.when(p == "", base_path).otherwise(rooted(p)))
        local = F.concat(scheme, F.lit("://"), place, full, tail)
        own_scheme = F.regexp_extract(link, _SCHEME, 1)
        return F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).otherwise(
            bind(
                own_scheme,
                lambda own: F.when(own == "", local)
                .when(
                    F.lower(own) == scheme,
                    F.concat(scheme, F.regexp_replace(F.regexp_replace(link, _SCHEME, ":"), r"\?$", "")),
                )
                .otherwise(link),
            )
        )

    # The scheme of the base without // behind it adds nothing: what follows is relative.
    beside_scheme = lambda link: (F.lower(F.regexp_extract(link, _SCHEME, 1)) == scheme) & ~link.rlike(_SCHEME + "//")
    relative = bind(_tidy(href), lambda link: F.when(beside_scheme(link), F.regexp_replace(link, _SCHEME, "")).otherwise(link))
    return bind(relative, resolve)


def resolve_on_site(hrefs: Column, base: Column) -> Column:
    """Distinct same-site absolute links among ``hrefs``, in order."""

    def resolved(b: Column) -> Column:
        absolute = F.transform(hrefs, lambda h: _resolve(h, b["parts"]))
        wanted = F.filter(absolute, lambda u: u.rlike("^https?://") & same_site(u, b["home"]))
        return F.array_distinct(wanted)

    # The parts of the base are taken once, not once per link.
    return bind(F.struct(_base_parts(base).alias("parts"), authority(base).alias("home")), resolved)


def page_links(html: Column, base: Column) -> Column:
    """Distinct same-site absolute links of a page, in order."""
    return resolve_on_site(page_hrefs(html), base)


def link_priority(url: Column) -> Column:
    """15 for the best path hint down to 1; 0 for downloads and no hint."""

    def rate(path: Column) -> Column:
        download = path.rlike("(?:" + any_of(vocab.SKIP_EXTENSIONS) + ")$")
        rating = F.when(download, F.lit(0))
        for index, hint in enumerate(vocab.LINK_HINTS):
            rating = rating.when(path.contains(hint), F.lit(len(vocab.LINK_HINTS) - index))
        return rating.otherwise(F.lit(0))

    return bind(F.lower(url_path(url)), rate)


# --- site classes ------------------------------------------------------------

def is_blocked(url: Column) -> Column:
    """Host is, or lies below, a domain that is never an own site."""
    return is_blocked_domain(domain_of(url))


def is_blocked_domain(domain: Column) -> Column:
    return domain.rlike(r"(?:^|\.)(?:" + any_of(vocab.BLOCKED_DOMAINS) + ")$")


def is_authoritative(url: Column) -> Column:
    """URL of an official directory rather than of a listing site."""
    lowered = F.lower(F.coalesce(url, F.lit("")))
    return ~lowered.rlike(any_of(vocab.NON_AUTHORITATIVE)) & (
        lowered.rlike(any_of(vocab.AUTHORITATIVE_DOMAINS))
        | (lowered.rlike(any_of(vocab.OFFICIAL_TLDS)) & lowered.rlike(any_of(vocab.LISTING_HINTS)))
    )


def is_aggregator(url: Column) -> Column:
    """URL of a listing site that names are taken from."""
    return F.lower(F.coalesce(url, F.lit(""))).rlike(any_of(vocab.AGGREGATOR_HOSTS))
