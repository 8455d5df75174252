"""Registered queries on pages, texts, cells and changes of the roster, with SQL for the same rows.

Cells and URLs in the forms that the rules tell apart are derived from the keys
of customer and orders; pages and documents are read as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.functions import emails, phones, text, urls
from rosterlake.operators import crawl, growth, ledger, merge, sites
from rosterlake.registered import _pick, _table, roster

_HOSTS = (*vocab.BLOCKED_DOMAINS, *vocab.AUTHORITATIVE_DOMAINS, "city.gov.in", "plain.example.org")
_STARTS, _ENDS = ("https://www.", "http://m.", "HTTPS://not"), ("/", "/college-list", "/about?q=list", "")
_TAILS = ("", ".pdf", "/deep/", ".PNG", ".html")
_COURSES = ("BCA (Hons)", "Master of Computer Applications", "B.E.", "", "Civil")
_CELLS = ("N/A", "  two   words ", "-", "Nil", "", "plain")
_WEBSITES = ("a.example.org", "http://b.example.org", "https://c.example.org", "")
_EDITS = ("website", "placement_email", "status", "outreach_status")
_VALUES = (*vocab.OUTREACH, "x@example.org", "unheard of")
_NOW, _THEN = "2025-01-01 00:00:00", "2024-01-01 00:00:00"


# --- pages and URLs ----------------------------------------------------------

def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hrefs = urls.page_hrefs(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.size(hrefs).alias("n_links"), F.array_join(hrefs, " ").alias("hrefs"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(urls.page_links(F.col("html"), F.col("url"))).alias("link"))


def link_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    plain = F.regexp_replace("url", r"[?#].*$", "")
    url = F.concat(plain, F.lit("/"), _pick(key, ("", *vocab.LINK_HINTS)), _pick(key, _TAILS))
    return _table(spark, sf_dir, "pages").select("page_id", urls.link_priority(url).alias("priority"))


def site_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    url = F.concat(_pick(key, _STARTS), _pick(key, _HOSTS), _pick(key, _ENDS))
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", urls.domain_of(url).alias("domain"), urls.is_blocked(url).alias("blocked"),
        urls.is_authoritative(url).alias("authoritative"), urls.is_aggregator(url).alias("aggregator"),
    )


def pages_of_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages under each parent of a page host that has two labels or more."""
    facts = _table(spark, sf_dir, "pages").select("page_id", urls.domain_of(F.col("url")).alias("host"))
    parents = facts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("site")).where(F.col("site").contains("."))
    return sites.pages_of_sites(facts, sites.site_table(parents)).select("site_host", "page_id", "host")


def guessed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.guessed_urls(roster(spark, sf_dir).select(F.concat("website", F.lit("//")).alias("site")))


def best_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as search results: the customer is the organisation, the order number the rank."""
    found = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("org_id"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("https://s"), F.col("o_orderkey"), F.lit(".org")).alias("url"),
        F.concat(F.lit("s"), F.col("o_orderkey"), F.lit(".org")).alias("domain"), (F.col("o_orderkey") % 97 - 10).cast("int").alias("score"),
        F.array("o_orderstatus").alias("reasons"),
    )
    return sites.best_sites(found).select("org_id", "url", "score")


# --- texts and cells ---------------------------------------------------------

def document_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in whole documents; their reserved domain, which the rule calls junk, is renamed first."""
    named = F.regexp_replace("text", r"([@.])example\.", "$1sample.")
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(emails.emails_in_text(named)).alias("email"))


def document_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.acronym(F.col("text")).alias("initials"))


def _phone_cell() -> Column:
    key = F.col("c_custkey")
    digits = F.lpad((key * 7919 % 100000000).cast("string"), 8, "0")
    other = F.lpad((key % 100).cast("string"), 8, "0")
    return F.concat(F.lit("+91 98"), digits, F.lit("; 0-97"), digits, F.lit(" / 0091-96"), digits, F.lit("|12"), digits, F.lit(", 22"), other, F.lit("\n9198"), digits)


def cell_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(phones.phones_in_cell(_phone_cell())).alias("phone"))


def cell_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    cell = F.concat(F.lit("Info"), key, F.lit("@Example.org; no address / tpo."), key, F.lit("@a.example.org,info"), key, F.lit("@example.org | x@y"))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(emails.emails_in_cell(cell)).alias("email"))


def cleaned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", text.clean_cell(_pick(key, _CELLS)).alias("cell"), text.with_scheme(_pick(key, _WEBSITES)).alias("website"),
        text.classify_stream(_pick(key, _COURSES), vocab.STREAMS[1]).alias("stream"), text.repair_name(F.concat(F.lit("Ma[] "), F.col("c_name"))).alias("name"),
    )


# --- changes -----------------------------------------------------------------

def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows of all customers; every other one by name."""
    then = F.lit(_THEN).cast("timestamp")
    given = {
        "confidence_score": F.lit(10), "email_verified": F.lit(True), "last_scraped": then, "created_at": then, "updated_at": then,
        "outreach_status": F.lit(vocab.OUTREACH[1]),
    }
    rows = roster(spark, sf_dir)
    return rows.select(*[
        (given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.STORE_SCHEMA
    ])


def _orders_of(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store rows once per order of their customer."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("normalized_name"))
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(rows, "normalized_name")


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an even last digit are stored; each order offers a record for its customer."""
    rows, at = _stored(spark, sf_dir), F.col("o_orderkey")
    offered = _orders_of(rows, spark, sf_dir).withColumns({
        "placement_email": F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("o"), at, F.lit("@example.org"))).otherwise(""),
        "confidence_score": (at % 100).cast("int"), "status": _pick(at, vocab.STATUSES), "pos": at,
    }).drop("outreach_status", "created_at", "updated_at")
    merged = merge.upsert(rows.where(F.col("normalized_name").rlike("[02468]$")), offered, F.lit(_NOW).cast("timestamp"))
    return merged.select(
        "normalized_name", "district", "stream", "placement_email", "confidence_score", "status", "outreach_status",
        F.year("created_at").alias("created"), F.year("updated_at").alias("updated"),
    )


def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, at = _stored(spark, sf_dir), F.col("o_orderkey")
    edits = _orders_of(rows, spark, sf_dir).select(*schema.KEY, _pick(at, _EDITS).alias("column"), _pick(at, _VALUES).alias("value"), at.alias("seq"))
    fixed = merge.apply_corrections(rows, edits, F.lit(_NOW).cast("timestamp"))
    return fixed.select("normalized_name", "website", "placement_email", "status", "outreach_status", F.year("updated_at").alias("updated"))


def file_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: first non-empty type, first value that isn't 0."""
    at = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select(
        "user_id", F.when(at % 3 == 0, "").otherwise(F.col("event_type")).alias("event_type"), F.when(at % 5 != 0, F.col("value")).otherwise(0.0).alias("value"), at.alias("pos")
    )
    return merge.first_filled(rows, ["user_id"])


def new_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders propose their customer for one of the targets, or for none; the even customers are stored."""
    at, none = F.col("o_orderkey"), ("Elsewhere", "BCA")
    targets = (*vocab.GROW_TARGETS, none)
    customer = _table(spark, sf_dir, "customer")
    seeds = _table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("college_name"), _pick(at, [t[0] for t in targets]).alias("state"), _pick(at, [t[1] for t in targets]).alias("stream"), at.alias("pos")
    )
    stored = customer.where(F.col("c_custkey") % 2 == 0).select(F.lower(F.translate("c_name", "#", " ")).alias("normalized_name"))
    return growth.new_candidates(seeds, stored).select("name_key", "state", "stream", "pos")


def current_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run events; each is delivered twice."""
    at = F.col("event_id")
    told = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), at.alias("seq"), F.col("ts").alias("at"), F.lit("S").alias("state"), F.lit("BCA").alias("stream"),
        _pick(at, (*vocab.RUN_STATUSES, "unknown")).alias("status"), (at % 50).alias("total_colleges"), (at % 3).alias("processed"),
        F.when(at % 2 == 0, 1).cast("bigint").alias("succeeded"), F.lit(0).cast("bigint").alias("failed"), F.when(at % 4 == 0, F.col("event_type")).alias("notes"),
    )
    return ledger.current_runs(told.union(told)).select("run_id", "status", "total_colleges", "processed", "succeeded", "failed", "notes")


QUERIES = {
    f.__name__: f
    for f in (
        page_hrefs, page_links, link_priorities, site_classes, pages_of_sites, guessed_urls, best_sites, document_emails, document_acronyms,
        cell_phones, cell_emails, cleaned_cells, upsert_merge, patch_apply, file_dedupe, new_candidates, current_runs,
    )
}


def _list(values) -> str:
    return f"[{', '.join(repr(v) for v in values)}]"


def _chosen(key: str, values) -> str:
    return f"({_list(values)})[{key} % {len(values)} + 1]"


def _words(values) -> str:
    return "|".join(v.replace(".", "\\.") for v in values)


_HREFS = f"""
with raw as (
  select page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''#]+)', 1)) as h,
    generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''#]+)', 1), 1) as pos from pages
), href as (
  select page_id, url, pos, regexp_replace(h, '^\\s+|\\s+$', '', 'g') as h from raw
  where regexp_replace(h, '^\\s+|\\s+$', '', 'g') <> '' and not regexp_matches(regexp_replace(h, '^\\s+', ''), '^({"|".join(vocab.SKIP_SCHEMES)})')
)
"""
_HINT_CASES = " ".join(f"when contains(path, '{h}') then {len(vocab.LINK_HINTS) - i}" for i, h in enumerate(vocab.LINK_HINTS))
_STORED = f"""
with stored as (
  select c_custkey as k, lower(c_name) as normalized_name, r_name as district, {_chosen("c_custkey", vocab.STREAMS)} as stream,
    case c_custkey % 3 when 0 then 'placement' || c_custkey || '@example.org' when 1 then '' end as email,
    'https://org' || c_custkey || '.example.org' as website, {_chosen("c_custkey", vocab.STATUSES)} as status
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)
"""

ORACLES = {
    "page_hrefs": _HREFS + """
        select p.page_id, count(h.h)::int as n_links, coalesce(string_agg(h.h, ' ' order by h.pos), '') as hrefs
        from pages p left join href h on p.page_id = h.page_id group by 1""",
    "page_links": _HREFS + """
        , placed as (
          select page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') as home,
            case when regexp_matches(h, '^[a-z]+://') then h else regexp_extract(url, '^[a-z]+://[^/?#]+') || h end as link
          from href where regexp_matches(h, '^(/|[a-z]+://)')
        )
        select distinct page_id, link from placed where starts_with(link, 'http')
          and regexp_replace(regexp_extract(link, '//([^/?#]+)', 1), '^www\\.', '') = regexp_replace(regexp_extract(home, '//(.+)', 1), '^www\\.', '')""",
    "link_priorities": f"""
        select page_id, case when regexp_matches(path, '({_words(vocab.SKIP_EXTENSIONS)})$') then 0 {_HINT_CASES} else 0 end as priority
        from (select page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') || '/'
          || {_chosen("page_id", ("", *vocab.LINK_HINTS))} || {_chosen("page_id", _TAILS)}) as path from pages)""",
    "site_classes": f"""
        with u as (
          select c_custkey, lower({_chosen("c_custkey", _STARTS)} || {_chosen("c_custkey", _HOSTS)} || {_chosen("c_custkey", _ENDS)}) as url from customer
        ), d as (select *, regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') as domain from u)
        select c_custkey, domain, regexp_matches(domain, '(^|\\.)({_words(vocab.BLOCKED_DOMAINS)})$') as blocked,
          not regexp_matches(url, '{_words(vocab.NON_AUTHORITATIVE)}') and (regexp_matches(url, '{_words(vocab.AUTHORITATIVE_DOMAINS)}')
            or regexp_matches(url, '{_words(vocab.OFFICIAL_TLDS)}') and regexp_matches(url, '{_words(vocab.LISTING_HINTS)}')) as authoritative,
          regexp_matches(url, '{_words(vocab.AGGREGATOR_HOSTS)}') as aggregator
        from d""",
    "pages_of_sites": """
        with f as (select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') as host from pages),
        s as (select distinct regexp_replace(host, '^[^.]*\\.', '') as site_host from f)
        select site_host, page_id, host from f join s on host = site_host or ends_with(host, '.' || site_host) where contains(site_host, '.')""",
    "guessed_urls": f"""
        select 'https://org' || c_custkey || '.example.org//' as site, i::int as pos, 'https://org' || c_custkey || '.example.org' || ({_list(vocab.GUESS_PATHS)})[i + 1] as url
        from customer, range({len(vocab.GUESS_PATHS)}) r(i)""",
    "best_sites": f"""
        select org_id, url, score from (
          select o_custkey as org_id, 'https://s' || o_orderkey || '.org' as url, (o_orderkey % 97 - 10)::int as score,
            row_number() over (partition by o_custkey order by o_orderkey % 97 desc, o_orderkey) as place from orders
        ) where place = 1 and score >= {vocab.MIN_SITE_SCORE}""",
    "document_emails": f"""
        with found as (
          select doc_id, regexp_replace(lower(unnest(regexp_extract_all(regexp_replace(text, '([@.])example\\.', '\\1sample.', 'g'), '{vocab.EMAIL_IN_TEXT}'))), '[.,;:)\\]}}>''"]+$', '') as a
          from documents
        ), repaired as (
          select doc_id, regexp_replace(a, '^[^@]*?\\d{{6,}}([a-z][^@]{{2,}}@)', '\\1') as email from found where not regexp_matches(a, '(?i){vocab.JUNK_EMAIL}')
        )
        select distinct doc_id, email from repaired where not regexp_matches(email, '^\\d')""",
    "document_acronyms": f"""
        select doc_id, array_to_string(list_transform(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: lower(w)),
          lambda w: not list_contains({_list(sorted(vocab.ACRONYM_SKIP))}, w)), lambda w: w[1]), '') as initials
        from documents""",
    "cell_phones": """
        with c as (
          select c_custkey, lpad((c_custkey * 7919 % 100000000)::varchar, 8, '0') as d, lpad((c_custkey % 100)::varchar, 8, '0') as e from customer
        ), parts as (
          select c_custkey, unnest(['+9198' || d, '097' || d, '009196' || d, '12' || d, '22' || e, '9198' || d]) as p from c
        ), one as (select c_custkey, regexp_replace(p, '^\\+', '') as p from parts
        ), two as (select c_custkey, case when regexp_matches(p, '^(0|91).{10}') then regexp_replace(p, '^(0|91)', '') else p end as p from one
        ), three as (select c_custkey, case when regexp_matches(p, '^(0|91).{10}') then regexp_replace(p, '^(0|91)', '') else p end as p from two)
        select distinct c_custkey, '+91-' || p as phone from three
        where regexp_matches(p, '^[2-9]\\d{9}$') and len(list_distinct(string_split(p, ''))) > 2""",
    "cell_emails": """
        select c_custkey, unnest(['info' || c_custkey || '@example.org', 'tpo.' || c_custkey || '@a.example.org']) as email from customer""",
    "cleaned_cells": f"""
        select c_custkey, ([null, 'two words', null, null, null, 'plain'])[c_custkey % 6 + 1] as cell,
          (['https://a.example.org', 'http://b.example.org', 'https://c.example.org', ''])[c_custkey % 4 + 1] as website,
          (['BCA', 'BCA', 'Engineering', '{vocab.STREAMS[1]}', 'Engineering'])[c_custkey % 5 + 1] as stream, 'Manan ' || c_name as name
        from customer""",
    "upsert_merge": _STORED + f"""
        , rows as (
          select k, -1 as seq, email, 10 as score, status from stored where regexp_matches(normalized_name, '[02468]$')
          union all
          select o_custkey, o_orderkey, case when o_orderstatus = 'F' then 'o' || o_orderkey || '@example.org' else '' end, o_orderkey % 100,
            {_chosen("o_orderkey", vocab.STATUSES)} from orders
        ), folded as (
          select k, arg_max(email, seq) filter (email <> '') as placement_email, max(score)::int as confidence_score, arg_max(status, seq) as status,
            min(seq) = -1 as had, max(seq) = -1 as untouched from rows group by k
        )
        select normalized_name, district, stream, placement_email, confidence_score, f.status,
          case when had then '{vocab.OUTREACH[1]}' else '{vocab.OUTREACH[0]}' end as outreach_status,
          case when had then 2024 else 2025 end::int as created, case when untouched then 2024 else 2025 end::int as updated
        from folded f join stored s on s.k = f.k""",
    "patch_apply": _STORED + f"""
        , edit as (
          select o_custkey as k, o_orderkey as seq, {_chosen("o_orderkey", _EDITS)} as c, {_chosen("o_orderkey", _VALUES)} as v from orders
        ), last as (
          select k, arg_max(v, seq) filter (c = 'website') as website, arg_max(v, seq) filter (c = 'placement_email') as email,
            arg_max(v, seq) filter (c = 'outreach_status') as outreach
          from edit where c in ('website', 'placement_email') or c = 'outreach_status' and list_contains({_list(vocab.OUTREACH)}, v) group by k
        )
        select normalized_name, coalesce(l.website, s.website) as website, coalesce(l.email, s.email) as placement_email, status,
          coalesce(l.outreach, '{vocab.OUTREACH[1]}') as outreach_status, case when l.k is null then 2024 else 2025 end::int as updated
        from stored s left join last l on s.k = l.k""",
    "file_dedupe": """
        select user_id, arg_min(event_type, event_id) filter (event_id % 3 <> 0 and event_type <> '') as event_type,
          arg_min(value, event_id) filter (event_id % 5 <> 0 and value <> 0) as value, min(event_id) as pos, count(*) as copies
        from events group by user_id""",
    "new_candidates": f"""
        select name_key, ({_list([t[0] for t in vocab.GROW_TARGETS])})[t + 1] as state, ({_list([t[1] for t in vocab.GROW_TARGETS])})[t + 1] as stream, pos from (
          select replace(lower(c_name), '#', ' ') as name_key, o_orderkey % 7 as t, o_orderkey as pos,
            row_number() over (partition by c_custkey order by o_orderkey % 7, o_orderkey) as place
          from orders join customer on o_custkey = c_custkey where c_custkey % 2 = 1 and o_orderkey % 7 < 6
        ) where place = 1""",
    "current_runs": f"""
        select user_id::varchar as run_id, arg_max(({_list(vocab.RUN_STATUSES)})[event_id % 5 + 1], event_id) as status, max(event_id % 50) as total_colleges,
          sum(event_id % 3)::bigint as processed, coalesce(sum(1) filter (event_id % 2 = 0), 0)::bigint as succeeded, 0::bigint as failed,
          arg_max(event_type, event_id) filter (event_id % 4 = 0) as notes
        from events where event_id % 5 < 4 group by 1""",
}
