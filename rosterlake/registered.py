"""Registered queries over the given tables, and the SQL that states the same rows.

The roster is derived from customer, nation and region: one organisation per
customer, with contacts that are present, blank or missing by customer key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlake import vocab
from rosterlake.functions.urls import domain_of
from rosterlake.operators import growth, ledger, roster as views
from rosterlake.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: F.Column, values) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's columns that the registered views read, one row per customer."""
    key = F.col("c_custkey")
    text, digits = key.cast("string"), F.lpad(key.cast("string"), 8, "0")
    rows = (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(
        F.col("c_name").alias("college_name"),
        F.lower("c_name").alias("normalized_name"),
        F.col("r_name").alias("district"),
        F.col("n_name").alias("state"),
        _pick(key, vocab.STREAMS).alias("stream"),
        F.col("c_mktsegment").alias("affiliation"),
        F.concat(F.lit("https://org"), text, F.lit(".example.org")).alias("website"),
        F.when(key % 3 == 0, F.concat(F.lit("placement"), text, F.lit("@example.org"))).when(key % 3 == 1, "").alias("placement_email"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("98"), digits)).alias("placement_phone"),
        F.when(key % 4 == 0, F.concat(F.lit("info"), text, F.lit("@example.org"))).alias("fallback_contact_email"),
        F.when(key % 5 == 0, F.concat(F.lit("97"), digits)).otherwise("").alias("fallback_contact_phone"),
        F.when(key % 6 == 0, F.array(F.concat(F.lit("a"), text, F.lit("@example.org")), F.lit("b@example.org"))).otherwise(F.array().cast("array<string>")).alias("backup_emails_found"),
        F.array(F.concat(F.lit("96"), digits)).alias("backup_phones_found"),
        _pick(key, vocab.STATUSES).alias("status"),
        _pick(key, vocab.OUTREACH).alias("outreach_status"),
    )


def marketing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.marketing_rows(roster(spark, sf_dir))


def marketing_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.marketing_rows(roster(spark, sf_dir), stream=vocab.STREAMS[0], outreach_status=vocab.OUTREACH[0], search="R#0000")


def admin_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.admin_view(roster(spark, sf_dir), state="NATION_3", status=vocab.STATUSES[0], sort="state", direction="desc")
    return rows.select("college_name", "state", "stream", "status", "outreach_status")


def best_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster(spark, sf_dir).select(
        "college_name", views.best_email().alias("email"), views.best_phone().alias("phone"), views.is_complete().alias("complete")
    )


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.status_counts(roster(spark, sf_dir))


def coverage_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.coverage(roster(spark, sf_dir))


def coverage_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.coverage(roster(spark, sf_dir), ("state", "stream"))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("endpoint"),
        F.col("value").alias("credits_charged"), F.col("value").alias("balance"),
    )


def spend_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.spend_by_endpoint(_calls(spark, sf_dir)).withColumn("credits", F.col("credits").cast("double"))


def admitted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    kept = ledger.admitted_calls(_calls(spark, sf_dir), 50.0)
    return kept.select("run_id", "seq", F.col("spent_before").cast("double").alias("spent_before"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = _table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Verified").alias("status")
    )
    return ledger.run_counters(results)


def grow_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    attempts = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("complete"))
    return growth.grow_until(attempts, 1500, start=20)


def page_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", domain_of(F.col("url")).alias("domain"))


QUERIES = {
    f.__name__: f
    for f in (
        marketing_rows, marketing_filtered, admin_filtered, best_contacts, status_counts, coverage_total, coverage_by_state,
        spend_by_endpoint, admitted_calls, run_counters, grow_to_target, page_domains,
    )
}


def _choice(values) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[c_custkey % {len(values)} + 1]"


_ROSTER = f"""
with roster as (
  select *, coalesce(nullif(placement_email, ''), nullif(fallback_contact_email, '')) as email,
    coalesce(nullif(placement_phone, ''), nullif(fallback_contact_phone, '')) as phone
  from (
    select c_name as college_name, n_name as state, {_choice(vocab.STREAMS)} as stream, c_mktsegment as affiliation,
      'https://org' || c_custkey || '.example.org' as website,
      case c_custkey % 3 when 0 then 'placement' || c_custkey || '@example.org' when 1 then '' end as placement_email,
      case when c_acctbal > 0 then '98' || lpad(c_custkey::varchar, 8, '0') end as placement_phone,
      case when c_custkey % 4 = 0 then 'info' || c_custkey || '@example.org' end as fallback_contact_email,
      case when c_custkey % 5 = 0 then '97' || lpad(c_custkey::varchar, 8, '0') else '' end as fallback_contact_phone,
      case when c_custkey % 6 = 0 then 'a' || c_custkey || '@example.org, b@example.org' else '' end as all_emails_found,
      '96' || lpad(c_custkey::varchar, 8, '0') as all_phones_found,
      {_choice(vocab.STATUSES)} as status, {_choice(vocab.OUTREACH)} as outreach
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  )
)
"""
_OUTWARD = """select college_name, state, stream, affiliation, website, email, phone, all_emails_found, all_phones_found,
  '' as outreach_status from roster where email is not null and phone is not null"""
_COVERAGE = """count(*) as total, count(*) filter (email is not null and phone is not null) as visible,
  count(*) filter (email is null or phone is null) as hidden, count(*) filter (email is null) as missing_email,
  count(*) filter (phone is null) as missing_phone from roster"""

ORACLES = {
    "marketing_rows": _ROSTER + _OUTWARD,
    "marketing_filtered": _ROSTER + _OUTWARD + f" and stream = '{vocab.STREAMS[0]}' and outreach = '{vocab.OUTREACH[0]}' and contains(lower(college_name), 'r#0000')",
    "admin_filtered": _ROSTER + f"select college_name, state, stream, status, outreach as outreach_status from roster where state = 'NATION_3' and status = '{vocab.STATUSES[0]}'",
    "best_contacts": _ROSTER + "select college_name, email, phone, email is not null and phone is not null as complete from roster",
    "status_counts": _ROSTER + "select status, count(*) as n from roster group by status",
    "coverage_total": _ROSTER + "select " + _COVERAGE,
    "coverage_by_state": _ROSTER + "select state, stream, " + _COVERAGE + " group by state, stream",
    "spend_by_endpoint": """
        select event_type as endpoint, grouping(event_type) = 1 as is_total, count(*) as calls,
          sum(coalesce(value, 0)::decimal(18,6))::double as credits, max_by(value, event_id) as balance
        from events group by grouping sets ((event_type), ())""",
    "admitted_calls": """
        select run_id, seq, spent_before from (
          select user_id as run_id, event_id as seq, (sum(v) over (partition by user_id order by event_id) - v)::double as spent_before
          from (select user_id, event_id, coalesce(value, 0)::decimal(18,6) as v from events)
        ) where spent_before < 50""",
    "run_counters": """
        select o_orderpriority as run_id, count(*) as processed, count(*) filter (o_orderstatus <> 'F') as succeeded,
          count(*) filter (o_orderstatus = 'F') as failed from orders group by 1""",
    "grow_to_target": f"""
        with counted as (
          select o_orderkey as seq, o_orderstatus = 'F' as complete, row_number() over (order by o_orderkey) as attempted,
            sum((o_orderstatus = 'F')::bigint) over (order by o_orderkey)::bigint as completed from orders
        ), judged as (
          select *, case
            when attempted >= {vocab.ABORT_AFTER} and (completed - complete::int) / attempted::double < {vocab.ABORT_BELOW} then 'aborted'
            when completed + 20 >= 1500 then 'target reached' else 'continue' end as outcome from counted
        )
        select * from judged where attempted <= coalesce((select min(attempted) from judged where outcome <> 'continue'), 9223372036854775807)""",
    "page_domains": "select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\\.', '') as domain from pages",
}
