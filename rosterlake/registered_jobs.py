"""Registered queries on files, streams, sites, seeds and matches, with SQL for the same rows.

Names, cells, pages and payloads are built from the text columns and keys of the
tables, alike in Spark and in SQL; the SQL then states the rule that is applied.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.functions import emails, html, payloads, text, urls
from rosterlake.operators import channels, contacts, crawl, growth, ledger, matching, places, roster as views, sites
from rosterlake.plans import fill
from rosterlake.plans.importer import ImportPlan, plan_import
from rosterlake.plans.resolve import ResolveInputs, resolve
from rosterlake.plans.seeds import merged_seeds
from rosterlake.registered import _ROSTER, _pick, _table, roster
from rosterlake.registered_more import _HINT_CASES, _chosen, _list, _stored, _words
from rosterlake.session import checkpoint_dir, configure, spread
from rosterlake.sources.export import export_rows, write_export
from rosterlake.sources.reference import read_districts
from rosterlake.sources.seeds import read_seeds, write_seeds
from rosterlake.sources.snapshot import export_snapshot, read_snapshot, snapshot_diff, snapshot_rows
from rosterlake.sources.tables import read_contact_files
from rosterlake.streaming.store_stream import count_results


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/rosterlake-{uuid.uuid4().hex}/{name}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, name, segment, state and district of each customer."""
    rows = (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("state"), F.col("r_name").alias("district"),
    )


# --- contact files -----------------------------------------------------------

_BLANK_CELLS = ("N/A", "-", " nil ", "Not Available")


def _contact_plan(spark: SparkSession, sf_dir: str) -> ImportPlan:
    """Customers as CSV files of three kinds: other headers, order of columns and encoding in each."""
    configure(spark)
    k, path = F.col("k"), _folder(spark, "contacts")
    name = F.concat(F.lit("Collège "), F.initcap("segment"), F.lit(" "), (F.floor(k / 2)).cast("string"))
    mail = F.when(k % 5 == 0, _pick(k, _BLANK_CELLS)).otherwise(F.concat(F.lit("Info"), k, F.lit("@"), F.lower("segment"), F.lit(".org; second"), k, F.lit("@b.org")))
    state = F.when(k % 7 == 0, "-").otherwise(F.col("state"))
    phone = F.concat(F.lit("+91 98"), F.lpad(k.cast("string"), 8, "7"))
    kinds = {
        "UTF-8": {"College": name, "State": state, "Contact Email": mail},
        "ISO-8859-1": {"pos": k.cast("string"), "Name of the Institution": name, "State Name": state, "Mobile No": phone, "E-mail": mail},
        "utf8 with notes": {"State": state, "Notes": F.concat(F.lit('line, "one"\n'), F.col("segment")), "Institute Name": name, "Phone": phone},
    }
    for i, (kind, columns) in enumerate(kinds.items()):
        rows = _customers(spark, sf_dir).where(k % 3 == i).select(*[c.alias(h) for h, c in columns.items()])
        rows.write.csv(f"{path}/{i}", header=True, quote='"', escape='"', encoding=kind if i < 2 else "UTF-8")
    return plan_import(read_contact_files(spark, f"{path}/*"))


def contact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _contact_plan(spark, sf_dir).rows
    return rows.select("college_name", "state", "placement_email", F.array_join("backup_emails_found", " ").alias("more"), "placement_phone", "reject")


def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contact_plan(spark, sf_dir).report()


def streamed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results that arrive as a stream; the ledger of the run when it has ended."""
    configure(spark)
    batch = _table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "Failed").otherwise("Verified")
    # A stream reads folders or patterns; the pattern names the table whether it is a file or a folder.
    results = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/[e]vents.parquet").select(status.alias("status"))
    path = _folder(spark, "runs")
    run = count_results(results, run_id="events", ledger_path=f"{path}/ledger", checkpoint=f"{path}/checkpoint", state="S", stream="BCA")
    run.finish()
    runs = ledger.current_runs(ledger.read_events(spark, f"{path}/ledger"))
    return runs.select("run_id", "state", "status", "processed", "succeeded", "failed")


# --- sites and pages ---------------------------------------------------------

_PATH_WORDS = ("placement", "library", "about", "contact", "news/training", "careers.pdf", "recruiters")


def _page_of(k: Column) -> Column:
    """URL of a customer's page: 25 sites, the customers below 25 are their home pages."""
    home = F.concat(F.lit("https://www.n"), (k % 25).cast("string"), F.lit(".example.org"))
    return F.when(k < 25, home).otherwise(F.concat(home, F.lit("/"), _path_of(k)))


def _path_of(k: Column) -> Column:
    return F.concat(k.cast("string"), F.lit("/"), _pick(k, _PATH_WORDS))


def _site_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sites, and the page index: each page links to three later ones of its site, some of which don't exist."""
    k = F.col("c_custkey")
    place, site = F.floor(k / 25), k % 25
    links = F.array(*[F.concat(F.lit("/"), _path_of(j * 25 + site)) for j in (place * 2 + 1, place * 2 + 2, place + 3)])
    pages = _table(spark, sf_dir, "customer").select(_page_of(k).alias("url_key"), links.alias("hrefs"))
    return _table(spark, sf_dir, "nation").select(_page_of(F.col("n_nationkey").cast("bigint")).alias("site")), pages


def best_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return crawl.best_first_pages(*_site_graph(spark, sf_dir), max_pages=10, max_depth=4).select("site", "page_no", "url")


def all_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that promising links lead to, with its number."""
    configure(spark)
    return crawl.choose_pages(*_site_graph(spark, sf_dir)).select("site", "page_no", "url")


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed pages by priority, then guessed ones; ten tried, four read of each site."""
    configure(spark)
    sites, pages = _site_graph(spark, sf_dir)
    k = F.col("c_custkey")
    listed = _table(spark, sf_dir, "customer").where(k % 2 == 1).select(_page_of(k % 25).alias("site"), _page_of(k + 25 * (k % 3)).alias("url"), k.cast("int").alias("pos"))
    once = listed.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    return crawl.budget_pages(sites, once, pages, budget=4, attempts=10).select("site", "page_no", "url")


# --- contacts ----------------------------------------------------------------

_LOCALS = (*vocab.PLACEMENT_LOCALS, *vocab.GENERIC_LOCALS, *vocab.JUNK_LOCALS, "k.rao", "r_devi")
_PAGE_PATHS = ("/", "/Placement", "/about", "/tpo/team", "/contact")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sightings of addresses and numbers on pages of their customer's site."""
    at, org = F.col("o_orderkey"), F.col("o_custkey")
    domain = F.concat(F.lit("org"), org, F.lit(".ac.in"))
    host = F.when(at % 3 == 0, domain).when(at % 3 == 1, F.concat(F.lit("mail."), domain)).otherwise(_pick(at, (*vocab.FREE_MAIL_HOSTS, "else.example")))
    mail = F.concat(_pick(at * 7, _LOCALS), F.lit("@"), host)
    is_mail = at % 4 != 0
    return _table(spark, sf_dir, "orders").select(
        org.alias("site"), (at % 9).cast("int").alias("page_no"), F.concat(F.lit("https://"), domain, _pick(at, _PAGE_PATHS)).alias("source_url"),
        (F.col("o_orderstatus") == "F").alias("wording"), F.when(is_mail, "email").otherwise("phone").alias("kind"),
        F.when(is_mail, mail).otherwise(F.concat(F.lit("+91-98"), F.lpad((at % 40).cast("string"), 8, "0"))).alias("value"), at.cast("int").alias("i"),
        domain.alias("site_domain"),
    )


def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = contacts.score_sightings(_sightings(spark, sf_dir))
    return scored.select(F.col("i").alias("o_orderkey"), "kind", "value", "score", F.size("reasons").alias("n_reasons"))


def site_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contacts of each customer: placement, fallback and backups."""
    best = contacts.best_sightings(contacts.score_sightings(_sightings(spark, sf_dir)))
    split = contacts.split_contacts(best)
    return split.select(
        "site", "placement_email", "fallback_contact_email", F.array_join("backup_emails_found", " ").alias("backup_emails"),
        "placement_phone", "fallback_contact_phone", F.array_join("backup_phones_found", " ").alias("backup_phones"), "placement_score",
    )


def leading_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = contacts.best_sightings(contacts.score_sightings(_sightings(spark, sf_dir)))
    return contacts.leading_contacts(best)


# --- names -------------------------------------------------------------------

_PREFIXES = ("", "Sri ", "Dr. ", "THE ", "Smt. ")
_SUFFIXES = (" College of Engineering", " Inst. of Tech.", ", North Campus", " ENGG. COLLEGE", "", " Écoles & Co", " Institute of Technology and Science (Autonomous)")


def _part_name() -> Column:
    k = F.col("p_partkey")
    shown = F.when(k % 2 == 0, F.initcap("p_name")).otherwise(F.upper("p_name"))
    return F.concat(_pick(k, _PREFIXES), shown, F.lit(" "), F.col("p_type"), _pick(k, _SUFFIXES))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", _part_name().alias("college_name"))
    return growth.with_name_key(parts).select("p_partkey", "name_key")


_BADGES = ("", "Featured ", "3. ", "| ", "AD  ", "trending   ")
_LISTING_ENDS = (" College", " Institute (Autonomous)", " University - Admission 2024", " Academy : fees and more", " Works", " Colleges in Goa", " School, ranking", " College placements")


def listing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    listed = F.concat(_pick(k, _BADGES), F.initcap("p_name"), _pick(k, _LISTING_ENDS))
    return _table(spark, sf_dir, "part").select("p_partkey", text.clean_listing_name(listed).alias("name"))


def names_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that mention a nation, a region, a place abroad or none, against the region as their state."""
    reference = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("state"), F.col("n_name").alias("district")
    )
    k = F.col("k")
    named = F.when(k % 4 == 0, F.col("state")).when(k % 4 == 1, F.col("district")).when(k % 4 == 2, _pick(k, (*vocab.FOREIGN_MARKERS, *vocab.OUT_OF_SCOPE_PLACES))).otherwise("nowhere")
    other = _pick(k, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    rows = _customers(spark, sf_dir).select("k", F.concat(F.initcap("segment"), F.lit(" College "), F.initcap(named)).alias("college_name"), other.alias("state"))
    return places.plausibly_in_state(rows, reference).select("k", "in_state")


# --- seeds -------------------------------------------------------------------

def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of three channels; three of a name, with and without district."""
    k = F.col("k")
    district = F.when(k % 5 < 2, "").when(k % 5 == 2, F.lower("district")).otherwise(F.col("district"))
    every = _customers(spark, sf_dir).select(
        "k", F.struct(k.alias("a"), F.lit(0).cast("bigint").alias("b")).alias("pos"),
        F.concat(F.lit("Group "), (F.floor(k / 6)).cast("string"), F.lit(" College")).alias("college_name"), F.lit("S").alias("state"), _pick(F.floor(k / 6), vocab.STREAMS).alias("stream"),
        district.alias("district"), F.when(k % 4 == 0, F.concat(F.lit("street "), k)).otherwise("").alias("address"),
        F.when(k % 3 == 0, F.concat(F.lit("98"), k)).otherwise("").alias("phone"), F.when(k % 7 == 0, F.concat(F.lit("https://w"), k)).otherwise("").alias("website"),
        F.when(k % 2 == 0, F.col("segment")).otherwise("").alias("affiliation"), F.array(F.concat(F.lit("https://list/"), k % 11)).alias("source_urls"),
    )
    parts = [every.where(k % 6 < hi).where(k % 6 >= lo).withColumns({"channel": F.lit(c), "source": F.lit(c)}) for c, lo, hi in (("maps", 0, 3), ("directory", 2, 5), ("aggregator", 4, 6))]
    return channels.union_channels(*parts)


def seed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return merged_seeds(_seeds(spark, sf_dir)).select(
        "stream", "college_name", "district", "address", "phone", "website", "affiliation", "source", F.array_join("source_urls", " ").alias("urls"), "pos"
    )


def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.corroboration(channels.merge_channels(_seeds(spark, sf_dir)))


def channel_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir)
    return channels.channel_yield(seeds, channels.merge_channels(seeds))


# --- matches -----------------------------------------------------------------

def _orgs_and_contacts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers, and one contact row for each order of theirs, in another spelling and sometimes another state or stream."""
    orgs = _customers(spark, sf_dir).select(F.col("k").alias("pos"), F.when(F.col("k") % 17 == 0, " ").otherwise(F.col("name")).alias("name"), "state", _pick(F.col("k"), vocab.STREAMS).alias("stream"))
    at = F.col("o_orderkey")
    rows = _table(spark, sf_dir, "orders").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("k"))
    phone = F.concat(F.lit("0 98"), F.lpad((at % 1000 * 37).cast("string"), 8, "0"))
    listed = F.concat(phone, F.lit(" / 12345; 97"), F.lpad((at % 100).cast("string"), 8, "0"))
    found = rows.where(F.col("k") % 5 != 0).select(
        at.alias("pos"), F.upper(F.replace("name", F.lit("#"), F.lit(" - "))).alias("name"),
        F.when(F.col("k") % 3 == 0, "Elsewhere").otherwise(F.lower("state")).alias("state"),
        F.when(F.col("k") % 2 == 0, _pick(F.col("k"), vocab.STREAMS)).otherwise("other").alias("stream"),
        F.when(at % 6 == 0, "n/a").otherwise(listed).alias("phones"),
    )
    return orgs, found


def staged_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs, found = _orgs_and_contacts(spark, sf_dir)
    matched = matching.staged_match(orgs, matching.phone_indexes(matching.phone_sightings(found)))
    return matched.select("pos", "match_stage", "first_phone", "n_phones", "all_phones_found")


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs, found = _orgs_and_contacts(spark, sf_dir)
    sightings = matching.phone_sightings(found)
    return matching.match_report(matching.stage_matches(orgs, matching.phone_indexes(sightings), allow_name_only=True), sightings)


# --- snapshots and lookups ---------------------------------------------------

def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without a tenth of the customers against a snapshot without another tenth, some of its cells older."""
    stored = snapshot_rows(_stored(spark, sf_dir))
    n = F.substring("normalized_name", -9, 9).cast("int")
    old = stored.where(n % 10 != 1).withColumns({
        "status": F.when(n % 4 == 0, "Failed").otherwise(F.col("status")), "website": F.when(n % 6 == 0, "").otherwise(F.col("website")),
    })
    diff = snapshot_diff(stored.where(n % 10 != 0), old)
    return diff.select("normalized_name", "found", F.array_join("changed", " ").alias("changed"))


def snapshot_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as a snapshot in CSV, read again as records."""
    path = _folder(spark, "snapshot")
    export_snapshot(_stored(spark, sf_dir), path)
    return read_snapshot(spark, path).select(
        "college_name", "district", "state", "stream", "website", "placement_email", F.array_join("backup_emails_found", " ").alias("more"), "confidence_score",
        "email_verified", F.date_format("last_scraped", "yyyy-MM-dd").alias("day"), "status", "outreach_status",
    )


def seed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged seeds of a state and stream, written to the cache and read again while fresh."""
    configure(spark)
    path = _folder(spark, "seeds")
    write_seeds(merged_seeds(_seeds(spark, sf_dir)), path)
    return read_seeds(spark, path, "S", vocab.STREAMS[1]).select("college_name", "district", "phone", "source", "pos")


def marketing_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outward file, read again: its labels are its columns."""
    path = _folder(spark, "marketing")
    write_export(export_rows(roster(spark, sf_dir), state="NATION_7"), path)
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).select("College Name", "State", "Stream", "Email", "Phone")


def district_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their nations as the JSON reference, read again."""
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = rows.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    notes = listed.select(F.concat(F.lit("_"), "r_name").alias("r_name"), F.array(F.lit("a note")).alias("names"))
    both = listed.unionByName(notes).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("r_name", "names")))).alias("m"))
    path = _folder(spark, "districts")
    both.select(F.to_json("m").alias("value")).write.text(path)
    return read_districts(spark, path)


def org_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of each supplier's namesake among the customers, by the full key."""
    rows = roster(spark, sf_dir)
    wanted = _table(spark, sf_dir, "supplier").select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("normalized_name"))
    keys = rows.join(wanted, "normalized_name", "left_semi").select(*schema.KEY)
    return views.by_keys(rows, keys).select("college_name", *schema.KEY, "website", "status")


def _fill_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as targets with a site each, and its pages: some name their owner, some another one, some are missing."""
    k, site = F.col("k"), F.concat(F.lit("https://"), F.lower("segment"), F.col("k"), F.lit(".ac.in"))
    orgs = _customers(spark, sf_dir).select(
        F.concat(F.initcap("segment"), F.lit(" College of number "), k).alias("college_name"), F.col("name").alias("normalized_name"), "district",
        _pick(k, vocab.STREAMS).alias("stream"), site.alias("website"), k, F.col("segment"),
    )
    at, place = F.col("o_orderkey"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("path")) for i, p in enumerate(vocab.FILL_PATHS)]))
    newest = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("o_orderkey"))
    shown = orgs.join(newest, "k").withColumn("p", place).where((at + F.col("p.i")) % 3 != 0)
    owner = F.when(at % 4 == 0, "Another house").otherwise(F.col("college_name"))
    mail = F.when((at + F.col("p.i")) % 2 == 0, F.concat(F.lit("mail tpo"), k, F.lit("@gmail.com or office@"), F.lower("segment"), k, F.lit(".ac.in"))).otherwise("")
    call = F.when(F.col("p.i") == at % 5, F.concat(F.lit(" call 98450 "), F.lpad((k % 90000).cast("string"), 5, "1"))).otherwise("")
    html = F.concat(F.lit("<p>Welcome to "), owner, F.lit("</p> "), mail, call, F.lit("."))
    return orgs.drop("k", "segment"), shown.select(F.concat("website", "p.path").alias("url"), html.alias("html"))


def fill_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = fill.fill_contacts(*_fill_inputs(spark, sf_dir))
    return found.select("normalized_name", "site_verified", "pages_tried", "email", F.array_join("extra_emails", " ").alias("more"), "phone")


# --- sites of organisations, views and checks ---------------------------------

_RESULT_PATHS = ("/", "", "/colleges/all", "/about", "/search-page")


def _site_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as institutes, their orders as search results on hosts that resemble the name more or less."""
    orgs = _customers(spark, sf_dir).select(F.col("k").alias("org_id"), F.concat(F.initcap("segment"), F.lit(" Institute of Technology")).alias("college_name"), "segment")
    at, word = F.col("o_orderkey"), F.lower("segment")
    short, n = F.concat(F.substring(word, 1, 1), F.lit("it")), (F.col("o_orderkey") % 50).cast("string")
    hosts = [
        F.concat(word, F.lit(".ac.in")), F.concat(F.lit("www."), short, F.lit(".edu.in")), F.concat(short, F.lit("-"), n, F.lit(".org")), F.concat(F.lit("x"), short, F.lit(".com")),
        F.lit("www.collegedunia.com"), F.concat(F.lit("admission"), n, F.lit(".in")), F.concat(word, F.lit("-list.net")), F.concat(F.lit("p"), n, F.lit(".example")),
    ]
    host = F.element_at(F.array(*hosts), (at % len(hosts) + 1).cast("int"))
    title = F.when(at % 3 == 0, "").when(at % 3 == 1, F.concat(F.lit("The "), F.initcap("segment"), F.lit(" site"))).otherwise("Home")
    found = _table(spark, sf_dir, "orders").join(orgs, F.col("o_custkey") == F.col("org_id"))
    results = found.select("org_id", at.alias("rank"), F.concat(F.lit("https://"), host, _pick(F.floor(at / 8), _RESULT_PATHS)).alias("url"), title.alias("title"))
    return orgs.drop("segment"), results


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.score_candidates(*_site_results(spark, sf_dir)).select("org_id", "rank", "domain", "score")


def chosen_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best site of each institute, below the threshold none."""
    return sites.best_sites(sites.score_candidates(*_site_results(spark, sf_dir))).select("org_id", "url", "score")


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select(
        "page_id", urls.domain_of(url).alias("domain"), urls.is_blocked(url).alias("blocked"), urls.is_authoritative(url).alias("authoritative"), urls.is_aggregator(url).alias("aggregator")
    )


def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that headings and links of pages could hold."""
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.candidate_names(F.col("html"))).alias("place", "name"))


def document_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as cells: how many hold something, and how long they are once cleaned."""
    cells = F.transform(F.split("text", "\n"), text.clean_cell)
    kept = F.filter(cells, lambda c: c.isNotNull())
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(kept).alias("n_cells"), F.length(F.array_join(kept, "")).alias("n_chars"))


def admin_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the sorted admin view."""
    rows = views.admin_view(roster(spark, sf_dir), sort="state", direction="desc", limit=60, offset=30)
    return rows.select("college_name", "state", "stream")


def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten runs that began last; users as runs, their events as run events."""
    at = F.col("event_id")
    told = _table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), at.alias("seq"), F.col("ts").alias("at"), F.lit("S").alias("state"), F.lit("BCA").alias("stream"), F.lit("running").alias("status"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("total_colleges", "processed", "succeeded", "failed")], F.lit(None).cast("string").alias("notes"),
    )
    return ledger.recent_runs(ledger.current_runs(told), 10).select("run_id", "processed", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("started"))


def checked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster rows with checked addresses, numbers from a table of places and the status that follows."""
    rows = roster(spark, sf_dir).withColumn("email_verified", F.lit(False)).drop("status")
    checks = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("placement"), "o_custkey", F.lit("@example.org")).alias("email"), (F.col("o_orderkey") % 7 == 0).alias("deliverable"),
        F.lit(None).cast("boolean").alias("valid"), F.when(F.col("o_orderstatus") == "F", "valid").otherwise("risky").alias("status"),
    )
    places_ = _customers(spark, sf_dir).where(F.col("k") % 2 == 0).select(F.upper("name").alias("name"), F.col("district").alias("place"), F.col("k").alias("pos"), F.concat(F.lit(" 080 "), F.col("k")).alias("phone"))
    done = contacts.fill_from_places(contacts.verify_emails(rows, checks), places_)
    return done.select("college_name", "email_verified", "fallback_contact_phone", contacts.run_status().alias("status"))


def resolved_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers resolved from the pages of their sites: a home page, and a contact page that it links to."""
    configure(spark)
    k = F.col("k")
    host = F.concat(F.lower("segment"), k, F.lit(".ac.in"))
    orgs = _customers(spark, sf_dir).select(
        k, host.alias("host"), F.concat(F.initcap("segment"), F.lit(" College "), k).alias("college_name"), "state", "district", _pick(k, vocab.STREAMS).alias("stream"),
        F.concat(F.lit("https://"), F.when(k % 7 == 0, "gone."), host).alias("lost"), F.lit("").alias("affiliation"),
    )
    orgs = orgs.withColumn("website", F.coalesce("lost", F.concat(F.lit("https://www."), "host")))
    home = orgs.select(
        F.concat(F.lit("https://www."), "host").alias("url"),
        F.concat(F.lit('<p>Welcome</p><a href="/contact/">Contact</a> <a href="/library">Books</a> '), F.when(k % 5 == 0, F.concat(F.lit("info@"), "host")).otherwise("")).alias("html"),
    )
    digits = F.lpad((k % 90000).cast("string"), 5, "1")
    told = F.when(k % 2 == 0, F.concat(F.lit("Training and placement cell, tpo@"), "host", F.lit(", call 98450 "), digits)).otherwise(F.concat(F.lit("Write to office@"), "host"))
    contact = orgs.where(k % 3 != 0).select(F.concat(F.lit("https://www."), "host", F.lit("/contact")).alias("url"), F.concat(F.lit("<p>"), told, F.lit(" </p>")).alias("html"))
    none = spark.createDataFrame([], "org_id string, rank int, url string, title string")
    inputs = ResolveInputs(results=none, pages=home.unionByName(contact))
    done = resolve(orgs.drop("host", "lost"), inputs)
    return done.select(
        "k", "placement_email", "fallback_contact_email", "fallback_contact_phone", F.array_join("backup_emails_found", " ").alias("more"), "confidence_score",
        F.size("source_urls").alias("n_pages"), "status", "notes",
    )


# --- payloads ----------------------------------------------------------------

def _hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 2, "0")


def cfemail_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of customers, written with a key of their own on a page, and read again."""
    k = F.col("c_custkey")
    address = F.concat(F.lower("c_mktsegment"), F.lit("+"), k, F.lit("@org.ac.in"))
    key = (k % 256).cast("int")
    codes = F.transform(F.split(address, ""), lambda c: _hex(F.ascii(c).bitwiseXOR(key).cast("bigint")))
    rows = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    rows = rows.select("c_custkey", F.concat(_hex(key.cast("bigint")), F.array_join(codes, "")).alias("coded"))
    coded = F.col("coded")
    page = F.concat(F.lit('<a data-cfemail="'), coded, F.lit('">x</a> <a href="/cdn-cgi/l/email-protection#'), coded, F.lit('"> <i data-cfemail="'), F.substring(coded, 1, 7), F.lit('">'))
    # An inner explode has its array computed once more, by a filter ahead of the exchange.
    found = rows.select("c_custkey", F.explode_outer(emails.emails_obfuscated(page)).alias("email"))
    return found.where(F.col("email").isNotNull())


def _json(name: str, items: list[Column]) -> Column:
    return F.concat(F.lit(f'{{"{name}": ['), F.concat_ws(", ", *items), F.lit("]}"))


def payload_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses and numbers of payloads in the shapes that extractors give."""
    k, word = F.col("c_custkey"), F.col("c_mktsegment")
    mail = _json("emails", [
        F.concat(F.lit('" '), word, k, F.lit('@A.org "')), F.concat(F.lit('{"name": "x", "email": "b'), k, F.lit('@b.org"}')),
        F.concat(F.lit('{"value": "'), word, F.lit('", "address": ""}')), F.lit("null"), F.lit("17"),
    ])
    digits = F.lpad(k.cast("string"), 7, "3")
    calls = _json("phones", [F.concat(F.lit('"98 7'), digits, F.lit('"')), F.concat(F.lit('{"raw": "x", "normalized": "0987'), digits, F.lit('"}')), F.concat(F.lit('{"number": "96'), digits, F.lit('1"}'))])
    found = F.concat(payloads.payload_emails(mail), payloads.payload_phones(calls))
    rows = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    return rows.select("c_custkey", F.posexplode_outer(found).alias("place", "contact")).where(F.col("place").isNotNull())


def table_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with names, as lists and as objects; a table without a column of names gives none."""
    k, word = F.col("c_custkey"), F.initcap("c_mktsegment")
    rows = F.concat(F.lit('["1", " College '), word, F.lit(" "), k, F.lit(' ", "Town '), k % 9, F.lit('"], {"no": "2", "n": "Institute '), k, F.lit('"}, ["3", "abc", "x"]'))
    tables = F.concat(
        F.lit('{"tables": [{"headers": ["No", "'), _pick(k, ("Name of College", "Institution", "Remarks")), F.lit('", "City"], "rows": ['), rows, F.lit(']}, {"headers": ["Fees"], "rows": [["Some College"]]}]}')
    )
    table = spread(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    found = table.select("c_custkey", F.posexplode_outer(payloads.table_rows(tables)).alias("place", "row")).where(F.col("place").isNotNull())
    return found.select("c_custkey", "place", "row.name", "row.district")


QUERIES = {
    f.__name__: f
    for f in (
        contact_files, import_report, streamed_runs, best_first_pages, all_site_pages, page_budget, contact_scores, site_contacts, leading_contacts,
        name_keys, listing_names, names_in_state, seed_merge, seed_sources, channel_yield, staged_match, match_report, snapshot_changes, org_lookup,
        snapshot_restored, seed_cache, marketing_file, district_reference,
        fill_finds, site_scores, chosen_sites, page_classes, page_names, document_cells, admin_page, recent_runs, checked_results,
        resolved_orgs,
        cfemail_recover, payload_contacts, table_seeds,
    )
}


# --- SQL ---------------------------------------------------------------------

_CUSTOMERS = """
with recursive customers as (
  select c_custkey as k, c_name as name, c_mktsegment as segment, n_name as state, r_name as district
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)
"""
_TITLED = "upper(segment[1]) || lower(segment[2:])"
_CONTACTS = _CUSTOMERS + f"""
, cells as (
  select k, k % 3 as kind, 'Collège ' || {_TITLED} || ' ' || (k // 2) as college_name, case when k % 7 <> 0 then state end as state,
    k % 5 <> 0 and k % 3 <> 2 as has_mail, '98' || lpad(k::varchar, 8, '7') as digits, lower(segment) as domain
  from customers
), rows_ as (
  select college_name, state, case when has_mail then 'info' || k || '@' || domain || '.org' end as placement_email,
    case when has_mail then 'second' || k || '@b.org' else '' end as more,
    case when kind > 0 and len(list_distinct(string_split(digits, ''))) > 2 then '+91-' || digits end as placement_phone,
    case when state is null then 'no_state' end as reject
  from cells
)
"""
_GRAPH = f"""
with recursive pages_ as (
  select c_custkey as k, c_custkey % 25 as s, c_custkey // 25 as j from customer
), words as (
  select k, s, j, 'https://www.n' || s || '.example.org' as site, k || '/' || {_chosen("k", _PATH_WORDS)} as path from pages_
), urls as (
  select k, s, j, site, case when k < 25 then site else site || '/' || path end as url,
    case when regexp_matches(lower(path), '({_words(vocab.SKIP_EXTENSIONS)})$') then 0 {_HINT_CASES} else 0 end as priority
  from words
), links as (
  select a.k, a.url as source, i, b.url as target, b.priority, b.k as target_k
  from urls a, range(3) r(i), urls b
  where b.s = a.s and b.j = case i when 0 then 2 * a.j + 1 when 1 then 2 * a.j + 2 else a.j + 3 end and b.priority > 0 and b.k >= 25
), out_links as (
  select source, list({{'rank': -priority, 'i': i, 'url': target}} order by i) as outs from (
    select source, target, any_value(priority) as priority, min(i) as i from links group by source, target
  ) group by source
), homes as (
  select site, url from urls where k < 25 and k in (select n_nationkey from nation)
)
"""
_NONE = "[]::struct(rank bigint, depth bigint, turn bigint, i bigint, url varchar)[]"


def _email_sql() -> str:
    """The score of an address from local, host, domain, source_url and wording."""
    bare = "regexp_replace(local, '[._\\-]', '', 'g')"
    own = "ends_with(host, domain)"
    placed = f"regexp_matches({bare}, '{_words(vocab.PLACEMENT_LOCALS)}')"
    generic = f"(not {placed} and regexp_matches({bare}, '^({_words(vocab.GENERIC_LOCALS)})'))"
    page = f"regexp_matches(lower(source_url), '{'|'.join(vocab.PLACEMENT_URL_HINTS)}')"
    free = f"(not {own} and list_contains({_list(vocab.FREE_MAIL_HOSTS)}, host))"
    junk = f"regexp_matches({bare}, '{_words(vocab.JUNK_LOCALS)}')"
    points = f"case when {placed} then 60 when {generic} then 10 else 20 end + case when {page} then 25 else 0 end + case when wording then 10 else 0 end"
    points += f" + case when {own} then 10 else 0 end - case when {free} then 10 else 0 end"
    reasons = f"1 + {page}::int + wording::int + {own}::int + {free}::int"
    phone = f"15 + case when {page} then 45 else 0 end + case when wording then 25 else 0 end"
    return f"""
      case when kind = 'phone' then least(100, {phone}) when {junk} then 0 else greatest(0, least(100, {points})) end::int as score,
      case when kind = 'phone' then 1 + {page}::int + wording::int when {junk} then 1 else {reasons} end::int as n_reasons"""


_SIGHTED = f"""
with told as (
  select o_orderkey, o_custkey as site, (o_orderkey % 9)::int as page_no, 'org' || o_custkey || '.ac.in' as domain, o_orderstatus = 'F' as wording,
    'https://org' || o_custkey || '.ac.in' || {_chosen("o_orderkey", _PAGE_PATHS)} as source_url, case when o_orderkey % 4 <> 0 then 'email' else 'phone' end as kind,
    {_chosen("(o_orderkey * 7)", _LOCALS)} as local, o_orderkey % 40 as n, o_orderkey % 3 as h, {_chosen("o_orderkey", (*vocab.FREE_MAIL_HOSTS, "else.example"))} as other
  from orders
), hosted as (select *, case h when 0 then domain when 1 then 'mail.' || domain else other end as host from told
), valued as (select *, case kind when 'email' then local || '@' || host else '+91-98' || lpad(n::varchar, 8, '0') end as value from hosted
), scored as (select *, {_email_sql()} from valued
), best as (
  select site, kind, value, max(score) as score, min((page_no, -score, o_orderkey)) as seen from scored group by site, kind, value
), ranked as (
  select *, row_number() over (partition by site, kind order by score desc, seen) as place, count(*) over (partition by site, kind) as n_contacts from best
)
"""


def _replaced(expression: str, steps) -> str:
    for pattern, put in steps:
        expression = f"regexp_replace({expression}, '{pattern}', '{put}', 'g')"
    return expression


def _name_key_sql(name: str) -> str:
    """The match key of a name that has a word besides its suffixes, titles and places."""
    by_word: dict[str, list[str]] = {}
    for short, full in vocab.ABBREVIATIONS.items():
        by_word.setdefault(full, []).append(short)
    words = f"trim(regexp_replace(replace(split_part(strip_accents(lower({name})), ',', 1), '&', ' and '), '[^a-z0-9_]+', ' ', 'g'))"
    steps = [(rf"\b({'|'.join(shorts)})\b", full) for full, shorts in by_word.items()]
    steps += [(rf"\b{phrase}\b", " ") for phrase in vocab.NAME_SUFFIXES]
    steps += [(rf"\b({'|'.join(vocab.NOISE_WORDS)})\b", ""), (r"\s+", " ")]
    bare = f"trim({_replaced(words, steps)})"
    return f"trim({_replaced(bare, [('^and ', ''), (' and$', ''), (' and ', ' ')])})"


_PART_NAME = f"""({_chosen("p_partkey", _PREFIXES)} || case when p_partkey % 2 = 0 then list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')
  else upper(p_name) end || ' ' || p_type || {_chosen("p_partkey", _SUFFIXES)})"""
_TITLED_PART = "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
_SEEDS = _CUSTOMERS + f"""
, every as (
  select k, k // 6 as g, ({_list(vocab.STREAMS)})[(k // 6) % 2 + 1] as stream, 'Group ' || (k // 6) || ' College' as college_name,
    case when k % 5 < 2 then '' when k % 5 = 2 then lower(district) else district end as district, case when k % 5 < 2 then '' else lower(district) end as dkey,
    case when k % 4 = 0 then 'street ' || k else '' end as address, case when k % 3 = 0 then '98' || k else '' end as phone,
    case when k % 7 = 0 then 'https://w' || k else '' end as website, case when k % 2 = 0 then segment else '' end as affiliation, 'https://list/' || (k % 11) as url
  from customers
), seeds as (
  select *, 0 as c, 'maps' as channel from every where k % 6 < 3 union all
  select *, 1, 'directory' from every where k % 6 between 2 and 4 union all
  select *, 2, 'aggregator' from every where k % 6 >= 4
), anchored as (
  select *, first_value(dkey) over (partition by g order by c, k) as anchor from seeds
), placed as (
  select *, case when anchor = '' or dkey = '' then anchor else dkey end as org from anchored
), merged as (
  select g, stream, org, any_value(college_name) as college_name, min((c, k)) as ord,
    coalesce(nullif(arg_min(district, (c, k)), ''), arg_min(district, (c, k)) filter (c = 1 and district <> ''), '') as district,
    {", ".join(f"coalesce(nullif(arg_min({x}, (c, k)), ''), arg_min({x}, (c, k)) filter (c = {i} and {x} <> ''), '') as {x}" for x, i in (("address", 0), ("phone", 0), ("website", 0), ("affiliation", 1)))},
    arg_min(channel, (c, k)) as first_channel, bool_or(c = 1) as in_directory, bool_or(c = 2) as in_aggregator,
    list_sort(list_distinct(list_concat([arg_min(url, (c, k))], coalesce(list(url) filter (c > 0), [])))) as urls
  from placed group by g, stream, org
), sourced as (
  select *, first_channel || case when in_directory and first_channel <> 'directory' then '+directory' else '' end
    || case when in_aggregator and first_channel <> 'aggregator' then '+aggregator' else '' end as source from merged
)
"""
_MATCH = _CUSTOMERS + f"""
, orgs as (
  select k as pos, case when k % 17 = 0 then '' else lower(replace(name, '#', ' ')) end as name, lower(state) as state, lower({_chosen("k", vocab.STREAMS)}) as stream from customers
), sighted as (
  select o_orderkey as row_no, lower(replace(name, '#', ' ')) as name, case when k % 3 = 0 then 'elsewhere' else lower(state) end as state,
    case when k % 2 = 0 then lower({_chosen("k", vocab.STREAMS)}) else 'other' end as stream,
    unnest(['98' || lpad((o_orderkey % 1000 * 37)::varchar, 8, '0'), '97' || lpad((o_orderkey % 100)::varchar, 8, '0')]) as digits, unnest([0, 1]) as i
  from orders join customers on o_custkey = k where k % 5 <> 0 and o_orderkey % 6 <> 0
), numbers as (select * from sighted where len(list_distinct(string_split(digits, ''))) > 2
), exact as (
  select name, state, stream, digits, min((row_no, i)) as seen from numbers group by name, state, stream, digits
), near as (
  select name, state, digits, min((row_no, i)) as seen from numbers group by name, state, digits
), cells as (
  select name, state, stream, count(*) as n, string_agg('+91-' || digits, ', ' order by seen) as cell, '+91-' || arg_min(digits, seen) as first_phone from exact group by name, state, stream
), near_cells as (
  select name, state, count(*) as n, string_agg('+91-' || digits, ', ' order by seen) as cell, '+91-' || arg_min(digits, seen) as first_phone from near group by name, state
), staged as (
  select o.pos, o.name, case when e.n is not null then 'name_state_stream' when c.n is not null then 'name_state' else 'unmatched' end as match_stage,
    coalesce(e.first_phone, c.first_phone) as first_phone, coalesce(e.n, c.n, 0) as n_phones, coalesce(e.cell, c.cell, '') as all_phones_found
  from orgs o left join cells e on o.name = e.name and o.state = e.state and o.stream = e.stream left join near_cells c on o.name = c.name and o.state = c.state
)
"""

_SITES = _CUSTOMERS + f"""
, found as (
  select k as org_id, o_orderkey as rank, lower(segment) as word, lower(segment)[1] || 'it' as short, o_orderkey % 50 as n, o_orderkey % 8 as h,
    {_chosen("(o_orderkey // 8)", _RESULT_PATHS)} as path, case o_orderkey % 3 when 1 then lower(segment) else '' end as titled
  from orders join customers on o_custkey = k
), hosted as (
  select *, ([word || '.ac.in', 'www.' || short || '.edu.in', short || '-' || n || '.org', 'x' || short || '.com', 'www.collegedunia.com', 'admission' || n || '.in', word || '-list.net', 'p' || n || '.example'])[h + 1] as host
  from found
), named as (
  select *, regexp_replace(host, '^www\\.', '') as domain, regexp_replace(split_part(regexp_replace(host, '^www\\.', ''), '.', 1), '[^a-z]', '', 'g') as label from hosted
), signs as (
  select *, contains(label, word) as by_name, not contains(label, word) and contains(label, short) as inside, titled = word as by_title,
    regexp_matches(domain, '({_words(vocab.EDU_TLDS)})$') as edu from named
), scored as (
  select *, case when regexp_matches(domain, '(^|\\.)({_words(vocab.BLOCKED_DOMAINS)})$') then 0 else
    greatest(0, least(case when by_name or by_title or inside and starts_with(label, short) then 100 else {vocab.MIN_SITE_SCORE - 1} end,
      case when regexp_matches(domain, '{_words(vocab.AGGREGATOR_DOMAIN_WORDS)}') then -15 else 0 end + case when edu then 40 when regexp_matches(domain, '({_words(vocab.WEAK_TLDS)})$') then 10 else 0 end
      + case when by_name then 35 when inside and starts_with(label, short) then 30 when inside then 5 else 0 end
      + case when regexp_matches(path, '(?i){vocab.LISTING_PATH}') then -20 else 0 end + case when path in ('', '/') then 10 else 0 end + case when by_title then 15 else 0 end)) end::int as score
  from signs
)
"""
_SPACES = r"[\s\x0B\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

ORACLES = {
    "site_scores": _SITES + "select org_id, rank, domain, score from scored",
    "chosen_sites": _SITES + f"""
        select org_id, 'https://' || host || path as url, score from (select *, row_number() over (partition by org_id order by score desc, rank) as place from scored)
        where place = 1 and score >= {vocab.MIN_SITE_SCORE}""",
    "page_classes": f"""
        with u as (select page_id, lower(url) as url from pages), d as (select *, regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), '^www\\.', '') as domain from u)
        select page_id, domain, regexp_matches(domain, '(^|\\.)({_words(vocab.BLOCKED_DOMAINS)})$') as blocked,
          not regexp_matches(url, '{_words(vocab.NON_AUTHORITATIVE)}') and (regexp_matches(url, '{_words(vocab.AUTHORITATIVE_DOMAINS)}')
            or regexp_matches(url, '{_words(vocab.OFFICIAL_TLDS)}') and regexp_matches(url, '{_words(vocab.LISTING_HINTS)}')) as authoritative,
          regexp_matches(url, '{_words(vocab.AGGREGATOR_HOSTS)}') as aggregator
        from d""",
    "page_names": f"""
        with raw as (select page_id, unnest(regexp_extract_all(html, '{vocab.NAME_MARKUP}', 1)) as f, generate_subscripts(regexp_extract_all(html, '{vocab.NAME_MARKUP}', 1), 1) as pos from pages
        ), plain as (
          select page_id, pos, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(f, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&nbsp;', ' '), '&#039;', chr(39)), '&quot;', '"'), '{_SPACES}', ' ', 'g')) as name from raw
        )
        select page_id, (row_number() over (partition by page_id order by pos) - 1)::int as place, name from plain where length(name) between 8 and 120""",
    "document_cells": f"""
        with cells as (
          select doc_id, line, trim(regexp_replace(line, '{_SPACES}', ' ', 'g')) as cell from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        ), kept as (select * from cells where not list_contains({_list(vocab.PLACEHOLDERS)}, lower(cell)) and not list_contains({_list(vocab.READER_NULLS)}, line))
        select d.doc_id, coalesce(n, 0)::int as n_cells, coalesce(m, 0)::int as n_chars from documents d left join (select doc_id, count(*) as n, sum(length(cell)) as m from kept group by doc_id) using (doc_id)""",
    "admin_page": f"""
        select c_name as college_name, n_name as state, {_chosen("c_custkey", vocab.STREAMS)} as stream from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        order by n_name desc, lower(c_name), r_name, stream limit 60 offset 30""",
    "recent_runs": "select user_id::varchar as run_id, 0::bigint as processed, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started from events group by 1 order by started desc, run_id desc limit 10",
    "checked_results": _CUSTOMERS + """
        , r as (
          select c_custkey as k, c_name, case c_custkey % 3 when 0 then 'placement' || c_custkey || '@example.org' when 1 then '' end as email, c_acctbal > 0 as called,
            case when c_custkey % 4 = 0 then 'info' || c_custkey || '@example.org' end as other, case when c_custkey % 5 = 0 then '97' || lpad(c_custkey::varchar, 8, '0') else '' end as backup
          from customer
        ), filled as (select *, case when not called and backup = '' and k % 2 = 0 then '080 ' || k else backup end as phone from r
        ), good as (select 'placement' || o_custkey || '@example.org' as email from orders where o_orderkey % 7 = 0 or o_orderstatus = 'F' group by 1)
        select c_name as college_name, coalesce(email, other) in (select email from good) and coalesce(email, other) is not null as email_verified, phone as fallback_contact_phone,
          case when email <> '' and called then 'Verified' when email <> '' or called or other <> '' or phone <> '' then 'Needs Follow-up' else 'Failed' end as status
        from filled""",
    "contact_files": _CONTACTS + "select * from rows_",
    "import_report": _CONTACTS + """
        , taken as (select *, placement_email is not null and placement_phone is not null as complete from rows_ where reject is null)
        , keyed as (select college_name, count(*) as copies, count(distinct state) as states from taken group by college_name)
        select 'state' as scope, state as item, count(*) as n, count(*) filter (complete) as complete from taken group by state
        union all select 'stream', 'Engineering', count(*), count(*) filter (complete) from taken
        union all select 'verdict', coalesce(reject, 'accepted'), count(*), count(*) filter (reject is null and placement_email is not null and placement_phone is not null) from rows_ group by reject
        union all select 'all', null, count(*), count(*) filter (reject is null and placement_email is not null and placement_phone is not null) from rows_
        union all select 'file', 'records', count(*), null from keyed
        union all select 'file', 'duplicates', sum(copies - 1)::bigint, null from keyed
        union all select 'file', 'merged_states', count(*) filter (states > 1), null from keyed""",
    "streamed_runs": """
        select 'events' as run_id, 'S' as state, 'completed' as status, count(*) as processed, count(*) filter (event_type <> 'error') as succeeded,
          count(*) filter (event_type = 'error') as failed from events""",
    "best_first_pages": _GRAPH + f"""
        , walk as (
          select site, 1::bigint as page_no, url as page, 0::bigint as depth, [url] as visited, {_NONE} as frontier from homes
          union all
          select site, page_no + 1, best.url, best.depth, list_append(visited, best.url), list_filter(grown, lambda x: x.url <> best.url)
          from (
            select *, list_min(grown) as best from (
              select w.site, page_no, visited, list_filter(list_concat(frontier, case when depth < 4 then coalesce(list_transform(outs,
                  lambda o: {{'rank': o.rank::bigint, 'depth': depth + 1, 'turn': page_no, 'i': o.i::bigint, 'url': o.url}}), {_NONE}) else {_NONE} end),
                lambda x: not list_contains(visited, x.url)) as grown
              from walk w left join out_links l on l.source = w.page where page_no < 10
            )
          ) where best is not null
        )
        select site, page_no::int as page_no, page as url from walk""",
    "all_site_pages": _GRAPH + f"""
        , reached as (
          select site, 0 as depth, [site] as known, [{{'rank': 0::bigint, 'turn': 1::bigint, 'i': 0::bigint, 'url': url}}] as level from homes
          union all
          select site, depth + 1, list_concat(known, list_transform(fresh, lambda x: x.url)), fresh
          from (
            select r.site, any_value(depth) as depth, any_value(known) as known, list_transform(list_sort(list({{'rank': p.rank, 'parent': p.turn, 'i': p.i, 'url': p.url}})), lambda x, n: {{'rank': x.rank, 'turn': n::bigint, 'i': x.i, 'url': x.url}}) as fresh
            from reached r, lateral (
              select min({{'rank': o.rank::bigint, 'turn': x.turn, 'i': o.i::bigint, 'url': o.url}}) as p
              from (select unnest(r.level) as x), out_links l, lateral (select unnest(l.outs) as o)
              where l.source = x.url and not list_contains(r.known, o.url) group by o.url
            ) group by r.site
          ) where len(fresh) > 0
        ), told as (select site, depth, unnest(level) as x from reached)
        select site, (row_number() over (partition by site order by depth, x.turn))::int as page_no, x.url as url from told""",
    "page_budget": _GRAPH + f"""
        , listed as (
          select p.site, u.url, u.priority, min(p.k) as pos, u.k as there
          from urls p join (
            select k, case when k < 25 then site else site || '/' || path end as url,
              case when k < 25 or regexp_matches(lower(path), '({_words(vocab.SKIP_EXTENSIONS)})$') then 0 {_HINT_CASES} else 0 end as priority
            from (select k, 'https://www.n' || (k % 25) || '.example.org' as site, k || '/' || {_chosen("k", _PATH_WORDS)} as path from range(1000000) r(k) where k <= (select max(c_custkey) + 50 from customer))
          ) u on u.k = p.k + 25 * (p.k % 3) where p.k % 2 = 1 group by all
        ), tried as (
          select site, url, 1 as tier, priority, pos from listed
          union all
          select h.site, h.site, 0, 0, 0 from homes h where h.site not in (select url from listed)
          union all
          select h.site, h.site || g, 2, 0, i from homes h, (select unnest({_list(vocab.GUESS_PATHS)}) as g, unnest(range({len(vocab.GUESS_PATHS)})) as i)
        ), numbered as (
          select *, row_number() over (partition by site order by tier, priority desc, pos, url) as attempt from tried
        ), read as (
          select *, row_number() over (partition by site order by attempt) as page_no from numbered where attempt <= 10 and url in (select url from urls)
        )
        select site, page_no::int as page_no, url from read where page_no <= 4""",
    "contact_scores": _SIGHTED + "select o_orderkey::int as o_orderkey, kind, value, score, n_reasons from scored",
    "leading_contacts": _SIGHTED + "select site, kind, value, score, n_contacts from ranked where place = 1",
    "site_contacts": _SIGHTED + f"""
        , lists as (
          select site, coalesce(list(value order by place) filter (kind = 'email'), []) as emails, max(score) filter (kind = 'email') as email_score,
            coalesce(list(value order by place) filter (kind = 'phone'), []) as phones, max(score) filter (kind = 'phone') as phone_score
          from ranked group by site
        ), judged as (
          select *, coalesce(email_score >= {vocab.PLACEMENT_SCORE}, false) as e, coalesce(phone_score >= {vocab.PLACEMENT_SCORE}, false) as p from lists
        )
        select site, case when e then emails[1] end as placement_email, case when not e then emails[1] end as fallback_contact_email,
          array_to_string(case when e then emails[2:] else emails end, ' ') as backup_emails,
          case when p then phones[1] end as placement_phone, case when not p then phones[1] end as fallback_contact_phone,
          array_to_string(case when p then phones[2:] else phones end, ' ') as backup_phones, case when e then email_score end as placement_score
        from judged""",
    "name_keys": f"select p_partkey, {_name_key_sql(_PART_NAME)} as name_key from part",
    "listing_names": f"""
        with shown as (
          select p_partkey, regexp_replace(trim({_chosen("p_partkey", _BADGES)} || {_TITLED_PART} || {_chosen("p_partkey", _LISTING_ENDS)}), '\\s+', ' ', 'g') as n from part
        ), bare as (
          select p_partkey, trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(regexp_replace(n, '^[|:,–—-]+', ''), '(?i){vocab.BADGE_PREFIX}', '')),
            '(?i){vocab.LISTING_NOISE}', '')), '^[0-9]+[.)]\\s*', ''), '\\s*\\([^)]*\\)\\s*$', '')) as n from shown
        )
        select p_partkey, case when length(n) >= 8 and regexp_matches(n, '(?i){vocab.INSTITUTION_WORDS}') and not regexp_matches(n, '(?i){"|".join(f"({p})" for p in vocab.CATEGORY_PATTERNS)}') then n end as name
        from bare""",
    "names_in_state": _CUSTOMERS + f"""
        , named as (
          select k, lower({_TITLED} || ' college ' || case k % 4 when 0 then state when 1 then district when 2 then {_chosen("k", (*vocab.FOREIGN_MARKERS, *vocab.OUT_OF_SCOPE_PLACES))} else 'nowhere' end) as n,
            {_chosen("k", ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))} as s from customers
        ), places as (
          select r_name as s, lower(n_name) as p, length(n_name) > 6 as telling from nation join region on n_regionkey = r_regionkey union all select r_name, lower(r_name), true from region
        ), found as (
          select k, bool_or(q.s = named.s) as own, bool_or(q.s <> named.s and telling) as other from named join places q on contains(n, p) group by k
        )
        select named.k, case when regexp_matches(n, '\\b({"|".join((*vocab.FOREIGN_MARKERS, *vocab.OUT_OF_SCOPE_PLACES))})\\b') then false when own then true else not coalesce(other, false) end as in_state
        from named left join found on named.k = found.k""",
    "seed_merge": _SEEDS + """
        select stream, college_name, district, address, phone, website, affiliation, source, array_to_string(urls, ' ') as urls,
          row_number() over (partition by stream order by ord) as pos from sourced""",
    "seed_sources": _SEEDS + "select source, count(*) as n from sourced group by source",
    "channel_yield": _SEEDS + """
        select 'S' as state, stream, channel, count(*) as found from seeds group by stream, channel
        union all select 'S', stream, 'merged', count(*) from sourced group by stream""",
    "staged_match": _MATCH + "select pos, match_stage, first_phone, n_phones, all_phones_found from staged",
    "match_report": _MATCH + """
        , judged as (
          select case when match_stage <> 'unmatched' then match_stage when name = '' then 'no_name' when name in (select name from numbers) then 'name' else 'unmatched' end as match_stage from staged
        )
        select match_stage, count(*) as n from judged group by match_stage
        union all select 'rows', count(*) from judged
        union all select 'matched', count(*) from judged where match_stage not in ('unmatched', 'no_name')
        union all select 'with_phones', count(distinct row_no) from numbers""",
    "snapshot_changes": """
        with k as (select c_custkey as n, lower(c_name) as normalized_name, (['Verified', 'Needs Follow-up', 'Failed'])[c_custkey % 3 + 1] <> 'Failed' and c_custkey % 4 = 0 as newer, c_custkey % 6 = 0 as gone from customer)
        select normalized_name, case when n % 10 = 1 then 'store' when n % 10 = 0 then 'snapshot' else 'both' end as found,
          case when n % 10 < 2 then '' else concat_ws(' ', case when gone then 'website' end, case when newer then 'status' end) end as changed
        from k where n % 10 < 2 or newer or gone""",
    "snapshot_restored": f"""
        select c_name as college_name, r_name as district, n_name as state, {_chosen("c_custkey", vocab.STREAMS)} as stream, 'https://org' || c_custkey || '.example.org' as website,
          case c_custkey % 3 when 0 then 'placement' || c_custkey || '@example.org' else '' end as placement_email,
          case when c_custkey % 6 = 0 then 'a' || c_custkey || '@example.org b@example.org' else '' end as more, 10 as confidence_score, true as email_verified, '2024-01-01' as day,
          {_chosen("c_custkey", vocab.STATUSES)} as status, '{vocab.OUTREACH[1]}' as outreach_status
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "seed_cache": _SEEDS + f"""
        select college_name, district, phone, source, pos from (select *, row_number() over (partition by stream order by ord) as pos from sourced) where stream = '{vocab.STREAMS[1]}'""",
    "marketing_file": _ROSTER + """select college_name as "College Name", state as "State", stream as "Stream", email as "Email", phone as "Phone" from roster
        where email is not null and phone is not null and state = 'NATION_7'""",
    "district_reference": "select r_name as state, n_name as district from nation join region on n_regionkey = r_regionkey",
    "org_lookup": f"""
        select c_name as college_name, lower(c_name) as normalized_name, r_name as district, {_chosen("c_custkey", vocab.STREAMS)} as stream,
          'https://org' || c_custkey || '.example.org' as website, {_chosen("c_custkey", vocab.STATUSES)} as status
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_name in (select replace(s_name, 'Supplier', 'Customer') from supplier)""",
    "fill_finds": _CUSTOMERS + f"""
        , orders_ as (select o_custkey as k, max(o_orderkey) as o from orders group by 1
        ), shown as (
          select c.k, c.name, lower(segment) as word, o, i, (o + i) % 2 = 0 as has_mail, i = o % 5 as has_call
          from customers c join orders_ using (k), range({len(vocab.FILL_PATHS)}) r(i) where (o + i) % 3 <> 0
        ), sites as (
          select k, name, word, any_value(o) % 4 <> 0 as named, min(i) as first, min(i) filter (has_mail) as mail_from, min(i) filter (has_call) as call_from from shown group by k, name, word
        ), used as (
          select s.*, h.i, h.has_mail, h.has_call from sites s join shown h using (k) where h.i <= case when mail_from is not null and call_from is not null then greatest(mail_from, call_from) else {len(vocab.FILL_PATHS)} end
        ), told as (
          select name, word, k, bool_and(named or coalesce(mail_from = first, false)) as owned, count(*) as pages, bool_or(has_mail) as mail, bool_or(has_call) as call from used group by name, word, k
        )
        select name as normalized_name, owned as site_verified, (case when owned then pages else 1 end)::int as pages_tried,
          case when owned and mail then 'office@' || word || k || '.ac.in' end as email, case when owned and mail then 'tpo' || k || '@gmail.com' else '' end as more,
          case when owned and call then '+91-98450' || lpad((k % 90000)::varchar, 5, '1') end as phone
        from told""",
    "resolved_orgs": _CUSTOMERS + """
        , r as (
          select k, lower(segment) || k || '.ac.in' as host, k % 7 = 0 as gone, k % 3 <> 0 as reached, k % 2 = 0 as placed, k % 5 = 0 as greeted, lpad((k % 90000)::varchar, 5, '1') as digits from customers
        ), found as (
          select *, case when gone then null when reached and placed then 'tpo@' || host end as placement_email,
            case when gone or reached and placed then null when greeted then 'info@' || host when reached then 'office@' || host end as fallback,
            case when not gone and reached and placed then '+91-98450' || digits end as phone, case when gone then 0 when reached then 2 else 1 end as pages from r
        )
        select k, placement_email, fallback as fallback_contact_email, phone as fallback_contact_phone,
          coalesce(case when gone then '' when reached and placed then case when greeted then 'info@' || host else '' end
            else concat_ws(' ', case when greeted then 'info@' || host end, case when reached then 'office@' || host end) end, '') as more,
          case when placement_email is not null then 80 else 0 end as confidence_score, pages as n_pages,
          case when placement_email is not null or fallback is not null then 'Needs Follow-up' else 'Failed' end as status,
          case when gone then 'site discovered but no page could be fetched'
            else 'crawled ' || pages || ' pages' || case when placement_email is null and fallback is null then '; no contact details found anywhere' else '' end end as notes
        from found""",
    "cfemail_recover": "select c_custkey, lower(c_mktsegment) || '+' || c_custkey || '@org.ac.in' as email from customer",
    "payload_contacts": """
        with raw as (
          select c_custkey, ['"' || lower(c_mktsegment) || c_custkey || '@a.org"', '{"name": "x", "email": "b' || c_custkey || '@b.org"}', '{"value": "' || c_mktsegment || '", "address": ""}']::json[] as mails,
            ['"987' || lpad(c_custkey::varchar, 7, '3') || '"', '{"raw": "x", "normalized": "987' || lpad(c_custkey::varchar, 7, '3') || '"}', '{"number": "96' || lpad(c_custkey::varchar, 7, '3') || '1"}']::json[] as calls
          from customer
        ), mail as (
          select c_custkey, list_filter(list_transform(mails, lambda m: case when json_type(m) = 'VARCHAR' then m->>'$' else coalesce(nullif(m->>'$.address', ''), m->>'$.email', m->>'$.value') end), lambda v: contains(v, '@')) as found
          from raw
        ), call as (
          select c_custkey, list_filter(list_distinct(list_transform(calls, lambda m: case when json_type(m) = 'VARCHAR' then m->>'$' else coalesce(m->>'$.normalized', m->>'$.number') end)),
            lambda v: len(list_distinct(string_split(v, ''))) > 2) as found from raw
        ), ordered as (
          select c_custkey, list_concat(m.found, list_transform(list_reverse_sort(c.found), lambda v: '+91-' || v)) as found from mail m join call c using (c_custkey)
        )
        select c_custkey, (unnest(range(len(found))))::int as place, unnest(found) as contact from ordered""",
    "table_seeds": """
        with t as (
          select c_custkey as k, c_custkey % 3 as head, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as word from customer
        ), r as (
          select k, head, unnest(['College ' || word || ' ' || k, 'Institute ' || k, 'abc']) as name, unnest(['Town ' || (k % 9), '', 'x']) as district, unnest([0, 1, 2]) as place from t
        )
        select k as c_custkey, place::int as place, name, district from r where head < 2 and length(name) >= 6""",
}
