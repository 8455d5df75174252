"""Seeds through batch, store and growth on a toy corpus; the store's layout; places and listings."""

import pytest
from pyspark.sql import functions as F

from rosterlake import registered_jobs, schema
from rosterlake.functions import urls
from rosterlake.operators import channels, crawl
from rosterlake.operators.places import plausibly_in_state
from rosterlake.plans import grow as jobs
from rosterlake.plans.fill import fill_report, fill_store
from rosterlake.plans.resolve import ResolveInputs, resolve
from rosterlake.session import Bucketed
from rosterlake.sources.reference import read_districts
from rosterlake.sources.store import RosterStore


def _seeds(spark):
    rows = [(f"{word} College of Engineering", "Karnataka", "Engineering", place, "", "", f"https://www.{word.lower()}.ac.in", "", "directory", ["https://list.example.org"])
            for word, place in (("Lakeview", "Mysuru"), ("Hilltop", "Udupi"), ("Riverbank", "Hassan"))]
    return spark.createDataFrame(rows, schema.SEED_SCHEMA).withColumn("pos", F.length("college_name").cast("bigint"))


def _inputs(spark):
    results = spark.createDataFrame([], "org_id string, rank int, url string, title string")
    pages = spark.createDataFrame(
        [(f"https://www.{w}.ac.in", f"<html><body>Placement cell: placement@{w}.ac.in, phone 98450 1234{i}</body></html>") for i, w in enumerate(("lakeview", "hilltop"))],
        "url string, html string",
    )
    return ResolveInputs(results=results, pages=pages)


def test_seeds_to_batch_to_store_to_growth(spark, tmp_path):
    store, inputs, ledger = RosterStore(spark, f"{tmp_path}/store", 4), _inputs(spark), f"{tmp_path}/ledger"
    first = jobs.run_batch(store, _seeds(spark).where("district = 'Mysuru'"), inputs, "Karnataka", "Engineering", run_id="r1", ledger_path=ledger)
    assert [(r.placement_email, r.source_urls) for r in first.collect()] == [("placement@lakeview.ac.in", ["https://www.lakeview.ac.in"])]
    grown = jobs.grow(store, _seeds(spark), inputs, target=2)
    assert grown.candidates.count() == 2
    stored = {r.district: r for r in store.read().collect()}
    assert stored["mysuru"].placement_email == "placement@lakeview.ac.in" and stored["udupi"].placement_email == "placement@hilltop.ac.in"
    again = resolve(store.read(), inputs)
    assert again.count() == store.read().count()
    skipped = jobs.run_batch(store, _seeds(spark), inputs, "Karnataka", "Engineering", run_id="r2", ledger_path=ledger, skip_resolved=True)
    verified = {r.district for r in stored.values() if r.status == "Verified"}
    assert skipped.count() == 3 - len(verified & {"mysuru", "udupi", "hassan"})


def test_fills_can_be_read_after_the_write(spark, tmp_path):
    store = RosterStore(spark, f"{tmp_path}/store", 4)
    bare = ResolveInputs(results=_inputs(spark).results, pages=_inputs(spark).pages.where("false"))
    jobs.run_batch(store, _seeds(spark), bare, "Karnataka", "Engineering", run_id="r", ledger_path=f"{tmp_path}/ledger")
    fills = fill_store(store, _inputs(spark).pages)
    assert fill_report(store.read(), fills).first()["targets"] == 3


def test_a_store_keeps_its_number_of_buckets(spark, tmp_path):
    RosterStore(spark, f"{tmp_path}/store", 4)
    assert RosterStore(spark, f"{tmp_path}/store").buckets == 4
    with pytest.raises(ValueError):
        RosterStore(spark, f"{tmp_path}/store", 8)


def test_places(spark):
    reference = spark.createDataFrame([("Kerala", "Palakkad"), ("Karnataka", "Mangaluru")], "state string, district string")
    names = spark.createDataFrame([("Mangaluru Institute", "Kerala"), ("Palakkad Institute", "Kerala"), ("Mangaluru Hall", None), (None, "Kerala")], "college_name string, state string")
    got = {(r.college_name, r.state): r.in_state for r in plausibly_in_state(names, reference).collect()}
    assert got == {("Mangaluru Institute", "Kerala"): False, ("Palakkad Institute", "Kerala"): True, ("Mangaluru Hall", None): True, (None, "Kerala"): None}


def test_places_beyond_the_bound_of_a_list(spark):
    """Both ways of searching agree, on places inside words, nested places and short ones."""
    reference = spark.createDataFrame([("Kerala", "Palakkad"), ("Kerala", "Go"), ("Karnataka", "Mangaluru"), ("Karnataka", "Uttara Kannada"), ("Goa", "North Goa"), ("Goa", "")], "state string, district string")
    words = ["mangaluru", "palakkad", "north goa", "uttara kannada", "kerala", "gokarna", "harvard", "pune", "hall"]
    names = spark.createDataFrame([(f"{a} College {b}", s) for a in words for b in words for s in ("Kerala", "Goa", "Karnataka", None)] + [(None, "Goa"), ("", "Goa")], "college_name string, state string")
    listed, joined = ({(r.college_name, r.state): r.in_state for r in plausibly_in_state(names, reference, most_places=n).collect()} for n in (1000, 0))
    assert listed == joined and set(listed.values()) == {True, False, None}


def test_the_reference_is_read_without_a_view(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"_note": ["x"], "Goa": ["North Goa", "South Goa"], "Kerala": []}')
    assert sorted(tuple(r) for r in read_districts(spark, f"{tmp_path}/d.json").collect()) == [("Goa", "North Goa"), ("Goa", "South Goa")]
    assert not spark.catalog.listTables() or all(not t.isTemporary for t in spark.catalog.listTables())


def test_all_listing_pages_unless_a_number_is_given(spark):
    rows = [("S", "BCA", i % 2, i, f"https://www.shiksha.com/{i}") for i in range(9)]
    results = spark.createDataFrame(rows, "state string, stream string, query_no int, rank int, url string")
    every = {r.url: r.page_no for r in channels.listing_pages(results, "aggregator").collect()}
    assert sorted(every.values()) == list(range(1, 10)) and every["https://www.shiksha.com/0"] == 1
    few = {r.url: r.page_no for r in channels.listing_pages(results, "aggregator", 2).collect()}
    assert few == {u: n for u, n in every.items() if n <= 2} and channels.listing_pages(results, "aggregator", 0).count() == 0


def test_all_pages_of_a_site_are_read(spark):
    base = {w: f"https://www.{w}.ac.in" for w in ("lakeview", "hilltop")}
    link = lambda n: f"<a href='/contact/{n}'>next</a>"
    chain = [(base["lakeview"], f"<html><body>{link(1)}</body></html>")]
    chain += [(f"{base['lakeview']}/contact/{i}", f"<html><body>{link(i + 1)} {'placement@lakeview.ac.in' if i == 4 else 'x'}</body></html>") for i in range(1, 5)]
    listed = [(f"{base['hilltop']}/p{i:02d}", f"<html><body>{'placement@hilltop.ac.in' if i == 29 else 'x'}</body></html>") for i in range(30)]
    pages = spark.createDataFrame([*chain, (base["hilltop"], "<html><body>x</body></html>"), *listed], "url string, html string")
    urls = spark.createDataFrame([(base["hilltop"], u, i) for i, (u, _) in enumerate(listed)], "site string, url string, pos int")
    inputs = ResolveInputs(results=_inputs(spark).results, pages=pages, site_urls=urls)
    got = {r.website: r for r in resolve(_seeds(spark), inputs).collect()}
    for word, count in (("lakeview", 5), ("hilltop", 31)):
        assert len(got[base[word]].source_urls) == count
        assert got[base[word]].placement_email == f"placement@{word}.ac.in"
    assert got[base["lakeview"]].source_urls == [u for u, _ in chain]


def _chain(spark, n):
    """A site whose pages each link to the next two; every third page doesn't exist."""
    url = lambda i: "https://www.a.org" if i == 0 else f"https://www.a.org/contact/{i}"
    index = spark.createDataFrame([(url(i), [f"/contact/{i + 1}", f"/contact/{i + 2}", "/library"]) for i in range(n) if i % 3 != 2], "url_key string, hrefs array<string>")
    return spark.createDataFrame([(url(0),)], "site string"), index, url


def test_best_first_rounds_move_only_what_they_find(spark, monkeypatch):
    """Neither the index nor the frontier passes an exchange within a round."""
    plans, keep = [], Bucketed.keep

    def spy(self, df, name, *keys, **options):
        if name == "state":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name, *keys, **options)

    monkeypatch.setattr(Bucketed, "keep", spy)
    sites, index, url = _chain(spark, 12)
    got = crawl.best_first_pages(sites, index, max_pages=6, max_depth=None).orderBy("page_no").collect()
    assert [r.url for r in got] == [url(i) for i in (0, 1, 3, 4, 6, 7)]
    scan = lambda lines, at: next(x for x in lines[at + 1 :] if "FileScan" in x or "Exchange" in x)
    lines = plans[-1].splitlines()
    frontier = next(i for i, x in enumerate(lines) if x.strip(" +-:") == "Union")
    assert "Bucketed: true" in lines[frontier + 1] and "Exchange" not in "".join(lines[:frontier])
    assert all("Bucketed: true" in x for x in lines if "FileScan" in x) and scan(lines, frontier)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kept_")]


def test_rows_of_one_file_are_dealt_to_all_tasks(spark, tmp_path):
    """Costly expressions on customers run in as many tasks as a shuffle has, however few files there are."""
    rows = spark.createDataFrame([(k, "HOUSE") for k in range(400)], "c_custkey bigint, c_mktsegment string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for query in (registered_jobs.cfemail_recover, registered_jobs.payload_contacts, registered_jobs.table_seeds):
        found = query(spark, str(tmp_path))
        assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        below = found._jdf.queryExecution().optimizedPlan().toString().partition("Repartition ")[2]
        assert below and "c_custkey" in below and not any(x in below for x in ("Generate", "size(", "concat"))
    assert {(r.c_custkey, r.email) for r in registered_jobs.cfemail_recover(spark, str(tmp_path)).collect()} == {(k, f"house+{k}@org.ac.in") for k in range(400)}


def test_levels_meet_the_index_once_and_number_pages_like_a_plain_walk(spark, monkeypatch):
    """Copies of pages with other links, pages without links or address, sites that share pages."""
    plans, keep = [], Bucketed.keep

    def spy(self, df, name, *keys, **options):
        if name == "new":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(self, df, name, *keys, **options)

    monkeypatch.setattr(Bucketed, "keep", spy)
    hosts, words = ("https://www.a.org", "http://a.org", "https://b.org"), ("contact", "about", "placement", "library", "tpo")
    path = lambda n: f"/{words[n % 5]}/{n}"
    rows = [(hosts[0], ["/contact/0", "/contact/5/", "https://a.org/tpo/4"]), (hosts[2], ["about/1", "/contact/5", "/contact/5/"]), (None, ["/contact/0"]), (hosts[0] + path(0), None)]
    for n in range(60):
        for host in (hosts[0], "https://a.org", hosts[2]) if n % 7 else hosts:
            rows += [(host + path(n), [path(j) + "/" * (j % 3) for j in (2 * n + 1, n + 3, 2 * n + 2, n // 2)])] * (1 + n % 2) + [(host + path(n), [path(n + 5), host + path(n + 9)])] * (n % 4 == 0)
    index = spark.createDataFrame(rows, "url_key string, hrefs array<string>")
    sites = spark.createDataFrame([(h,) for h in (*hosts, "https://gone.org", None)], "site string")
    got = sorted((r.site, r.page_no, r.url_key, r.url) for r in crawl.choose_pages(sites, index).collect())

    links = {
        (r.site, r.url_key, tuple(r.hrefs)): list(zip(r.found, r.priority))
        for r in sites.join(index, F.lit(True)).where("site is not null and url_key is not null and hrefs is not null")
        .withColumn("found", urls.resolve_on_site(F.col("hrefs"), F.col("site"))).withColumn("priority", F.transform("found", urls.link_priority)).collect()
    }
    there, want = {u for u, _ in rows}, []
    for site in hosts:
        level = [(site, site)] if site in there else []
        walked = list(level)
        while level:
            found = {}
            for turn, (page, _) in enumerate(level):
                for key, out in links.items():
                    for i, (u, p) in enumerate(out if key[:2] == (site, page) else ()):
                        to = u.rstrip("/")
                        if p > 0 and to in there and to not in {k for k, _ in walked}:
                            found[to] = min(found.get(to, (0,)), (-p, turn, i, u))
            level = [(k, v[3]) for k, v in sorted(found.items(), key=lambda x: (*x[1][:3], x[0]))]
            walked += level
        want += [(site, n, k, u) for n, (k, u) in enumerate(walked, 1)]
    assert got == sorted(want) and len(want) > 60
    assert len(plans) > 3 and all(p.count("ReadSchema: struct<url_key:string,lists:") == 1 for p in plans)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kept_")]
