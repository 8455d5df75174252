"""URLs, links, markup, scores: example tables."""

from urllib.parse import urldefrag, urljoin, urlparse

from pyspark.sql import functions as F

from rosterlake import vocab
from rosterlake.functions import html, score, urls
from rosterlake.operators import sites

BASE = "https://bmsce.ac.in/"


def links(column_of, page, base=BASE):
    return column_of([page], lambda c: urls.page_links(c, F.lit(base)))[0]


def test_links(column_of):
    page = """
      <a href="/placement">p</a> <a href="contact-us">c</a> <a href="https://bmsce.ac.in/tpo">t</a>
      <a href="https://facebook.com/bmsce">no</a> <a href="https://placement.bmsce.ac.in/">sub</a>
      <a href="mailto:tpo@bmsce.ac.in">m</a> <a href="tel:+919876543210">t</a>
      <a href="javascript:void(0)">j</a> <a href="/placement#top">b</a> <a href="/placement">c</a>
      <a class="x" href = '/about'>a</a>
    """
    assert links(column_of, page) == [
        "https://bmsce.ac.in/placement", "https://bmsce.ac.in/contact-us", "https://bmsce.ac.in/tpo",
        "https://placement.bmsce.ac.in/", "https://bmsce.ac.in/about"]
    for bad in ["", "<a>no href</a>", "<a href=''></a>", "not html at all"]:
        assert links(column_of, bad) == []


def test_link_resolution_follows_the_standard_library(spark):
    bases = ["https://www.x.ac.in", "https://x.ac.in/", "http://x.ac.in/a/b.html", "https://x.ac.in/a/b/",
             "https://x.ac.in/a/b?q=1"]
    hrefs = ["/p", "p", "./p", "../p", "../../../p", "?x=1", "p?x=1", "a/../b/./c", "//cdn.x.ac.in/p",
             "https://x.ac.in/z", "HTTPS://X.ac.in/z", "http://x.ac.in/z", "https:foo", "a//b", "/a//b",
             "p/", "..", ".", "/..", "/../p", "p?", "ftp://x.ac.in/p", "p;v=1?y", "/p;v=1", "p q"]
    rows = [(b, h) for b in bases for h in hrefs]
    frame = spark.createDataFrame(rows, "b string, h string")
    got = {(r.b, r.h): r.u for r in
           frame.select("b", "h", urls.resolve_link(F.col("h"), F.col("b")).alias("u")).collect()}
    for b, h in rows:
        want = urldefrag(urljoin(b, h))[0]
        assert got[(b, h)] == want, (b, h, got[(b, h)], want)


def test_hosts(column_of):
    assert column_of(["https://www.X.ac.in/p", "x.ac.in", "", "://broken", "http://[bad", None,
                      "https://m.x.in:8080/a"], urls.domain_of) == [
        "x.ac.in", "x.ac.in", "", "", "", "", "m.x.in:8080"]
    assert column_of(["a.b.c"], urls.host_suffixes) == [["a.b.c", "b.c", "c"]]


def test_link_priority(column_of):
    hints = [f"https://x.ac.in/{h}" for h in vocab.LINK_HINTS]
    got = column_of(hints, urls.link_priority)
    for url, value in zip(hints, got):
        path = urlparse(url).path
        first = next(i for i, h in enumerate(vocab.LINK_HINTS) if h in path)
        assert value == len(vocab.LINK_HINTS) - first > 0
    dead = ["/library", "/hostel", "/placement-brochure.pdf", "/placement/report.xlsx", "/tpo/photo.jpg"]
    assert column_of([f"https://x.ac.in{d}" for d in dead], urls.link_priority) == [0] * len(dead)


def test_site_classes(column_of):
    yes = ["https://dte.state.gov.in/colleges", "https://state-univ.ac.in/affiliated-institutes",
           "https://board.edu.in/list-of-colleges", "https://tech.nic.in/approved"]
    no = ["https://tourism.state.gov.in/index.php", "https://colleges.example.com/list",
          "https://en.wikipedia.org/wiki/Colleges", "https://collegedunia.com/list"]
    assert column_of(yes + no, urls.is_authoritative) == [True] * len(yes) + [False] * len(no)
    assert column_of(["https://collegedunia.com/e", "https://www.shiksha.com/b", "https://vtu.ac.in/x"],
                     urls.is_aggregator) == [True, True, False]
    assert column_of(["https://www.collegedunia.com/x", "https://m.facebook.com/x", "https://rvce.edu.in/",
                      "https://notx.com/"], urls.is_blocked) == [True, True, False, False]


def test_candidate_names(column_of):
    page = ('<h2>RV College of Engineering - Fees</h2><h3 class="t"><b>BMS</b> College &amp; School</h3>'
            '<a href="/x">short</a><p>Not a heading at all</p><a>Nitte\n  Meenakshi   Institute</a>')
    assert column_of([page, None], html.candidate_names) == [
        ["RV College of Engineering - Fees", "BMS College & School", "Nitte Meenakshi Institute"], []]


# --- scores ------------------------------------------------------------------

def email(spark, address, url="", text="", domain=""):
    frame = spark.createDataFrame([(address, url, text, domain)], "a string, u string, t string, d string")
    row = frame.select(
        score.email_score(F.col("a"), F.col("u"), score.has_placement_wording(F.col("t")), F.col("d")).alias("s"),
        score.email_reasons(F.col("a"), F.col("u"), score.has_placement_wording(F.col("t")), F.col("d")).alias("r"),
    ).first()
    return row.s, row.r


def test_email_scores(spark):
    assert email(spark, "tpo@bmsce.ac.in", domain="bmsce.ac.in")[0] == 70
    assert email(spark, "training.placement@bmsce.ac.in", domain="bmsce.ac.in")[0] == 70
    assert email(spark, "info@bmsce.ac.in", domain="bmsce.ac.in") == (
        20, ["generic local-part", "college domain"])
    assert email(spark, "noreply@bmsce.ac.in", "https://x/placement") == (0, ["junk local-part"])
    assert email(spark, "contest@x.in")[0] == 0
    assert email(spark, "sports@x.in")[0] == 60
    free, own = email(spark, "tpo.x@gmail.com")[0], email(spark, "tpo@x.ac.in", domain="x.ac.in")[0]
    assert 0 < free < own
    assert email(spark, "a.b@x.in", "https://x.in/placement", "Training & Placement Cell", "x.in") == (
        65, ["unrecognised local-part", "found on a placement page", "placement wording nearby",
             "college domain"])


def test_phone_scores(spark):
    frame = spark.createDataFrame(
        [("https://x/placement", "none"), ("https://x/placement", "the T.P.O. desk"), ("https://x/about", "x")],
        "u string, t string")
    got = [r.s for r in frame.select(
        score.phone_score(F.col("u"), score.has_placement_wording(F.col("t"))).alias("s")).collect()]
    assert got == [60, 85, 15]


def site(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, n string, t string")
    return [r.c for r in frame.select(
        "i", score.site_candidate(F.col("u"), F.col("n"), F.col("t")).alias("c")).orderBy("i").collect()]


def test_site_scores(spark):
    name = "T.K.R. College of Engineering"
    official, listing, fb, plain = site(spark, [
        ("https://tkrce.edu.in/", name, ""), ("https://collegedunia.com/college/tkrce-riverton", name, ""),
        ("https://www.facebook.com/tkrceriverton", name, ""), ("https://tkrce.edu.in/", name, "TKRCE home")])
    assert official.score == 80 and official.reasons == ["educational TLD", "acronym in domain", "root path"]
    assert listing.score == 0 and fb.score == 0 and plain.score == 80
    edu, com = site(spark, [("https://tsnce.ac.in/", "TSN College of Engineering", None),
                            ("https://tsnce.com/", "TSN College of Engineering", None)])
    assert edu.score > com.score
    named, = site(spark, [("https://lakeview.edu.in/", "Lakeview Institute of Technology", None)])
    assert "college name in domain" in named.reasons and named.score >= vocab.MIN_SITE_SCORE
    deep, root = site(spark, [
        ("https://example.edu.in/colleges/list-of-engineering", "Some Institute of Technology", ""),
        ("https://example.edu.in/", "Some Institute of Technology", "")])
    assert root.score > deep.score
    other, wrong, right = site(spark, [
        ("https://someotherplace.edu.in/", "Green Meadow Institute of Technology", ""),
        ("https://www.gmik.ac.in/", "Green Meadow Institute of Technology", ""),
        ("https://www.gmit.ac.in/", "Green Meadow Institute of Technology", "")])
    assert other.score < vocab.MIN_SITE_SCORE and wrong.score < vocab.MIN_SITE_SCORE
    assert right.score >= vocab.MIN_SITE_SCORE
    for c in site(spark, [("", "Some College", ""), ("not a url", "Some College", ""),
                          ("://broken", "Some College", "")]):
        assert c.score < vocab.MIN_SITE_SCORE


def test_ownership(spark):
    tkr = "TKRB College of Engineering, Riverton"
    cases = [
        ("Welcome to Lakeview Institute of Technology.", "Lakeview Institute of Technology, Riverton",
         "https://lakeview.edu.in", True),
        ("RVIT campus - apply now.", "Redwood Valley Institute of Technology", "http://www.rvit.ac.in", True),
        ("Write to stonefort for a place.", "Some Renamed Institute", "https://stonefort.ac.in", True),
        ("This name is parked.", "Maplewood Institute of Technology", "http://parked.example", False),
        ("", tkr, "https://tkrb.edu.in", False),
        ("Top Engineering College in Stonefield | B.Tech College", tkr, "https://www.tkrb.edu.in", False),
        ("x" * 30000 + " lakeview", "Lakeview Institute of Technology", "https://a.com", True),
    ]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                  "i int, t string, n string, u string, want boolean")
    for r in frame.withColumn("got", score.owns_page(F.col("t"), F.col("n"), F.col("u"))).collect():
        assert r.got == r.want, (r.t[:60], r.n)


def test_names_are_normalised_before_they_meet_results(spark):
    """An organisation's name is worked on once, not once per search result."""
    orgs = spark.createDataFrame([("a", "Lakeview Institute of Technology"), ("b", "TSN College of Engineering"), (None, "X College")], "org_id string, college_name string")
    urls_ = ["https://lakeview.edu.in/", "https://tsnce.ac.in/about", "https://www.shiksha.com/x", "not a url", " https://lit.com ", "", None]
    results = spark.createDataFrame([(o, i, u, t) for o in ("a", "b", None) for i, u in enumerate(urls_) for t in ("Lakeview home", "", None)], "org_id string, rank int, url string, title string")
    scored = sites.score_candidates(orgs, results)
    above, _, below = scored._jdf.queryExecution().optimizedPlan().toString().partition("Join ")
    assert "college_name" not in above and "regexp_extract_all" not in above and "college_name" in below
    alone = results.withColumn("url", F.trim("url")).where("url <> ''").join(orgs, "org_id").select("org_id", "rank", "url", score.site_candidate(F.col("url"), F.col("college_name"), F.col("title")).alias("c"))
    plain = lambda rows: sorted((r.org_id, r.rank, r.url, r.domain, r.score, tuple(r.reasons)) for r in rows.collect())
    got = plain(scored)
    assert len(got) == 2 * 5 * 3 and got == plain(alone.select("org_id", "rank", "url", "c.*"))
