"""Which pages of a site are read: page budgets and best-first selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.urls import link_priority, resolve_on_site, trim_slash
from rosterlake.operators.ranges import first_rows, rank_rows
from rosterlake.session import Bucketed, cut_lineage


def guessed_urls(sites: DataFrame, paths=vocab.GUESS_PATHS, limit: int | None = None) -> DataFrame:
    """(site, url, pos): predictable contact paths below a site."""
    base = trim_slash(F.col("site"))
    urls = F.array_distinct(F.array(*[F.concat(base, F.lit(p)) for p in paths]))
    listed = urls if limit is None else F.slice(urls, 1, limit)
    return sites.select("site", F.posexplode(listed).alias("pos", "url"))


def budget_pages(
    sites: DataFrame, site_urls: DataFrame, index: DataFrame, *,
    budget: int | None = vocab.PAGE_BUDGET, attempts: int | None = vocab.PAGE_ATTEMPTS,
) -> DataFrame:
    """Pages of sites that come with a URL listing: (site, page_no, url_key, url).

    The site itself comes first unless it is listed, then the listed URLs by
    priority, then guessed contact paths. Of the first ``attempts`` the first
    ``budget`` that exist are read; both numbers are the rule, not a safeguard.
    None sets no limit.
    """
    listed = site_urls.select("site", "url", F.lit(1).alias("tier"),
                              link_priority(F.col("url")).alias("priority"), "pos")
    home = sites.select("site", F.col("site").alias("url"), F.lit(0).alias("tier"),
                        F.lit(0).alias("priority"), F.lit(0).alias("pos"))
    guesses = guessed_urls(sites).select("site", "url", F.lit(2).alias("tier"),
                                         F.lit(0).alias("priority"), "pos")
    # A URL keeps its listed place; else the home place; else the guessed one.
    preference = F.when(F.col("tier") == 1, 0).when(F.col("tier") == 0, 1).otherwise(2)
    candidates = (
        home.unionByName(listed).unionByName(guesses)
        .groupBy("site", "url")
        .agg(F.min(F.struct(preference.alias("preference"), "pos", "tier", "priority")).alias("c"))
        .select("site", "url", "c.tier", "c.priority", "c.pos")
    )
    order = ["tier", "down", "pos", "url"]
    tried = candidates.withColumn("down", -F.col("priority")).withColumn("url_key", trim_slash(F.col("url")))
    if attempts is not None:
        tried = first_rows(tried, ["site"], [F.col(c) for c in order], attempts, "attempt")
    existing = tried.join(index.select("url_key"), "url_key", "left_semi")
    if budget is None:
        read = rank_rows(existing.select("site", "url_key", *order), "page_no", order, ["site"])
    else:
        read = first_rows(existing, ["site"], [F.col(c) for c in order], budget, "page_no")
    return read.select("site", F.col("page_no").cast("int").alias("page_no"), "url_key", "url")


def best_first_pages(
    sites: DataFrame, index: DataFrame, *, max_pages: int = vocab.CRAWL_PAGES,
    max_depth: int | None = vocab.CRAWL_DEPTH,
) -> DataFrame:
    """Pages of sites read by following links: (site, page_no, url_key, url).

    All sites advance together. Each round takes the best open link of every
    site (priority, then depth, then order of discovery), reads its links from
    the page index and adds the promising ones; ``max_pages - 1`` rounds follow
    the home page. A round touches one page per site, so the work is bounded by
    the number of sites, whatever the number of pages. Links resolve against the
    site, and links to pages that do not exist never count.

    The index is kept bucketed by URL and the frontier by site, so neither moves in
    a round: only the links taken in it and found by it do.
    """
    spark = sites.sparkSession
    columns = ["site", "url_key", "url", "place", "page_no"]
    with Bucketed(spark) as kept:
        index = kept.keep(index.select("url_key", "hrefs"), "index", "url_key")
        start = sites.select(
            "site",
            trim_slash(F.col("site")).alias("url_key"),
            F.col("site").alias("url"),
            F.struct(
                F.lit(-vocab.SEED_PRIORITY).alias("rank"), F.lit(0).alias("depth"),
                F.lit(0).cast("bigint").alias("seq"),
            ).alias("place"),
            F.lit(1).alias("page_no"),
        )
        start = start.join(index.select("url_key"), "url_key", "left_semi").select(*columns)

        def opened(taken: DataFrame, round_no: int) -> DataFrame:
            """Promising existing links on the pages taken this round."""
            deeper = F.lit(True) if max_depth is None else F.col("place.depth") < max_depth
            links = taken.where(deeper).join(index, "url_key").select(
                "site",
                (F.col("place.depth") + 1).alias("depth"),
                F.posexplode(resolve_on_site(F.col("hrefs"), F.col("site"))).alias("i", "link"),
            ).withColumn("priority", link_priority(F.col("link")))
            found = links.where(F.col("priority") > 0).select(
                "site",
                trim_slash(F.col("link")).alias("url_key"),
                F.col("link").alias("url"),
                F.struct(
                    (-F.col("priority")).alias("rank"),
                    F.col("depth"),
                    (F.lit(round_no).cast("bigint") * (1 << 32) + F.col("i")).alias("seq"),
                ).alias("place"),
                F.lit(None).cast("int").alias("page_no"),
            )
            return found.join(index.select("url_key"), "url_key", "left_semi").select(*columns)

        def merged(known: DataFrame, extra: DataFrame) -> DataFrame:
            """One row per site and page: its page number if taken, else its best place."""
            dealt = extra.repartition(kept.buckets, "site")
            return known.unionByName(dealt).groupBy("site", "url_key").agg(
                F.min_by("url", "place").alias("url"),
                F.min("place").alias("place"),
                F.max("page_no").alias("page_no"),
            ).select(*columns)

        known = kept.keep(start, "home", "site")
        state = kept.keep(merged(known, opened(known, 0)), "state", "site", dealt=True)
        for page_no in range(2, max_pages + 1):
            taken = (
                state.where(F.col("page_no").isNull())
                .groupBy("site")
                .agg(F.min_by(F.struct("url_key", "url", "place"), "place").alias("t"))
                .select("site", "t.url_key", "t.url", "t.place", F.lit(page_no).alias("page_no"))
            ).select(*columns)
            grown = taken if page_no == max_pages else taken.unionByName(opened(taken, page_no))
            state = kept.keep(merged(state, grown), "state", "site", dealt=True)
            if state.where(F.col("page_no") == page_no).isEmpty():
                break
        return cut_lineage(state.where(F.col("page_no").isNotNull()).select("site", "page_no", "url_key", "url"))


def level_pages(start: DataFrame, index: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """All pages that promising links lead to from the pages of ``start``: (site, page_no, url_key, url).

    ``start`` has site, page_no, url_key and url. All sites advance together by a
    whole level a round, as many rounds as the deepest site has levels. Pages stand
    by level, then link priority, then order of discovery; no number of pages is set.
    The index is kept bucketed by URL and met once a round: what tells that a page
    exists also brings its links. A page is sorted within its level once; ``turn``
    only has to rise with the order, numbers without gaps are given at the end.
    """
    order = ["site", "rank", "parent", "i", "url_key"]
    with Bucketed(start.sparkSession) as kept:
        # Copies of a page may differ in their links; each distinct list counts.
        pages = index.where(F.col("url_key").isNotNull()).repartition(kept.buckets, "url_key")
        index = kept.keep(pages.groupBy("url_key").agg(F.collect_set("hrefs").alias("lists")), "index", "url_key", dealt=True)
        first = start.groupBy("site", "url_key").agg(F.min(F.struct("page_no", "url")).alias("p")).join(index, "url_key").select(
            "site", "url_key", "p.url", F.lit(0).alias("depth"), F.col("p.page_no").cast("bigint").alias("turn"), "lists"
        )
        level = kept.keep(first, "level 0")
        known, depth, promising = level.drop("lists"), 0, _promising(F.col("hrefs"), F.col("site"))
        while (max_depth is None or depth < max_depth) and not level.isEmpty():
            depth += 1
            lists = level.select("site", "turn", F.explode("lists").alias("hrefs"))
            links = lists.select("site", "turn", F.explode_outer(promising).alias("l")).where(F.col("l").isNotNull())
            place = F.struct("l.rank", F.col("turn").alias("parent"), "l.i", "l.url")
            found = links.groupBy("site", trim_slash(F.col("l.url")).alias("url_key")).agg(F.min(place).alias("p"))
            new = found.join(known, ["site", "url_key"], "left_anti").join(index, "url_key").select("site", "url_key", "p.*", "lists")
            # Written before it is sorted, as borders of ranges are drawn from a pass of their own.
            ranked = kept.keep(new, "new").repartitionByRange(*order).sortWithinPartitions(*order)
            ranked = ranked.select("site", "url_key", "url", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("turn"), "lists")
            level = kept.keep(ranked, f"level {depth}")
            known = known.unionByName(level.drop("lists"))
        return rank_rows(known, "page_no", ["depth", "turn"], ["site"]).select(
            "site", F.col("page_no").cast("int").alias("page_no"), "url_key", "url"
        )


def _promising(hrefs: Column, site: Column) -> Column:
    """struct(rank, i, url) of the links of a page that are worth following."""
    rated = F.transform(
        resolve_on_site(hrefs, site), lambda u, i: F.struct((-link_priority(u)).alias("rank"), i.alias("i"), u.alias("url"))
    )
    return F.filter(rated, lambda l: l["rank"] < 0)


def choose_pages(
    sites: DataFrame, index: DataFrame, site_urls: DataFrame | None = None, *, budget: int | None = None,
    attempts: int | None = None, max_pages: int | None = None, max_depth: int | None = None,
) -> DataFrame:
    """Pages to read per site: by listing where there is a useful one, else by links.

    Without numbers all are read: the pages of the listing first and whatever
    promising links lead to from there or from the home page. ``budget`` and
    ``attempts`` limit sites with a listing, as in ``budget_pages``, to pages of it;
    ``max_pages`` the others, best first, and ``max_depth`` the links followed.
    """
    home = sites.select("site", F.lit(1).alias("page_no"), trim_slash(F.col("site")).alias("url_key"), F.col("site").alias("url"))

    def by_links(rest: DataFrame) -> DataFrame:
        if max_pages is None:
            return level_pages(home.join(rest.select("site"), "site", "left_semi"), index, max_depth=max_depth)
        return best_first_pages(rest, index, max_pages=max_pages, max_depth=max_depth)

    if site_urls is None:
        return by_links(sites)
    listing = site_urls.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    useful = listing.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("site")
    budgeted = cut_lineage(
        budget_pages(sites.join(useful, "site", "left_semi"),
                     listing.join(useful, "site", "left_semi"), index, budget=budget, attempts=attempts)
    )
    rest = sites.join(budgeted.select("site").distinct(), "site", "left_anti")
    if budget is None and attempts is None:
        budgeted = level_pages(budgeted, index, max_depth=max_depth)
    return reduce(DataFrame.unionByName, [budgeted, by_links(rest)])
