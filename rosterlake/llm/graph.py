"""Connected components by alternating stars, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlake.session import cut_lineage


def some(df: DataFrame) -> bool:
    """Whether there is a row; counted in one job, where ``isEmpty`` may need several."""
    return df.agg(F.count(F.lit(1))).first()[0] > 0


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (a > b).

    The smallest neighbour of each node is found by a pre-aggregated grouping and
    joined back, so the neighbours of a hub never meet in one task's memory.
    """
    if larger:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b"), F.col("a"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.where("a > b")  # the next step leaves repeated edges out
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))
    )
    return out.where("a > b").distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one: then not all edges form stars."""
    one, none = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("up"), none.alias("down")).union(
        edges.select("b", none, one)
    )
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return some(each.where("up > 1 or (up = 1 and down = 1)"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node it reaches.

    Self links only add their node. Null ends are ignored. Rounds grow with the
    logarithm of the longest chain; each round is written to the checkpoint folder.
    The rounds end when every edge leads from a node to the centre of a star: a centre is
    smaller than all its nodes, and stars have no edge between them.
    """
    raw = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    start = cut_lineage(raw.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    edges = start.where("a > b")
    while _unfinished(edges):
        edges = cut_lineage(_stars(_stars(edges, True), False))
    nodes = start.select(F.col("a").alias("node")).union(start.select("b")).distinct()
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )


def merged_roots(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) between components ``root`` (node, root) of before.

    The links are carried over to the roots first, so what the rounds work on is the
    links and not the members of the components. ``root`` should be a written table.
    """
    ends = links.join(root.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(
        root.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left"
    )
    between = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    to = cut_lineage(between.withColumnRenamed("root", "to"))
    old = root.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = to.join(root.select("node"), "node", "left_anti").select("node", F.col("to").alias("root"))
    return old.union(new)
