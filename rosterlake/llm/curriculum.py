"""Mixing sources to target weights along a curriculum that changes over training time.

Every source has a target, the words that the whole mix takes of it, and a schedule, the
relative weight of the source at each moment of training, piecewise linear over 0 to 1.
The integral of the schedule up to t, scaled to the target, is the words that the source has
to have delivered by t. The documents of a source stand in a seeded order, one pass after the
other; the words ahead of a document are inverted through that integral and give the moment
at which it is due. A range sort by this position puts the mix of all sources into
one training order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rosterlake.llm.common import Scratch, ship
from rosterlake.operators.ranges import rank_rows, running_sums

#: Weights dealt to the sources in order, and the most that a source gives: passes over itself.
WEIGHTS, MOST_PASSES = (1, 2, 3), 3
#: (moment, relative weight) knots dealt along with the weights: light sources early, heavy ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Bytes of text counted at once.
_STEP = 1 << 22
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; null counts 0.

    Works on the bytes: white space of the rule is one byte each in UTF-8.
    """
    texts = texts.cast(pa.large_string())
    out = np.zeros(len(texts), np.int64)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None or not data.size:
        return out
    ends = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)
    for lo in range(int(ends[0]), int(ends[-1]), _STEP):
        hi = min(lo + _STEP, int(ends[-1]))
        solid = ~_BLANK[raw[lo:hi]]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        if lo > ends[0] and not _BLANK[raw[lo - 1]]:
            begins[0] = False  # a word goes on from the step before
        first, last = np.searchsorted(ends, [lo, hi], "left")
        heads = ends[first:last] - lo  # texts that start here
        begins[heads] = solid[heads]
        of = np.searchsorted(ends, np.flatnonzero(begins) + lo, "right") - 1
        out += np.bincount(of, minlength=len(out))
    return out


def _sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), batch.column("turn"), pa.array(word_counts(batch.column("text")))],
            ["doc_id", "source", "turn", "size"],
        )


def source_targets(sized: DataFrame, scratch: Scratch, weights: Sequence[int], most_passes: int) -> DataFrame:
    """source, place, source_size, target: the words that the mix takes of each source.

    ``place`` numbers the sources by the code points of their names, null last, and
    deals the weights out. The words of all sources are shared by weight; a source
    whose share is more than ``most_passes`` times its own words gets that, and the
    others share the rest, until no share is above. A round is one aggregate over the
    table of sources; only two sums come back from it.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("lost", F.col("source").isNull())
    ranked = rank_rows(sums, "place", ["lost", "source"])
    table = scratch.write(ranked.select("source", "source_size", (F.col("place") - 1).cast("int").alias("place")), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    most = F.col("source_size").cast("double") * F.lit(float(most_passes))
    fair, left = F.lit(0.0), None
    while True:
        capped = fair > most
        got = table.select(
            F.sum("source_size").cast("double") - F.sum(F.when(capped, most).otherwise(F.lit(0.0))),
            F.sum(F.when(capped, F.lit(0.0)).otherwise(weight)),
        ).first()
        if tuple(got) == left:
            break
        left = tuple(got)
        fair = weight * F.lit(left[0] or 0.0) / F.lit(left[1] or 1.0)
    return table.select("source", "place", "source_size", F.least(fair, most).alias("target"))


def moment(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The moment by which ``share`` (0 to 1) of a schedule's integral is reached.

    Between two knots the weight is linear, so the integral is a quadratic of the time.
    """
    knots = [(float(t), float(w)) for t, w in knots]
    times = [t for t, _ in knots]
    if not knots or times != sorted(times) or (times[0], times[-1]) != (0, 1) or any(w < 0 or not math.isfinite(w) for _, w in knots):
        raise ValueError("a schedule runs from 0 to 1 with finite weights of 0 or more")
    pairs = [(a, b) for a, b in zip(knots, knots[1:], strict=False) if b[0] > a[0]]
    total = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in pairs)
    if total <= 0:
        raise ValueError("a schedule needs some weight")
    due, begun, found = share * F.lit(total), 0.0, None
    for (t0, w0), (t1, w1) in pairs:
        rest = due - F.lit(begun)
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + rest * F.lit(2 * (w1 - w0) / (t1 - t0)), F.lit(0.0)))
        step = F.when(root > 0, rest * F.lit(2.0) / root).otherwise(F.lit(0.0))
        here = F.lit(t0) + F.least(step, F.lit(t1 - t0))
        found = here if found is None else F.when(due >= F.lit(begun), here).otherwise(found)
        begun += (w0 + w1) / 2 * (t1 - t0)
    return found


def curriculum(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most_passes: int = MOST_PASSES, seed: str = "", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row for each time that the mix takes a document, in any order.

    row (names the row of ``docs``), doc_id, source, size, source_size, target, pass,
    words, position (0 to 1, the moment of training) and first_word, the place of the
    copy's first word in the training order; ``training_order`` sorts by it. A
    document that isn't taken has one row with words 0 and neither pass nor place.

    Documents are taken whole, in the order of the md5 of ``seed`` and id; only the
    one in which the target of its source ends is taken as far as that (``words`` is
    less than ``size`` there). A source gives its target, rounded to a word.

    Null and empty texts have size 0 and are never taken. Null sources are one source, the
    last. Null ids stand like any other; repeated rows are documents of their own.
    Reruns give each text of an id and size the same words; rows that are equal in
    both may trade places. An empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    named = docs.select(
        docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{source_col}`"].cast("string").alias("source"),
        docs[f"`{text_col}`"].cast("string").alias("text"),
    )
    turn = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    sized = scratch.write(
        named.withColumn("turn", turn).mapInArrow(_sized, "doc_id bigint, source string, turn string, size bigint"), "sized"
    )
    targets = source_targets(sized, scratch, weights, most_passes).withColumnRenamed("source", "name")
    rows = sized.withColumn("row", F.monotonically_increasing_id())
    laid = running_sums(rows, {"through": F.col("size")}, ["turn", "doc_id", "size", "row"], ["source"])
    met = laid.join(targets, laid["source"].eqNullSafe(targets["name"])).drop("name")
    copies = met.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most_passes - 1))))
    start = F.col("pass") * F.col("source_size") + F.col("through") - F.col("size")
    goal = F.round("target").cast("bigint")
    copies = copies.withColumn("start", start).withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("start"))))
    copies = copies.where((F.col("words") > 0) | (F.col("pass") == 0))
    share, position = F.col("start") / F.round("target"), F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        position = F.when(F.col("place") % len(schedules) == i, moment(share, knots)).otherwise(position)
    taken = F.col("words") > 0
    placed = copies.select(
        "row", "doc_id", "source", "turn", "size", "source_size", "target", "words",
        F.when(taken, F.col("pass")).alias("pass"), F.when(taken, position).alias("position"),
    )
    ordered = running_sums(placed, {"end": F.col("words")}, ["position", "source", "turn", "doc_id", "size", "pass", "row"])
    return ordered.select(
        "row", "doc_id", "source", "size", "source_size", "target", "pass", "words", "position",
        F.when(taken, F.col("end") - F.col("words")).alias("first_word"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The copies that are taken, sorted by their place in training; the sort is by ranges."""
    return mixed.where("words > 0").orderBy("first_word")


def taken_words(mixed: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, first_word (of its first copy)."""
    first = lambda c: F.first(c).alias(c)
    return mixed.groupBy("row").agg(
        first("doc_id"), first("size"), first("source_size"), first("target"),
        F.sum("words").alias("taken"), F.count("pass").alias("passes"), F.min("first_word").alias("first_word"),
    ).drop("row")
