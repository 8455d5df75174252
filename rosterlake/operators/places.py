"""Does a name belong to a state, judged by the places it mentions?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import vocab
from rosterlake.functions.text import any_of

#: Letters of a place that names are looked up by.
_STEM = 3
#: Places that travel as one list; about 4 MB of text.
MOST_PLACES = 100_000


def _outside(lowered: Column, out_of_scope) -> Column:
    words = any_of(vocab.FOREIGN_MARKERS) + "|" + any_of(out_of_scope)
    return lowered.rlike(rf"(?U)\b(?:{words})\b")


def place_list(reference: DataFrame) -> DataFrame:
    """(state, place, is_state): states and districts, lowered for searching."""
    districts = reference.select(
        "state", F.lower("district").alias("place"), F.lit(False).alias("is_state")
    )
    states = reference.select(
        "state", F.lower("state").alias("place"), F.lit(True).alias("is_state")
    ).distinct()
    return states.unionByName(districts).where(F.col("place") != "").distinct()


def _verdict(lowered: Column, state: Column, own: Column, other: Column, out_of_scope) -> Column:
    named_own = own | F.coalesce(F.contains(lowered, F.lower(state)), F.lit(False))
    return F.when(_outside(lowered, out_of_scope), False).when(named_own, True).otherwise(F.when(lowered.isNotNull(), ~other))


def _rejects(place: Column, is_state: Column) -> Column:
    """A place of another state counts against a name if it is telling enough."""
    return is_state | (F.length(place) > 6)


def plausibly_in_state(
    names: DataFrame, reference: DataFrame, *, name: str = "college_name", state: str = "state",
    out: str = "in_state", out_of_scope=vocab.OUT_OF_SCOPE_PLACES, most_places: int = MOST_PLACES,
) -> DataFrame:
    """Add a flag: FALSE where a name points abroad or to another state.

    ``reference`` is the (state, district) table. Its places are counted; up to
    ``most_places`` they travel as one list, computed once, and each name is
    searched for all of them where it stands, without a join. A longer list is joined
    on the first letters of its places, see ``_by_stems``.
    No place speaks against a row whose state is NULL, and a NULL name gives NULL.
    """
    places = place_list(reference)
    if places.count() > most_places:
        return _by_stems(names, places, name, state, out, out_of_scope)
    listed = places.select(F.collect_list(F.struct("state", "place", _rejects(F.col("place"), F.col("is_state")).alias("rejects")))).scalar()
    lowered = F.lower(F.col(name))
    with_places = names.withColumn("_places", listed)
    named = F.filter("_places", lambda p: F.contains(lowered, p["place"]))
    own = F.exists(named, lambda p: p["state"] == F.col(state))
    other = F.exists(named, lambda p: (p["state"] != F.col(state)) & p["rejects"])
    off = F.lit(False)
    verdict = _verdict(lowered, F.col(state), F.coalesce(own, off), F.coalesce(other, off), out_of_scope)
    return with_places.withColumn(out, verdict).drop("_places")


def _by_stems(names: DataFrame, places: DataFrame, name: str, state: str, out: str, out_of_scope) -> DataFrame:
    """As above, by a join on the first letters of each place.

    Every occurrence of a place starts with its stem, so no containment is missed.
    Names are judged once per distinct (name, state).
    """
    distinct = names.select(F.col(name).alias("_n"), F.col(state).alias("_s")).distinct()
    stemmed = places.withColumn("_stem", F.substring("place", 1, _STEM))
    # Places shorter than a stem are rare; only where there are some are shorter stems made.
    has_short = not places.where(F.length("place") < _STEM).isEmpty()
    sizes = range(1, _STEM + 1) if has_short else (_STEM,)
    spots = (
        distinct.select(
            "_n", "_s",
            F.explode(F.sequence(F.lit(1), F.greatest(F.length("_n"), F.lit(1)))).alias("_at"),
        )
        .select(
            "*",
            F.explode(F.array(*[
                F.substring(F.lower("_n"), F.col("_at"), F.lit(size)) for size in sizes
            ])).alias("_stem"),
        )
    )
    hits = spots.join(stemmed, "_stem").where(
        F.substring(F.lower("_n"), F.col("_at"), F.length("place")) == F.col("place")
    )
    flags = hits.groupBy("_n", "_s").agg(
        F.bool_or(F.col("state") == F.col("_s")).alias("_own"),
        F.bool_or(
            (F.col("state") != F.col("_s")) & _rejects(F.col("place"), F.col("is_state"))
        ).alias("_other"),
    )
    joined = names.join(
        flags, (F.col(name) == F.col("_n")) & (F.col(state) == F.col("_s")), "left"
    )
    off = F.lit(False)
    return joined.withColumn(
        out,
        _verdict(
            F.lower(F.col(name)), F.col(state),
            F.coalesce("_own", off), F.coalesce("_other", off), out_of_scope,
        ),
    ).drop("_n", "_s", "_own", "_other")
