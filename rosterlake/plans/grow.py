"""Grow the roster until enough organisations are complete, and batch runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rosterlake import schema, vocab
from rosterlake.functions.text import normalize_district, normalize_name
from rosterlake.operators.growth import grow_report, grow_until, new_candidates
from rosterlake.operators.ledger import run_counters
from rosterlake.operators.roster import coverage, is_complete
from rosterlake.plans.resolve import ResolveInputs, as_records, resolve, with_org_id
from rosterlake.session import cut_lineage
from rosterlake.sources.store import RosterStore


@dataclass
class Growth:
    candidates: DataFrame
    report: DataFrame
    attempts: DataFrame | None
    visible: int


def visible_rows(store: RosterStore, state: str | None = None) -> int:
    roster = store.read()
    if state:
        roster = roster.where(F.col("state") == state)
    return coverage(roster).first()["visible"]


def grow(
    store: RosterStore, seeds: DataFrame, inputs: ResolveInputs, target: int, *,
    only_state: str | None = None, dry_run: bool = False,
    targets: Sequence[tuple[str, str]] = vocab.GROW_TARGETS, now: Column | None = None,
) -> Growth:
    """Resolve new candidates in order and store them up to the one that ends the run.

    ``seeds`` has the seed columns and ``pos``; the target counts
    rows seen outside, within one state if ``only_state`` is given.
    """
    chosen = [t for t in targets if not only_state or t[0] == only_state]
    start = visible_rows(store, only_state)
    fresh = cut_lineage(with_org_id(new_candidates(seeds, store.read(), chosen)))
    report = grow_report(seeds.where(F.col("state").isin(*{s for s, _ in chosen})), fresh)
    if dry_run or start >= target:
        return Growth(fresh, report, None, start)
    results = resolve(fresh, inputs, now).withColumn("complete", is_complete())
    attempts = cut_lineage(grow_until(
        results, target, start=start, order=("target_no", "pos", "org_id")
    ))
    store.upsert(as_records(attempts.drop("pos").withColumn("pos", F.col("attempted"))), now=now)
    return Growth(fresh, report, attempts, visible_rows(store, only_state))


def run_batch(
    store: RosterStore, seeds: DataFrame, inputs: ResolveInputs, state: str, stream: str, *,
    run_id: str, ledger_path: str, limit: int | None = None, skip_resolved: bool = False,
    now: Column | None = None,
) -> DataFrame:
    """Resolve and store the first ``limit`` seeds of a state and stream, with run events.

    ``skip_resolved`` leaves out organisations the store holds as Verified.
    """
    at = F.current_timestamp() if now is None else now
    here = seeds.where((F.col("state") == state) & (F.col("stream") == stream))
    if skip_resolved:
        done = store.read().where(F.col("status") == "Verified").select(*[F.col(c).alias(f"_{c}") for c in schema.KEY])
        same = (
            (normalize_name(F.col("college_name")) == F.col("_normalized_name"))
            & (normalize_district(F.col("district")) == F.col("_district"))
            & (F.col("stream") == F.col("_stream"))
        )
        here = here.join(done, same, "left_anti")
    chosen = here.orderBy("pos").limit(limit) if limit is not None else here
    chosen = cut_lineage(chosen)
    spark = store.spark

    def note(seq: int, status: str, notes: str | None = None, total: int = 0, counters=None) -> None:
        counts = counters or {"processed": 0, "succeeded": 0, "failed": 0}
        spark.createDataFrame(
            [(run_id, "batch", seq, None, state, stream, status, total, counts["processed"],
              counts["succeeded"], counts["failed"], notes)],
            schema.RUN_EVENT_SCHEMA,
        ).withColumn("at", at).write.mode("append").parquet(ledger_path)

    note(0, "running", total=chosen.count())
    try:
        results = cut_lineage(resolve(chosen, inputs, now))
        store.upsert(as_records(results), now=now)
        counters = run_counters(results, ()).first().asDict()
    except Exception as problem:
        note(1, "failed", str(problem))
        raise
    note(1, "completed", counters=counters)
    return results


