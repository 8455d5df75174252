"""The store as a partitioned table, and runs of results that arrive as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from rosterlake import schema
from rosterlake.operators.ledger import current_runs, read_events
from rosterlake.plans.importer import import_files
from rosterlake.sources.store import RosterStore
from rosterlake.streaming.store_stream import RESULT_STREAM_SCHEMA, read_results, store_results


def records(spark, rows, columns="pos long, college_name string, stream string, placement_email string, confidence_score int"):
    frame = spark.createDataFrame(rows, columns)
    return frame.select(*[(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_STREAM_SCHEMA])


def stored(store, *columns):
    return sorted(tuple(r[c] for c in columns) for r in store.read().collect())


def test_upsert_correct_reread_repeat(spark, tmp_path):
    store = RosterStore(spark, f"{tmp_path}/store", 4)
    assert store.read().collect() == []
    first = records(spark, [(0, "Lakeview College", "BCA", "a@x.org", 85), (1, "LAKEVIEW  COLLEGE", "BCA", "", 30), (2, "Lakeview College", "Engineering", None, 5)])
    store.upsert(first)
    want = [("BCA", "a@x.org", 85, "New"), ("Engineering", None, 5, "New")]
    assert stored(store, "stream", "placement_email", "confidence_score", "outreach_status") == want
    store.upsert(first)
    assert stored(store, "stream", "placement_email", "confidence_score", "outreach_status") == want
    key = store.read().where("stream = 'BCA'").select(*schema.KEY)
    edits = key.crossJoin(spark.createDataFrame([("placement_email", "b@x.org", 1), ("outreach_status", "Contacted", 2), ("status", "Verified", 3)], "column string, value string, seq int"))
    store.correct(edits)
    again = RosterStore(spark, f"{tmp_path}/store")
    assert stored(again, "stream", "placement_email", "status", "outreach_status") == [("BCA", "b@x.org", None, "Contacted"), ("Engineering", None, None, "New")]
    with pytest.raises(ValueError):
        store.correct(edits.where("column = 'status'"))
    with pytest.raises(Exception, match="invalid stream"):
        store.upsert(records(spark, [(0, "Some College", "Medicine", None, 1)]))
    assert store.read().count() == 2


def test_only_touched_partitions_are_written(spark, tmp_path):
    store = RosterStore(spark, f"{tmp_path}/store", 8)
    store.upsert(records(spark, [(i, f"College of town number {i}", "BCA", None, i) for i in range(60)]))
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(f"{tmp_path}/store/buckets=8") for f in names if f.endswith(".parquet")}
    before = files()
    store.upsert(records(spark, [(0, "College of town number 7", "BCA", "seven@x.org", 7)]))
    assert len(before) == 8 and len(before & files()) == 7 and store.read().count() == 60


def test_buckets_grow_with_the_store(spark, tmp_path):
    store = RosterStore(spark, f"{tmp_path}/store", 2, rows_per_bucket=10)
    rows = [(i, f"College of town number {i}", "BCA", f"{i}@x.org", i) for i in range(150)]
    store.upsert(records(spark, rows[:30]))
    assert store.buckets == 2
    store.upsert(records(spark, rows))
    assert store.buckets == 8 and os.listdir(f"{tmp_path}/store").count("buckets=2") == 0
    assert stored(store, "placement_email") == sorted((r[3],) for r in rows)
    store.upsert(records(spark, rows))
    assert RosterStore(spark, f"{tmp_path}/store").buckets == 8 and store.read().count() == 150


def test_a_store_is_found_again_by_another_catalog(spark, tmp_path):
    store = RosterStore(spark, f"{tmp_path}/store", 4)
    store.upsert(records(spark, [(0, "Lakeview College", "BCA", "a@x.org", 85)]))
    other = RosterStore(spark, f"{tmp_path}/store", table="roster_under_another_name")
    assert other.buckets == 4 and stored(other, "placement_email") == [("a@x.org",)]
    spark.sql(f"DROP TABLE {other.table}")


def test_imported_files_reach_the_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("College,State,Email\nLakeview College,Kerala,\nLAKEVIEW COLLEGE,Kerala,a@lakeview.ac.in\n")
    (tmp_path / "in/b.csv").write_text("State,Institution,Mobile\nKerala,Lakeview College,9876543210\n")
    store = RosterStore(spark, f"{tmp_path}/store", 2)
    for _ in range(2):
        plan = import_files(store, f"{tmp_path}/in/*.csv")
        assert stored(store, "college_name", "placement_email", "placement_phone") == [("Lakeview College", "a@lakeview.ac.in", "+91-9876543210")]
    assert {(r.scope, r["item"]): r.n for r in plan.report().collect()}[("file", "duplicates")] == 2


def arrive(spark, folder, number, rows):
    records(spark, rows).withColumn("status", F.when(F.col("confidence_score") > 50, "Verified").otherwise("Failed")).coalesce(1).write.mode("append").parquet(f"{folder}/{number}")


def test_a_stopped_and_redelivered_stream(spark, tmp_path):
    store, ledger, source = RosterStore(spark, f"{tmp_path}/store", 2), f"{tmp_path}/ledger", f"{tmp_path}/results"
    run = lambda: store_results(read_results(spark, f"{source}/*", 1), store, run_id="r", ledger_path=ledger, checkpoint=f"{tmp_path}/checkpoint", state="Kerala", stream="BCA")
    state = lambda: [tuple(r) for r in current_runs(read_events(spark, ledger)).select("status", "processed", "succeeded", "failed").collect()]
    arrive(spark, source, 0, [(i, f"College {chr(97 + i)} of learning", "BCA", None, 40 + 4 * i) for i in range(5)])
    arrive(spark, source, 1, [(9, "College z of learning", "BCA", None, 90)])
    assert run().finish() == "completed" and state() == [("completed", 6, 3, 3)] and store.read().count() == 6
    # The second batch was stored, but its commit got lost with the driver: it is delivered again.
    commits = tmp_path / "checkpoint/commits"
    os.remove(commits / "1")
    for left in commits.glob(".1.crc"):
        os.remove(left)
    assert run().finish() == "completed" and state() == [("completed", 6, 3, 3)] and store.read().count() == 6
    # A batch that can't be stored ends the run; what came before stays.
    arrive(spark, source, 2, [(1, "College y of learning", "BCA", None, 60)])
    arrive(spark, source, 3, [(1, "College x of learning", "Medicine", None, 60)])
    assert run().finish() == "failed"
    (row,) = current_runs(read_events(spark, ledger)).collect()
    assert (row.status, row.processed, row.state) == ("failed", 7, "Kerala") and "invalid stream" in row.notes and store.read().count() == 7


def test_a_stream_that_is_stopped_is_cancelled(spark, tmp_path):
    store, ledger = RosterStore(spark, f"{tmp_path}/store", 2), f"{tmp_path}/ledger"
    arrive(spark, f"{tmp_path}/results", 0, [(0, "College a of learning", "BCA", None, 60)])
    run = store_results(read_results(spark, f"{tmp_path}/results/*"), store, run_id="r", ledger_path=ledger, checkpoint=f"{tmp_path}/checkpoint", trigger={"processingTime": "1 second"})
    run.query.processAllAvailable()
    run.stop()
    assert run.finish() == "cancelled"
    assert [(r.status, r.processed) for r in current_runs(read_events(spark, ledger)).collect()] == [("cancelled", 1)]


def test_batch_and_stream_events_of_one_number_are_two(spark):
    event = lambda source, seq, at, status, processed: ("r", source, seq, at, "S", "BCA", status, 0, processed, 0, 0, None)
    rows = [event("batch", 0, 1, "running", 5), event("stream", 0, 2, "running", 10), event("stream", 0, 3, "running", 10), event("end x", 0, 4, "completed", 0), event("batch", 1, 1, "running", 1)]
    kinds = schema.RUN_EVENT_SCHEMA.simpleString().replace("at:timestamp", "at:int")
    (got,) = current_runs(spark.createDataFrame(rows, kinds)).collect()
    assert (got.status, got.processed, got.started_at, got.finished_at) == ("completed", 16, 1, 4)
