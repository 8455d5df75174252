"""The roster store: a table of Spark's catalog, partitioned by key bucket and stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake import schema, vocab
from rosterlake.operators import merge
from rosterlake.session import cut_lineage

#: ``buckets`` is how many buckets the rows of a partition were dealt into.
_LAYOUT = {"buckets": "int", "stream": "string", "bucket": "int"}
#: A store has more rows than this in a bucket, on average, only until its next write.
ROWS_PER_BUCKET = 500_000
_COUNT = "roster.buckets"


class RosterStore:
    """One row per (normalised name, district, stream).

    A partitioned Parquet table at ``path``, written with ``INSERT OVERWRITE`` of the
    partitions that a write has rows for; Spark writes those aside and moves them in when
    the job commits. A write reads and replaces only the buckets its keys fall into. One that
    was cut short is repeated with the same records: the merge is keyed, so nothing
    counts twice. One writer at a time.

    Buckets double when they hold more than ``rows_per_bucket`` rows on average: all
    rows are inserted once more under the new number, which the table's properties then name;
    until then readers see the old partitions. Opening a store with another number
    than it has is refused.
    """

    def __init__(
        self, spark: SparkSession, path: str, buckets: int | None = None, *, table: str | None = None,
        rows_per_bucket: int = ROWS_PER_BUCKET,
    ):
        self.spark, self.path, self.rows_per_bucket = spark, path, rows_per_bucket
        self.table = table or f"roster_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        if not spark.catalog.tableExists(self.table):
            self._create(buckets)
        found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {self.table}").collect()}
        self.buckets = int(found[_COUNT])
        if buckets not in (None, self.buckets):
            raise ValueError(f"{path} has {self.buckets} buckets, not {buckets}")

    def _create(self, buckets: int | None) -> None:
        """Define the table, over the rows that an earlier catalog left at ``path`` if there are any."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.STORE_SCHEMA if f.name not in _LAYOUT)
        layout = ", ".join(f"{c} {kind}" for c, kind in _LAYOUT.items())
        self.spark.sql(
            f"CREATE TABLE {self.table} ({columns}, {layout}) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY ({', '.join(_LAYOUT)}) LOCATION '{self.path}'"
        )
        files, place = self._folder("")
        if files.exists(place):
            self.spark.catalog.recoverPartitions(self.table)
        there = [r["buckets"] for r in self.spark.table(self.table).select("buckets").distinct().limit(2).collect()]
        if len(there) > 1:
            self.spark.sql(f"DROP TABLE {self.table}")
            raise ValueError(f"{self.path} was left while its buckets were doubled; remove one of {sorted(there)}")
        self._name_buckets(there[0] if there else buckets or 16)

    def _folder(self, below: str):
        """The file system and path of the store or a folder below it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}{below}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _name_buckets(self, buckets: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} SET TBLPROPERTIES ('{_COUNT}' = '{buckets}')")

    def _placed(self, df: DataFrame, buckets: int) -> DataFrame:
        hashed = F.xxhash64("normalized_name", "district")
        return df.withColumns({"buckets": F.lit(buckets), "bucket": F.pmod(hashed, F.lit(buckets)).cast("int")})

    def _rows(self) -> DataFrame:
        return self.spark.table(self.table).where(F.col("buckets") == self.buckets)

    def read(self) -> DataFrame:
        return self._rows().select(*schema.STORE_COLUMNS)

    def _touched(self, keyed: DataFrame) -> DataFrame:
        """Stored rows of the buckets that ``keyed`` falls into (partition-pruned).

        The list of buckets has at most streams x buckets entries.
        """
        places = self._placed(keyed, self.buckets).select("stream", "bucket").distinct().collect()
        hit = F.lit(False)
        for stream in sorted({p["stream"] for p in places}):
            numbers = sorted(p["bucket"] for p in places if p["stream"] == stream)
            hit = hit | ((F.col("stream") == stream) & F.col("bucket").isin(*numbers))
        return self._rows().where(hit).select(*schema.STORE_COLUMNS)

    def _replace(self, rows: DataFrame, buckets: int) -> None:
        """Replace the partitions that ``rows`` fall into."""
        columns = [c for c in schema.STORE_COLUMNS if c not in _LAYOUT]
        (
            self._placed(rows, buckets)
            # Rows of a bucket meet, and a bucket too large for a task is split.
            .hint("rebalance", *[F.col(c) for c in _LAYOUT])
            .select(*columns, *_LAYOUT)
            .write.insertInto(self.table, overwrite=True)
        )

    def _make_room(self) -> None:
        """Double the buckets while they hold too many rows; the count reads only file footers."""
        rows, old, new = self._rows().count(), self.buckets, self.buckets
        while rows > self.rows_per_bucket * new * len(vocab.STREAMS):
            new *= 2
        if new == old:
            return
        self._replace(self.read(), new)
        self._name_buckets(new)
        self.buckets = new
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (buckets = {old})")
        files, place = self._folder(f"/buckets={old}")
        files.delete(place, True)
        self.spark.catalog.refreshTable(self.table)

    def upsert(self, records: DataFrame, *, now: Column | None = None) -> None:
        """Merge records (see ``merge.upsert``); ``pos`` orders records of one key."""
        checked = merge.require_streams(records)
        if "pos" not in checked.columns:
            checked = checked.withColumn("pos", F.monotonically_increasing_id())
        incoming = cut_lineage(merge.with_key(checked))
        self._replace(merge.upsert(self._touched(incoming), incoming, F.current_timestamp() if now is None else now), self.buckets)
        self._make_room()

    def correct(self, corrections: DataFrame, *, now: Column | None = None) -> None:
        """Apply hand corrections keyed by the store key; see ``merge.apply_corrections``."""
        edits = cut_lineage(merge.require_edits(corrections))
        stored = self._touched(edits)
        self._replace(merge.apply_corrections(stored, edits, F.current_timestamp() if now is None else now), self.buckets)
