"""Session settings the jobs rely on, and the one way they cut lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings only: they can be set on a session that is already running.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join partitions even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A persisted table keeps its hash partitioning, so joins on it do not move it.
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure checkpoints have a place to go."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only where neither that nor
    a context-level folder is set, and the master is local, is a fresh one made.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def shuffles_end_with_query(spark: SparkSession) -> Iterator[None]:
    """Have Spark remove the shuffle files of each query that runs inside when it ends.

    For queries whose result goes to shared storage: nothing reads their shuffles
    again, and jobs of many rounds would pile them up on the executors' disks.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over as many tasks as a shuffle has.

    For costly expressions on narrow rows: a small file is read by one task, however
    many rows it has.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it with a fresh plan.

    Reliable checkpoint: the data is in shared storage, so losing an executor
    afterwards costs nothing but a re-read. ``df`` must be a frame that no action ran on yet.
    """
    checkpoint_dir(df.sparkSession)
    with shuffles_end_with_query(df.sparkSession):
        return df.checkpoint(eager=True)


class Bucketed:
    """Frames kept as tables bucketed by a key, for joins and groupings in rounds.

    A table has as many buckets as a shuffle has partitions, one file each, in the
    shared checkpoint folder; reading it needs no exchange for its key. Use it
    as a context: its tables are dropped and their files removed at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        for name in list(self.tables):
            self.drop(name)

    def keep(self, df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
        """Write ``df`` as a table and return that; a table of this name is dropped afterwards.

        ``dealt``: the rows are dealt by these keys already, so they need no exchange.
        Without keys the table has no buckets and the rows stay as they are dealt.
        """
        table = f"kept_{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(self.spark).rstrip('/')}/rosterlake-{table}"
        with shuffles_end_with_query(self.spark):
            # Dealt like the buckets, so that each is written by one task.
            rows = df if dealt or not keys else df.repartition(self.buckets, *keys)
            writer = rows.write.bucketBy(self.buckets, *keys).sortBy(*keys) if keys else rows.write
            writer.option("path", path).saveAsTable(table)
        self.drop(name)
        self.tables[name] = table, path
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        if name in self.tables:
            table, path = self.tables.pop(name)
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
