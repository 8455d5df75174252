"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rosterlake.session import checkpoint_dir, shuffles_end_with_query

#: White space of the word rule: blank and the controls 9 to 13, nothing of Unicode.
BLANKS = r"[\x20\x09-\x0D]+"


_PACKAGE = pathlib.Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Spark hand this package to its workers, once per application.

    Steps that run in tasks are pickled by name, and a worker's path need not be
    the driver's. Spark serves the archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = pathlib.Path(tempfile.mkdtemp(prefix="run-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names; a null text is empty.

    Every other column stays out, so no name of the input can clash.
    """
    ship(docs.sparkSession)
    return docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def free_prefix(df: DataFrame, base: str) -> str:
    """``base``, with as many underscores as it takes that no column of ``df`` begins with it."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base


#: Bytes of rows that Spark hands to a Python worker at once where rows hold whole texts.
TEXT_BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def text_batches(spark: SparkSession, most_bytes: int = TEXT_BATCH_BYTES) -> Iterator[None]:
    """Bound the batches of Python steps in queries that run inside; a batch has one row at least.

    By default batches are counted in rows alone, ten thousand of them, so that
    long texts would add up in the JVM's buffers and in the worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared checkpoint folder to cut lineage.

    Parquet rather than ``checkpoint()`` for wide intermediate rows: it is
    compressed and can be read by column. ``drop`` removes a table as soon as
    nothing reads it any more; what a result still reads stays.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/rosterlake-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with shuffles_end_with_query(self.spark), text_batches(self.spark):
            df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(texts: Sequence[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` that hold about ``most_chars`` characters, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most_chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def arrow_map(df: DataFrame, step, schema: str) -> DataFrame:
    """``mapInArrow`` over a step that gives, for a record batch, dicts of columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in step(batch):
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def doc_hash(*columns: str | Column) -> Column:
    """A non-negative hash to deal rows by."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
