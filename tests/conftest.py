import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from rosterlake.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("rosterlake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def column_of(spark):
    """Evaluate one expression over a list of texts, results in input order."""

    def run(values, build, schema="pos int, v string"):
        frame = spark.createDataFrame(list(enumerate(values)), schema)
        rows = frame.select("pos", build(frame["v"]).alias("r")).orderBy("pos").collect()
        return [r["r"] for r in rows]

    return run
