"""The state and district reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """(state, district) rows of a JSON object of lists; keys starting "_" are notes."""
    document = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    states = document.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select("key", "value")
    districts = states.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(F.col("value").alias("item")))
    return districts.where(~F.startswith("key", F.lit("_"))).select(
        F.col("key").alias("state"), F.try_variant_get("item", "$", "string").alias("district")
    )
