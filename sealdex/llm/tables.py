"""Reading of the corpus tables and what every operator of this folder shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealdex.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
