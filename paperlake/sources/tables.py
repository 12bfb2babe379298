"""Plain table reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread: bool = True) -> DataFrame:
    """A Parquet table, spread over all cores when its files make fewer scan tasks than that.

    Tokenising, parsing and hashing cost far more than moving a small table once. A table with
    at least one scan task per core is never moved.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
