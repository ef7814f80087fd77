"""Tables of a folder, spread over the cores when their files are few."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import bound_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where the scan alone would leave cores idle; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
