"""Tables of a folder, dealt over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores where their scan has fewer pieces than that: a few small files would keep most of them idle.

    A large table comes in pieces enough and isn't shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    pieces = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows if pieces >= cores else rows.repartition(2 * cores)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
