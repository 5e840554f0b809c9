"""Table access for the driver-generated parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filters reach the reader."""
    return balanced(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def balanced(df: DataFrame) -> DataFrame:
    """Spread a scan that Spark reads with a single task.

    That is at most one input split (``spark.sql.files.maxPartitionBytes``),
    whatever the cluster; every larger table is left alone.
    """
    if df.rdd.getNumPartitions() == 1:
        return df.repartition(min(8, df.sparkSession.sparkContext.defaultParallelism))
    return df
