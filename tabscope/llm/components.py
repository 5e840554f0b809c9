"""Connected components of an edge table by contraction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import NARROW_ROWS, attach, materialise, narrow
from tabscope.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is the smallest node.

    Each round points every node at the smallest of its neighbours and itself,
    by a hash that differs from round to round, and contracts the edges along
    these pointers, until no edge between two nodes is left. By the hash a path
    loses a constant share of its nodes in a round, whatever its ids.

    Rounds are written as tables in the shared checkpoint folder: a checkpoint
    keeps the size estimates of its plan, which joins would multiply from round
    to round. Hot nodes are handled by ``attach``: their degrees are known.
    Tables that fit one narrow partition are joined there without an exchange.
    """
    spark = edges.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/components-{uuid.uuid4().hex}"
    edges = materialise(edges.filter("a <> b").distinct())
    size = edges.count()
    edges = narrow(edges, size)

    def keep(df: DataFrame, name: str) -> DataFrame:  # every table here has two rows per edge at most
        narrow(df, 2 * size).write.parquet(f"{base}/{name}")
        return narrow(spark.read.schema(df.schema).parquet(f"{base}/{name}"), 2 * size)

    def both() -> DataFrame:
        return narrow(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * size)

    def to_one(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
        # tables of one partition join without an exchange
        return left.join(right, key) if 2 * size < NARROW_ROWS else attach(left, right, [key], weight)

    label = keep(both().select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), "label")
    k = 0
    while edges.head(1):
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("to"))  # noqa: E731, B023
        to = both().groupBy("a").agg(F.min(order("b")).alias("m"), F.count("*").alias("w"))
        to = keep(to.select("a", F.least(order("a"), "m")["to"].alias("to"), "w"), f"{k}-to")
        sizes = label.groupBy("comp").agg(F.count("*").alias("n"))
        step = keep(to.select(F.col("a").alias("comp"), "to").join(sizes, "comp"), f"{k}-step")
        moved = to_one(label, step, "comp", "n").select("node", F.col("to").alias("comp"))
        stay = label.join(step.select("comp"), "comp", "left_anti").select("node", "comp")
        label = keep(moved.unionByName(stay), f"{k}-label")
        half = keep(to_one(edges, to, "a", "w").select(F.col("to").alias("x"), "b"), f"{k}-half")
        half = to_one(half, to.withColumnRenamed("a", "b"), "b", "w").select(F.col("x").alias("a"), F.col("to").alias("b"))
        half = half.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = keep(half.distinct(), f"{k}-edges")
        k += 1
    least = keep(label.groupBy("comp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "least")
    return to_one(label, least, "comp", "n").select("node", F.col("least").alias("comp"))
