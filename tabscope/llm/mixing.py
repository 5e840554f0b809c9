"""Mixing sources to target weights by cube-method balanced sampling.

Targets: the sources share ``share`` times all sizes in proportion to their
weights; a source never gets more than ``cap`` times its own size, and the
excess is shared again by weight until none is above. Every document of a
source then has the inclusion ``target / source_size``: its whole part is taken
as copies, the fractional part is a probability that the cube method turns
into 0 or 1.

Cube method: inside a block, a walk through the null space of the balancing
constraints (number of documents, number of tokens) moves the probabilities
until all but at most two are 0 or 1, leaving both totals unchanged. Blocks
are hash buckets of one source (a hot source has many), so a walk sees a
bounded number of rows; what is left of the blocks is walked again, block of
blocks, until one block per source remains, and the landing
decides its two fractional and twelve largest documents together so that the
token total, then the document count, is missed least.

Everything is a function of the rows alone: order and buckets come from
hashes of (doc_id, size), the random numbers from a seeded hash of the block.
Rows equal in id, source and size are counted first and dealt out again in runs
of at most one block, each run with a hash of its own, so that any number of
repeated rows (null ids with empty texts, say) never fills one bucket.

Edge cases: a null or empty text has size 0 and takes 0 words; a null source
is a source of its own, last in order; sources of size 0 get target 0; rows
that repeat an id are separate units; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import WORD_CLASS, attach, materialise

BLOCK = 2048
#: Documents that the landing decides besides the two that the walk leaves.
LANDING = 12
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size), hot sources pre-aggregated."""
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = (per.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
              .map(lambda x: (x[0]["source"], x[0]["n"], x[0]["source_size"], float(weights[x[1] % len(weights)]))))
    per = materialise(spark.createDataFrame(ranked, "source string, n long, source_size long, weight double"))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    room = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while True:  # water filling: the capped sources only grow in number
        is_capped = room <= F.col("weight") * F.lit(level)
        row = per.agg(F.sum(F.when(is_capped, room).otherwise(0.0)), F.sum(F.when(is_capped, 0.0).otherwise(F.col("weight"))),
                      F.sum(is_capped.cast("long"))).first()
        if not row[1] or row[2] == capped:
            break
        capped, level = row[2], (share * total - row[0]) / row[1]
    return per.withColumn("target", F.least(room, F.col("weight") * F.lit(level))).drop("weight")


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Walk ``p`` to a vertex of the cube that keeps sum(p) and sum(p * size); at most two stay fractional."""
    p = list(p)
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    hand: list[int] = []
    nxt = 0
    while True:
        while len(hand) < 3 and nxt < len(todo):
            hand.append(todo[nxt])
            nxt += 1
        if len(hand) < 3:
            # two left: equal sizes still leave a direction that keeps both totals
            if len(hand) == 2 and size[hand[0]] == size[hand[1]]:
                u = [1.0, -1.0]
            else:
                return p
        else:
            a, b, c = (size[i] for i in hand)
            u = [b - c, c - a, a - b]
            if a == b == c:
                u = [1.0, -1.0, 0.0]
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(hand, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(hand, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for i, v in zip(hand, u):
            x = p[i] + step * v
            p[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
            if 0.0 < p[i] < 1.0:
                left.append(i)
        hand = left


def landing(p: list[float], size: list[float]) -> list[float]:
    """Round the few fractional units left so that the token total, then the count, is missed least."""
    left = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    want, have = np.array([p[i] for i in left]), np.array([size[i] for i in left])
    tokens = np.abs(picks @ have - (want @ have if left else 0.0))
    count = np.abs(picks.sum(1) - want.sum())
    best = picks[np.lexsort((count, np.round(tokens, 6)))[0]]
    out = list(p)
    for i, x in zip(left, best):
        out[i] = float(x)
    return out


def _walk(seed: int, last: bool):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        # the last walk of a source leaves its largest documents to the landing: they hit the token total best
        order = ["size", "h", "doc_id"] if last else ["h", "doc_id", "size"]
        block = block.sort_values(order, kind="stable", na_position="last").reset_index(drop=True)
        first = block.iloc[0]
        name = f"{seed}|{first['source']!r}|{first['bucket']}|{last}"
        rng = random.Random(int.from_bytes(sha256(name.encode()).digest()[:8], "big"))
        size, p = [float(x) for x in block["size"]], block["p"].tolist()
        cut = max(0, len(p) - LANDING) if last else len(p)
        p = flight(p[:cut], size[:cut], rng) + p[cut:]
        block["p"] = landing(p, size) if last else p
        return block
    return run


def _in_runs(units: DataFrame, block: int) -> DataFrame:
    """The same rows with ``run``: rows that are equal to each other share a run with fewer than ``block`` others."""
    counted = units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block))))
    # the runs after the first of a hot row are spread before its rows are dealt out
    runs = runs.filter("run = 0").unionByName(runs.filter("run > 0").repartition("doc_id", "size", "run"))
    copies = F.least(F.lit(block).cast("long"), F.col("m") - F.col("run") * block)
    return runs.select("doc_id", "source", "size", "run", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("k")).drop("k")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                seed: int = 17, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) per document row."""
    units = materialise(_in_runs(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS + "+")).cast("long").alias("size")), block))
    sources = source_targets(units, weights, share, cap).withColumn("skey", F.xxhash64("source"))
    sources = materialise(sources.withColumn("p0", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                          .withColumn("p0", F.when(F.abs(F.col("p0") - F.round("p0")) < 1e-9, F.round("p0")).otherwise(F.col("p0"))))
    # the name stands in for itself by a null-safe text key
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    info = sources.withColumn("sk", key).select("sk", "n", "source_size", "target", "p0")
    rows = attach(units.withColumn("sk", key), info, ["sk"], "n")
    rows = (rows.withColumn("whole", F.floor("p0").cast("long")).withColumn("p", F.col("p0") - F.floor("p0"))
            .withColumn("h", F.when(F.col("run") == 0, F.xxhash64(F.lit(seed), "doc_id", "size"))
                        .otherwise(F.xxhash64(F.lit(seed), "doc_id", "size", "run"))).drop("run"))
    final = rows.filter(F.col("p") == 0).drop("n")
    open_ = rows.filter(F.col("p") > 0)
    cols = ["doc_id", "source", "size", "sk", "source_size", "target", "p0", "whole", "p", "h"]
    done = [final.select(cols)]
    while True:
        n = F.col("n")
        most = open_.groupBy("sk").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        last = most <= block
        buckets = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("h", F.lit(len(done))), F.ceil(n / block))
        walked = (open_.withColumn("bucket", buckets)
                  .groupBy("sk", "bucket").applyInPandas(_walk(seed, last), open_.withColumn("bucket", buckets).schema))
        walked = materialise(walked.drop("bucket"))
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(walked.filter(settled).select(cols))
        if last:
            break
        rest = materialise(walked.filter(~settled).drop("n"))
        counts = materialise(rest.groupBy("sk").agg(F.count("*").alias("n")))
        open_ = materialise(attach(rest, counts, ["sk"], "n"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.col("whole") + F.col("p").cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))
