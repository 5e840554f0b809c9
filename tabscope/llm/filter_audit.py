"""Filter interaction audit: what each filter removes in every order of the filters.

One pass over the texts gives each document a bit mask of the filters that it
fails by itself. Whether its text repeats a smaller id's is found in two steps:

* prepass: every text hash sets a few cells of a counting Bloom sketch. Tasks
  count their own cells (map-side partial counts), the exchange merges them.
  A text with a cell that only it set is unique for certain. The number of
  cells follows the number of rows; what travels to the scan is the bit set of
  cells counted twice or more, folded to at most 2^``max_bits`` bits. Folding
  can only let more texts through, never clear a repeated one. The driver gets
  the set as at most 512 pieces of 4 kB and hands it to the tasks as bytes inside
  a function: in an expression every plan and every text of a plan would copy it.
* only the possible repeats are shuffled, with their full text, to find the
  smallest id of every equal text; the hot text is one row per map task. The
  result is slim (id, two text hashes) and joins back by id first, so the
  hashes only tell apart rows that share an id.

Documents are then counted by (part, mask), and every order is answered from
those at most 2^filters numbers a part: a document is removed by the first of
its failing filters. Counts are additive, so parts can be summed.

Edge cases: a null text is the empty text, a null ``part`` the empty string; a
null id is larger than any other and equal to itself, so rows that repeat an id
and text all pass the repeat filter together if that id is the smallest; labels
that repeat an id count if any of them does; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import id_key, materialise

NAMES = "ABCDE"
PROBES = 3
CELLS_A_ROW = 8
MAX_BITS = 24
#: Bits of a piece of the bit set, as ``bitmap_construct_agg`` makes them.
PIECE_BITS = 15
PIECE = 1 << 20

_UPPER = bytes(range(65, 91))
_TAIL = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def _words(text: bytes) -> tuple[int, int]:
    """Words and distinct words; long texts are cut at white space, so only the distinct words stay in memory."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = at + PIECE
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        words = text[at:cut].split()
        n += len(words)
        seen.update(words)
        at = cut
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: under 200 words, few distinct words, many capitals, a character of #$%&*|."""
    n, distinct = _words(text)
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _TAIL))
    return ((n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * points) << 2
            | (len(text.translate(None, _MARKS)) < len(text)) << 3)


def _masks(mask: Callable[[bytes], int]):
    def run(batches):
        for b in batches:
            got = [mask(t.as_py()) for t in b.column(b.num_columns - 1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.int32())],
                                             [*b.schema.names[:-1], "mask"])
    return run


def _cells(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(h, F.lit(j)), 64 - bits) for j in range(PROBES)]


def possible_repeats(hashes: DataFrame, max_bits: int = MAX_BITS) -> Callable[[Column], Column]:
    """A predicate on text hashes that is false only for those that ``hashes.h`` holds once."""
    bits = max(10, (CELLS_A_ROW * hashes.count()).bit_length())
    cells = hashes.select(F.explode(F.array_distinct(F.array(*_cells(F.col("h"), bits)))).alias("cell"))
    often = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    folded = min(bits, max_bits)
    place = F.col("cell").bitwiseAND(F.lit((1 << folded) - 1))
    pieces = (often.select(place.alias("b")).groupBy(F.shiftright("b", PIECE_BITS).cast("int").alias("w"))
              .agg(F.bitmap_construct_agg(F.col("b").bitwiseAND(F.lit((1 << PIECE_BITS) - 1))).alias("v")))
    size = 1 << PIECE_BITS - 3
    bitset = np.zeros(size << max(0, folded - PIECE_BITS), np.uint8)
    for r in pieces.collect():  # at most 2^(max_bits - PIECE_BITS) rows
        bitset[r["w"] * size:(r["w"] + 1) * size] = np.frombuffer(r["v"], np.uint8)
    held = _holds(bitset)

    def test(h: Column) -> Column:
        return held(*[c.bitwiseAND(F.lit((1 << folded) - 1)).cast("int") for c in _cells(h, bits)])
    return test


def _holds(bitset: np.ndarray):
    """A column function: are the bits at all of these places set?"""
    @F.arrow_udf("boolean")
    def held(*places: pa.Array) -> pa.Array:
        every = np.ones(len(places[0]), bool)
        for p in places:
            at = p.to_numpy(zero_copy_only=False)
            every &= bitset[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return pa.array(every)
    return held


def document_masks(docs: DataFrame, part: str = "lang", mask: Callable[[bytes], int] = text_mask, own: int = 4,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """(id, part, mask, n): documents by id and failed filters; bit ``own`` says that a smaller id has the same text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    full = docs.select(id_key().alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))
    slim = materialise(full.mapInArrow(_masks(mask), "id long, part string, h long, g long, mask int"))
    maybe = possible_repeats(slim, max_bits)
    firsts = (full.filter(maybe(F.col("h"))).groupBy("text").agg(F.min("id").alias("id"))
              .select("id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.lit(0).alias("own")))
    rows = slim.groupBy("id", "part", "mask", "h", "g").agg(F.count("*").alias("n"))
    repeats = (rows.filter(maybe(F.col("h"))).join(firsts, ["id", "h", "g"], "left")
               .withColumn("own", F.coalesce("own", F.lit(1 << own))))
    rows = rows.filter(~maybe(F.col("h"))).withColumn("own", F.lit(0)).unionByName(repeats)
    return rows.select("id", "part", F.col("mask").bitwiseOR(F.col("own")).alias("mask"), "n")


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive document counts."""
    marks = (labels.filter(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("q"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("t")))
    rows = masks.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).join(marks, "id", "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("q", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("t", F.lit(0))).alias("toxic"))


def interaction_report(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step; every number is a sum over mask counts."""
    k = len(names)
    masks = range(1 << k)
    per = counts.groupBy("part").agg(*[
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in masks]).alias(c)
        for c in ("n", "good", "toxic")])
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append({"filter_order": "".join(names[i] for i in order), "step": step, "f": 1 << f, "before": before})
            before |= 1 << f
    kind = "array<struct<filter_order: string, step: int, f: int, before: int>>"
    rows = per.select("*", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))

    def total(values: str, keep: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        pairs = F.transform(values, lambda v, m: F.when(keep(m), v * weight(m)).otherwise(F.lit(0)))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, v: a + v)

    f, before = F.col("f"), F.col("before")
    fails = lambda m: m.bitwiseAND(f) != 0
    untouched = lambda m: m.bitwiseAND(before) == 0
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: untouched(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: untouched(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~untouched(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == f).alias("unique_fails"),
        total("good", lambda m: untouched(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: untouched(m) & fails(m)).alias("toxic_lost"),
        # of the orders, one in every bit_count(mask) has the filter first among those that fail
        total("n", fails, lambda m: F.floor(F.lit(factorial(k)) / F.greatest(F.bit_count(m), F.lit(1)))).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The report of the five filters over ``docs``."""
    return interaction_report(materialise(mask_counts(document_masks(docs, part), labels)))
