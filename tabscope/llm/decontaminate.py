"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window). Both sides hash their k-grams and keep every k-gram that is the
smallest of some run of ``window - k + 1`` k-grams (winnowing), so any shared
window has a fingerprint that both sides keep. The two fingerprint tables are
joined and every hit is extended word by word to both sides, up to the
``window - k`` words that a window around it can reach; a hit that grows to
``window`` words is a shared span, and the union of a document's spans gives
the maximal ones. Items shorter than ``window`` have one fingerprint of all
their words, looked up at every document position.

Scale: document fingerprints are first tested against a bit set of the test
fingerprints (bounded size, sent as a literal), inside the scan; only the words
around those that pass leave the scan. Document texts are never shuffled. A hit
that extends far enough agrees in half of the missing words on its left or on
its right, so the join asks for that second key too, and a k-gram that many
items share does not pair with all of them. Keys above 1/1024 of all document
fingerprints (a passage in a third of all documents) are at most 1,024; they
are dealt out over as many salts as their share needs. From some 10^6 test
fingerprints on the bit set fills and more fingerprints leave the scan; results
stay whole.

Edge cases: a null text has no words; an item without words is never hit; an
item text given twice counts under both ids; rows repeating a doc_id are
judged one by one; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import ascii_lower, bit_set, has_bits, id_key, materialise, packed

#: All characters that are no part of a word, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 6
MAX_BITS = 22  # the bit set of test fingerprints never exceeds 2^22 bits (512 KB)
HOT_SHARE = 1024  # a key above this part of all document fingerprints is salted

_HITS = "array<struct<s:int,len:int,fp:bigint,mid:string,lw:array<string>,rw:array<string>>>"


def lower_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _grams(h: Column, k: int) -> Column:
    """Hash of the k word hashes from each position on."""
    n = F.size(h) - (k - 1)
    return F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))


def _leading(tests: list[Column]) -> Column:
    """How many of the tests hold before the first that does not (or is null)."""
    out = F.lit(0)
    for t in reversed(tests):
        out = F.when(t, out + 1).otherwise(F.lit(0))
    return out


def _kept(g: Column, x: Column, i: Column, run: int) -> Column:
    """Whether winnowing keeps k-gram ``x`` at ``i``: some run of ``run`` k-grams around it holds none smaller."""
    before = _leading([F.get(g, i - j) >= x for j in range(1, run)])
    after = _leading([F.get(g, i + j) >= x for j in range(1, run)])
    return before + after + 1 >= run


def winnow(g: Column, run: int, also=lambda x: F.lit(True)) -> Column:
    """Positions of the k-gram hashes that winnowing keeps, of those for which ``also`` holds."""
    at = F.transform(g, lambda x, i: F.when(also(x) & _kept(g, x, i, run), i))
    return F.filter(at, lambda i: i.isNotNull())


def _around(w: Column, g: Column, i: Column, k: int, reach: int) -> Column:
    """The k-gram at ``i`` with up to ``reach`` words on each side, nearest first."""
    first = F.greatest(i - reach, F.lit(0))
    return F.struct(i.cast("int").alias("s"), F.lit(k).alias("len"), F.get(g, i).alias("fp"),
                    F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("mid"),
                    F.reverse(F.slice(w, first + 1, i - first)).alias("lw"), F.slice(w, i + k + 1, F.lit(reach)).alias("rw"))


def _whole(w: Column, i: Column, n: int) -> Column:
    """The n words at ``i``, with nothing around them."""
    none = F.array().cast("array<string>")
    return F.struct(i.cast("int").alias("s"), F.lit(n).alias("len"), F.xxhash64(F.slice(F.col("h"), i + 1, F.lit(n))).alias("fp"),
                    F.array_join(F.slice(w, i + 1, F.lit(n)), " ").alias("mid"), none.alias("lw"), none.alias("rw"))


def _whole_hits(n: int, bits: int) -> Column:
    """The positions whose n words may be a whole item."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("h") - n, F.lit(0))),
                      lambda i: has_bits(F.col(f"bits{n}"), F.xxhash64(F.slice(F.col("h"), i + 1, F.lit(n))), bits))
    return F.transform(starts, lambda i: _whole(F.col("w"), i, n)).cast(_HITS)


def _hashed(df: DataFrame, k: int) -> DataFrame:
    """Adds word hashes ``h`` and k-gram hashes ``g`` to a table of words ``w``."""
    d = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return d.withColumn("g", _grams(F.col("h"), k))


def _keyed(hits: DataFrame, half: int) -> DataFrame:
    """One row per fingerprint and second key: the nearest ``half`` words on one side, nothing for whole items."""
    def key(side: int, c: str) -> Column:
        return F.when(F.size(c) >= half, F.struct(F.lit(side).alias("side"), F.xxhash64(F.slice(c, 1, half)).alias("near")))
    two = F.filter(F.array(key(0, "lw"), key(1, "rw")), lambda x: x.isNotNull())
    one = F.array(F.struct(F.lit(2).alias("side"), F.lit(0).cast("long").alias("near")))
    return hits.withColumn("key", F.explode(F.when(F.col("whole"), one).otherwise(two))).select("*", "key.*").drop("key")


def benchmark_prints(items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The benchmark's fingerprints: (item_id, whole, len, fp, mid, lw, rw); ``whole`` marks items shorter than a window."""
    w = _hashed(items.select("item_id", lower_words(F.col("text")).alias("w")).filter(F.size("w") > 0), k)
    kept = F.transform(winnow(F.col("g"), window - k + 1), lambda i: _around(F.col("w"), F.col("g"), i, k, window - k))
    found = F.when(F.size("w") >= window, kept.cast(_HITS))
    for n in range(1, window):
        found = found.when(F.size("w") == n, F.array(_whole(F.col("w"), F.lit(0), n)).cast(_HITS))
    return (w.select("item_id", (F.size("w") < window).alias("whole"), F.explode(found).alias("f"))
            .select("item_id", "whole", "f.len", "f.fp", "f.mid", "f.lw", "f.rw").distinct())


def _document_prints(docs: DataFrame, prints: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, text_hash, n_words, found) per row: the fingerprints that may stand in the benchmark."""
    fps = materialise(prints.select("whole", "len", "fp").distinct())
    lengths = sorted(r["len"] for r in fps.filter("whole").select("len").distinct().collect())  # fewer than ``window`` rows
    n_fp = fps.count()
    bits = max(10, min(MAX_BITS, (64 * n_fp).bit_length()))
    d = _hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), lower_words(F.col("text")).alias("w")), k)
    found, none = [], F.array().cast(_HITS)
    if fps.filter(~F.col("whole")).limit(1).count():
        d = d.withColumn("bits", bit_set(fps.filter(~F.col("whole")), "fp", bits))
        d = d.withColumn("at", winnow(F.col("g"), window - k + 1, lambda x: has_bits(F.col("bits"), x, bits)))
        hits = F.transform("at", lambda i: _around(F.col("w"), F.col("g"), i, k, window - k))
        found.append(F.when(F.size("h") >= window, hits.cast(_HITS)).otherwise(none))
    for n in lengths:
        d = d.withColumn(f"bits{n}", bit_set(fps.filter(F.col("whole") & (F.col("len") == n)), "fp", bits))
        found.append(F.when(F.size("h") >= n, _whole_hits(n, bits)).otherwise(none))
    return d.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("found"))


def _shared_spans(cand: DataFrame, prints: DataFrame, window: int, k: int) -> DataFrame:
    """(id, text_hash, item_id, s, e): fingerprints that meet one of the benchmark, extended; ``e`` is past the end."""
    need = window - k
    half = (need + 1) // 2
    on = ["whole", "len", "fp", "side", "near"]
    left, right = materialise(_keyed(cand, half)), _keyed(prints, half)
    counts = left.groupBy(*on).agg(F.count("*").alias("n"))
    total = left.count()
    hot = materialise(counts.filter(F.col("n") * HOT_SHARE > total)
                      .select(*on, F.ceil(F.col("n") * HOT_SHARE / F.lit(total)).alias("salts")))  # under HOT_SHARE rows
    salts = F.coalesce("salts", F.lit(1))
    left = left.join(F.broadcast(hot), on, "left").withColumn("salt", F.pmod(F.xxhash64("id", "text_hash", "s"), salts))
    right = (right.join(F.broadcast(hot), on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))))
    right = right.select(*on, "salt", "item_id", "mid", F.col("lw").alias("blw"), F.col("rw").alias("brw"))
    grown = left.join(right, [*on, "salt", "mid"])
    grown = grown.withColumn("l", _leading([F.get("lw", F.lit(j)) == F.get("blw", F.lit(j)) for j in range(need)]))
    grown = grown.withColumn("r", _leading([F.get("rw", F.lit(j)) == F.get("brw", F.lit(j)) for j in range(need)]))
    reaches = (F.col("l") + F.col("r") >= need) & F.when(F.col("side") == 0, F.col("l") >= half).otherwise(F.col("l") < half)
    return grown.filter(F.col("whole") | reaches).select(
        "id", "text_hash", "item_id", (F.col("s") - F.col("l")).alias("s"), (F.col("s") + F.col("len") + F.col("r")).alias("e"))


def _stretches(spans: DataFrame) -> DataFrame:
    """(id, text_hash, spans, n_hit): spans that overlap or touch made one, in order."""
    w = Window.partitionBy("id", "text_hash").orderBy("s", "e")
    d = spans.select("id", "text_hash", "s", "e").distinct()
    d = d.withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("part", F.sum(F.when(F.col("s") <= F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy("id", "text_hash", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return d.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"),
                                            F.sum(F.col("e") - F.col("s")).alias("n_hit"))


def decontamination_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids, spans) per document row.

    ``item_ids`` are sorted as text; ``spans`` are the maximal hit stretches as
    (first word, word past the last), and ``n_hit`` counts their words.
    """
    prints = materialise(benchmark_prints(items, window, k))
    slim = materialise(_document_prints(docs, prints, window, k))
    cand = slim.select(id_key().alias("id"), "text_hash", F.explode("found").alias("f")).select("id", "text_hash", "f.*")
    cand = cand.withColumn("whole", (F.size("lw") + F.size("rw") == 0) & (F.col("len") < window))
    spans = materialise(_shared_spans(cand, prints, window, k))
    by_item = spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    hits = _stretches(spans).join(by_item, ["id", "text_hash"])
    out = slim.select(id_key().alias("id"), "doc_id", "text_hash", "n_words")
    return out.join(hits, ["id", "text_hash"], "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"))


def keep_clean(docs: DataFrame, items: DataFrame, max_hit_share: float = 0.0) -> DataFrame:
    """Documents whose share of hit words is at most ``max_hit_share``, all columns."""
    bad = (decontamination_hits(docs, items).filter(F.col("n_hit") > F.lit(max_hit_share) * F.col("n_words"))
           .select(id_key().alias("id"), "text_hash").distinct())
    return (docs.select(id_key().alias("id"), F.xxhash64("text").alias("text_hash"), packed(docs))
            .join(bad, ["id", "text_hash"], "left_anti").select("row.*"))
