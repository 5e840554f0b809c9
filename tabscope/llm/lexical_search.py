"""Ranked lexical search by pipelined term partitioning.

The inverted index of the queries' terms is split by term among a few owners:
the rarest terms, which weigh most, belong to the first owner, and every owner
has about the same number of postings. A bundle of items visits the owners in
turn. It carries, per block of documents, the documents with a score so far
and their integer sums (sparse accumulators); at each owner the bundle's block
is cogrouped with the owner's postings of that block, whose contributions are
added, and travels on. After the last owner the best documents are selected.

Exact pruning: after every stage the k-th best sum so far of an item is a lower
bound of its final k-th score, and the largest contribution of every term still
to come bounds what a document can gain. A document that cannot reach the bound
is dropped, and once documents not seen yet cannot reach it, none is added.
Nothing else limits the accumulators.

Blocks are runs of scanned documents with a bounded number of documents and
postings; an owner's postings of a block are one row of packed arrays, and so
is a bundle's block, so groups are bounded whatever terms are common. Only the
queries' vocabulary, its counts and the items' bounds (bounded by the bundle)
reach the driver and the tasks; larger query sets are answered bundle by bundle.

Edge cases: a null or empty text has no term and is never found; an item
without terms has no row; rows that repeat a doc_id are ranked one by one; a
null doc_id comes last among equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm.common import NULL_ID, id_back, id_key, materialise
from tabscope.session import ensure_checkpoint_dir

K = 20
OWNERS = 4
BUNDLE = 256
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1 << 20
PIECE = 8 << 20

_SOLID = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _SOLID else 32 for c in range(256))


def terms_of(text: str | None) -> list[str]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_FOLD).decode().split(" ")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def _cuts(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Runs of at least one row whose sizes sum to about ``limit``."""
    at, lo, out = np.concatenate([[0], np.cumsum(sizes)]), 0, []
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


# ---- index ---------------------------------------------------------------

def _count_terms(vocabulary: pa.Array):
    """Per run of documents: lengths, and (document, term, tf) of the queried terms, packed."""
    def run(batches):
        for b in batches:
            raw = b.column(1).cast(pa.binary())
            for lo, hi in _cuts(pc.fill_null(pc.binary_length(raw), 0).to_numpy(), PIECE):
                texts = [(t.as_py() or b"").translate(_FOLD) for t in raw.slice(lo, hi - lo)]
                split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
                words = split.flatten()
                bounds = split.offsets.to_numpy()
                solid = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
                length = np.diff(np.concatenate([[0], np.cumsum(solid)])[bounds])
                coded = words.dictionary_encode()
                code = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                hit = code >= 0
                key, tf = np.unique(doc[hit] * len(vocabulary) + code[hit], return_counts=True)
                doc, term = key // len(vocabulary), key % len(vocabulary)
                ids = b.column(0).slice(lo, hi - lo).to_numpy()
                per = np.bincount(doc, minlength=hi - lo)
                ends = np.cumsum(per)
                rows = []
                a = 0
                while a < hi - lo:  # blocks of bounded documents and postings
                    c = min(hi - lo, a + BLOCK_DOCS, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_POSTINGS, "right"))))
                    s = slice(int(ends[a - 1]) if a else 0, int(ends[c - 1]))
                    rows.append((ids[a:c].astype("<i8").tobytes(), length[a:c].astype("<i8").tobytes(), (doc[s] - a).astype("<u2").tobytes(),
                                 term[s].astype("<u4").tobytes(), tf[s].astype("<i4").tobytes()))
                    a = c
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows)], ["ids", "lengths", "doc", "term", "tf"])
    return run


def _frequencies(n_terms: int):
    """(term, df) of this task, and its documents and their terms at -1 and -2."""
    def run(batches):
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            for length, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                length = np.frombuffer(length, "<i8")
                n, total = n + int((length > 0).sum()), total + int(length.sum())
                df += np.bincount(np.frombuffer(term, "<u4"), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]])), pa.array(np.concatenate([df[used], [n, total]]))], ["term", "n"])
    return run


def _postings(weight: np.ndarray, owner: np.ndarray, n_docs: int, total: int):
    """One row per block and owner: documents and terms with their contributions."""
    owners = int(owner.max()) + 1

    def run(batches):
        for b in batches:
            rows = []
            for block, ids, length, doc, term, tf in zip(*(b.column(k).to_pylist() for k in range(6))):
                length, doc = np.frombuffer(length, "<i8"), np.frombuffer(doc, "<u2")
                term, tf = np.frombuffer(term, "<u4"), np.frombuffer(tf, "<i4").astype(np.int64)
                m = 75 + 25 * length * n_docs // max(1, total)
                gain = contributions(weight[term], tf, m[doc])
                own = np.where(gain > 0, owner[term], -1)
                for o in range(owners):
                    at = np.flatnonzero(own == o)
                    if len(at):
                        at = at[np.argsort(term[at], kind="stable")]
                        rows.append((o, block, ids, doc[at].tobytes(), term[at].tobytes(), gain[at].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.int64()] + [pa.binary()] * 4)],
                                                 ["owner", "block", "ids", "doc", "term", "gain"])
    return run


def _best_gains(n_terms: int):
    def run(batches):
        best = np.zeros(n_terms, np.int64)
        for b in batches:
            for term, gain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                np.maximum.at(best, np.frombuffer(term, "<u4"), np.frombuffer(gain, "<i8"))
        used = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(best[used])], ["term", "gain"])
    return run


# ---- the pipeline of owners ----------------------------------------------

_CARRIED = "block long, ids binary, slot binary, score binary"


def _visit(uses: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bound: np.ndarray, ahead: np.ndarray, after: np.ndarray):
    """Cogrouped function of one owner: carried accumulators of a block plus the owner's postings.

    ``bound``: each item's k-th best sum so far; ``ahead`` and ``after``: what
    the terms of this and later owners, or of later owners alone, can add.
    """
    n_items = len(bound)
    opens = (ahead >= bound) & (ahead > 0)
    by_term = {int(t): (items, times) for t, items, times in uses}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        block, ids = some.column("block")[0].as_py(), some.column("ids")[0].as_py()
        sums = np.zeros((len(ids) // 8, n_items), np.int64)
        if left.num_rows:
            sums.reshape(-1)[np.frombuffer(left.column("slot")[0].as_py(), "<u4")] = np.frombuffer(left.column("score")[0].as_py(), "<i8")
        carried = sums > 0
        for r in range(right.num_rows):
            doc = np.frombuffer(right.column("doc")[r].as_py(), "<u2")
            term = np.frombuffer(right.column("term")[r].as_py(), "<u4")
            gain = np.frombuffer(right.column("gain")[r].as_py(), "<i8")
            edge = np.flatnonzero(np.diff(term, prepend=-1))
            for a, z in zip(edge, [*edge[1:], len(term)]):
                items, times = by_term[int(term[a])]
                sums[doc[a:z, None], items] += gain[a:z, None] * times
        alive = (sums > 0) & (carried | opens) & (sums + after >= bound)
        slot = np.flatnonzero(alive)
        out = pa.table({"block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.binary()),
                        "slot": pa.array([slot.astype("<u4").tobytes()], pa.binary()),
                        "score": pa.array([sums.reshape(-1)[slot].tobytes()], pa.binary())})
        return out if len(slot) else out.slice(0, 0)
    return run


def _best(n_items: int, k: int):
    """The k best (item, id, score) of this task's blocks, by score and then id."""
    def run(batches):
        item, doc, score = (np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            for ids, slot, got in zip(*(b.column(c).to_pylist() for c in range(3))):
                slot = np.frombuffer(slot, "<u4").astype(np.int64)
                item = np.concatenate([item, slot % n_items])
                doc = np.concatenate([doc, np.frombuffer(ids, "<i8")[slot // n_items]])
                score = np.concatenate([score, np.frombuffer(got, "<i8")])
                order = np.lexsort((doc, -score, item))
                item, doc, score = item[order], doc[order], score[order]
                first = np.searchsorted(item, item)
                keep = np.arange(len(item)) - first < k
                item, doc, score = item[keep], doc[keep], score[keep]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (item, doc, score)], ["item", "id", "score"])
    return run


def _search_bundle(docs: DataFrame, queries: list[Counter], k: int, owners: int, out: str) -> DataFrame:
    """(item, doc_id, score, rank): ``item`` is the place of the query in the bundle."""
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*queries))
    code = {t: j for j, t in enumerate(vocabulary)}
    counted = materialise(docs.select(id_key().alias("id"), "text").mapInArrow(
        _count_terms(pa.array(vocabulary, pa.string())), "ids binary, lengths binary, doc binary, term binary, tf binary"))
    sums = {r["term"]: r["n"] for r in counted.select("lengths", "term").mapInArrow(
        _frequencies(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, total = sums.get(-1, 0), sums.get(-2, 0)
    df = np.array([sums.get(j, 0) for j in range(len(vocabulary))])
    weight = np.array([term_weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
    order = np.argsort(-weight, kind="stable")
    owner = np.empty(len(vocabulary), np.int64)
    load = np.cumsum(df[order])
    owner[order] = np.minimum(owners - 1, (load - df[order]) * owners // max(1, int(load[-1])))
    rows = counted.withColumn("block", F.monotonically_increasing_id()).select("block", "ids", "lengths", "doc", "term", "tf")
    rows.mapInArrow(_postings(weight, owner, n_docs, total), "owner int, block long, ids binary, doc binary, term binary, gain binary").write.partitionBy("owner").parquet(out)
    index = spark.read.schema("block long, ids binary, doc binary, term binary, gain binary, owner int").parquet(out)
    best = np.zeros(len(vocabulary), np.int64)
    for r in index.select("term", "gain").mapInArrow(_best_gains(len(vocabulary)), "term long, gain long").groupBy("term").agg(F.max("gain").alias("gain")).collect():
        best[r["term"]] = r["gain"]

    n = len(queries)
    uses: list[list] = [[] for _ in range(owners)]
    gains = np.zeros((owners, n), np.int64)
    for t, j in code.items():
        items = np.array([i for i, q in enumerate(queries) if t in q])
        times = np.array([queries[i][t] for i in items], np.int64)
        uses[owner[j]].append((j, items, times))
        gains[owner[j], items] += best[j] * times
    carried = spark.createDataFrame([], _CARRIED)
    bound = np.ones(n, np.int64)
    for stage in range(owners):
        step = _visit(uses[stage], bound, gains[stage:].sum(0), gains[stage + 1:].sum(0))
        postings = index.filter(F.col("owner") == stage).drop("owner")
        carried = materialise(carried.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(step, _CARRIED))
        top = carried.select("ids", "slot", "score").mapInArrow(_best(n, k), "item long, id long, score long")
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
        if stage < owners - 1:
            for r in ranked.filter(F.col("rank") == k).select("item", "score").collect():  # one row per item
                bound[r["item"]] = max(1, r["score"])
    return ranked.select("item", id_back(F.col("id")).alias("doc_id"), "score", "rank")


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = K, owners: int = OWNERS, bundle: int = BUNDLE) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every query row (item_id, text)."""
    spark = docs.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"
    kind = queries.schema["item_id"].dataType
    out = spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    listed = queries.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    nth, rows = 0, []

    def answer() -> DataFrame:
        asked = [(r["item_id"], Counter(t for t in terms_of(r["text"]) if t)) for r in rows]
        asked = [(i, q) for i, q in asked if q]
        if not asked:
            return out
        found = _search_bundle(docs, [q for _, q in asked], k, owners, f"{base}/{nth}")
        names = spark.createDataFrame(list(enumerate(i for i, _ in asked)), f"item long, item_id {kind.simpleString()}")
        return out.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))

    for r in listed:
        rows.append(r)
        if len(rows) == bundle:
            out, nth, rows = answer(), nth + 1, []
    return answer()
