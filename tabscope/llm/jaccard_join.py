"""N-gram Jaccard join with grouped prefixes, and the classes that its links form.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``percent`` / 100. The steps:

1. equal sets (exact copies and the like) become one *unit*; a bounded sketch
   of hash cells that many documents share gives a first shingle order: rare
   first, then by hash. Shingles that this order puts into the prefixes of more
   than ``OFTEN`` documents are counted exactly and move behind all others, by
   their count, so that passages which many documents share leave the prefixes
   and index lists stay short however large the corpus;
2. a unit's *prefix* is its first ``n - ceil(t n) + 1`` shingles; linked units
   share one. Units with the same prefix and size form one *group*, and the
   inverted index holds groups, not documents;
3. in every index list one pivot is verified against the other members first.
   Large groups of near copies collapse into one class there, at a cost linear
   in their size;
4. lists that still hold several classes are expanded to their groups' members
   and joined; members meet if they pass the size, position and parity filters,
   and are verified exactly. Pairs inside one class are known to be connected
   and not formed, nor are pairs whose parity bits differ in too many places.

A set's bytes are recomputed from the text and shuffled for candidate units
only. Every step covers all documents; nothing is capped.

Edge cases: a text with fewer than ``gram`` words is one shingle; a text
without words (or null) has an empty set and links with nothing; rows that
repeat a doc_id are one document, linked through each of its texts; null ids
count as one id, the largest. Identity of shingles and units is by 64-bit hash.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import attach, bit_set, has_bits, id_back, id_key, materialise, narrow, packed
from tabscope.llm.components import components
from tabscope.llm.hashing import shingle_sets

CELL_BITS = 20
MIN_PARITY, MAX_PARITY = 512, 1 << 16
#: Longs of parity bits that rows carry into the join of lists; MIN_PARITY / 64.
FOLDED = 8
TOKEN_BITS = 25
SALTS = 16
#: Prefixes that a shingle may stand in before it moves behind rarer ones, and the hash cells of those that do.
OFTEN = 8
OFTEN_BITS = 22
ORDER_ROUNDS = 2


def _unit(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _scan_units(gram: int):
    """Rows (id, u, n) per document and (cell, c) for the hash cells that stand out in the partition."""
    def run(batches):
        cells, seen = np.zeros(1 << CELL_BITS, np.int64), 0
        for b in batches:
            units, sizes, found, pending = [], [], [], 0
            for s in shingle_sets(b.column(1), gram):
                units.append(_unit(s) if len(s) else None)
                sizes.append(len(s))
                found.append((s >> np.uint64(64 - CELL_BITS)).astype(np.int64))
                pending += len(s)
                if pending > 1 << 19:
                    cells += np.bincount(np.concatenate(found), minlength=len(cells))
                    found, seen, pending = [], seen + pending, 0
            if pending:
                cells += np.bincount(np.concatenate(found), minlength=len(cells))
                seen += pending
            none = pa.nulls(len(units), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units, pa.int64()), pa.array(sizes, pa.int64()), none, none],
                                             ["id", "u", "n", "cell", "c"])
        out = np.flatnonzero(cells >= max(3, 4 * seen / len(cells)))
        none = pa.nulls(len(out), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(out), pa.array(cells[out])], ["id", "u", "n", "cell", "c"])
    return run


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _tokens(s: np.ndarray, order: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
    """The rank of a shingle (8 bits) before 56 bits of its hash."""
    low, rank = s >> np.uint64(8), order[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    if often is not None:
        count = often[(low & np.uint64(len(often) - 1)).astype(np.int64)].astype(np.uint64)
        rank = np.where(count > 0, np.uint64(128) + count, rank)
    return (rank << np.uint64(56)) | low


def _scan_prefix_tokens(gram: int, percent: int, rank, frequent):
    """The shingles (56 bits) of all prefixes by the order known so far."""
    def run(batches):
        order, often = rank.value, frequent.value
        for b in batches:
            found = [np.empty(0, np.uint64)]
            for s in shingle_sets(b.column(0), gram):
                if len(s):
                    p = _prefix_size(len(s), percent)
                    found.append(np.partition(_tokens(s, order, often), p - 1)[:p])
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(found) & np.uint64((1 << 56) - 1)).view(np.int64))], ["token"])
    return run


def _often_cells(batches):
    """(cell, class) of frequent shingles; the class is the logarithm of their count."""
    for b in batches:
        cell = b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << OFTEN_BITS) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.log2(b.column(1).to_numpy()).astype(np.int32))], ["cell", "c"])


def _scan_prefixes(gram: int, percent: int, rank, frequent):
    """Rows (u, n, prefix, bits); tokens as in ``_tokens``.

    ``bits`` holds the parity of the number of shingles per low hash bits, at
    about one bit per shingle: two sets differ in at least as many shingles as
    their bits differ in places. A longer field folds to a shorter one by xor.
    """
    def run(batches):
        order, often = rank.value, frequent.value
        for b in batches:
            units, sizes, prefixes, parity = [], [], [], []
            for s in shingle_sets(b.column(0), gram):
                if not len(s):
                    continue
                token = _tokens(s, order, often)
                p = _prefix_size(len(s), percent)
                units.append(_unit(s))
                sizes.append(len(s))
                prefixes.append(np.sort(np.partition(token, p - 1)[:p]).view(np.int64))
                width = min(MAX_PARITY, max(MIN_PARITY, 1 << len(s).bit_length()))
                parity.append(np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes())
            off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(units, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(values)),
                pa.array(parity, pa.binary())], ["u", "n", "prefix", "bits"])
    return run


def _shared_tokens(seen):
    """Index rows (token, pos, n, g, score) of tokens whose bit is set; score counts them in the prefix."""
    def run(batches):
        bits = seen.value
        for b in batches:
            prefix = b.column(2)
            token, parent = prefix.flatten().to_numpy(), pa.compute.list_parent_indices(prefix).to_numpy()
            off = prefix.offsets.to_numpy()
            pos = np.arange(len(token)) - (off[:-1] - off[0])[parent]
            at = (token.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TOKEN_BITS)
            keep = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
            rows = parent[keep]
            score = np.bincount(rows, minlength=len(b)).astype(np.int32)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(pos[keep].astype(np.int32)), b.column(1).take(pa.array(rows)),
                                              b.column(0).take(pa.array(rows)), pa.array(score)], ["token", "pos", "n", "g", "score"])
    return run


def _token_bits(batches):
    """(word, bits) of the tokens of one partition."""
    bits = np.zeros(1 << (TOKEN_BITS - 6), np.uint64)
    for b in batches:
        at = (b.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TOKEN_BITS)
        np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    word = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], ["word", "bits"])


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def _folded(batches):
    """(u, q0, q1, ...): the parity bits folded to ``FOLDED`` longs."""
    for b in batches:
        q = np.array([_fold(np.frombuffer(x.as_buffer(), np.uint8), 8 * FOLDED).view(np.int64) for x in b.column(1)]).reshape(-1, FOLDED)
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(q[:, j])) for j in range(FOLDED)]],
                                         ["u", *[f"q{j}" for j in range(FOLDED)]])


def _plausible(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for n, m, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
                need = -(-percent * (n + m) // (100 + percent))
                keep.append(apart <= n + m - 2 * need)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _scan_sets(gram: int):
    def run(batches):
        for b in batches:
            found = [(_unit(s), s.tobytes()) for s in shingle_sets(b.column(0), gram) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], ["u", "s"])
    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


class _Join:
    def __init__(self, docs: DataFrame, gram: int, percent: int):
        self.gram, self.percent, self.spark = gram, percent, docs.sparkSession
        self.docs = docs.select(id_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def scan(self) -> None:
        rows = materialise(self.docs.mapInArrow(_scan_units(self.gram), "id long, u long, n long, cell long, c long"))
        members = rows.filter("cell is null").select("id", "u", "n")
        self.members = narrow(members, members.count())
        rank = np.zeros(1 << CELL_BITS, np.uint8)
        heavy = rows.filter("cell is not null").groupBy("cell").agg(F.sum("c").alias("c"))
        for r in heavy.select("cell", F.floor(F.log2("c")).alias("r")).toLocalIterator():  # at most 2^CELL_BITS rows
            rank[r["cell"]] = min(127, r["r"])
        self.rank = self.spark.sparkContext.broadcast(rank)  # 1 MB
        units = materialise(self.members.filter("u is not null").groupBy("u").agg(
            F.min("id").alias("id"), F.count("*").alias("n_rows"), F.first("n").alias("n")))
        self.n_units = units.count()
        self.units = narrow(units, self.n_units)

    def frequent(self):
        """Broadcast classes of the shingles that many prefixes hold, by hash cell: 4 MB whatever the input.

        Shingles that move back let others of the same passage into the
        prefixes, so the next round counts the prefixes by the new order.
        """
        classes = np.zeros(1 << OFTEN_BITS, np.uint8)
        for _ in range(ORDER_ROUNDS):
            known = self.spark.sparkContext.broadcast(classes)
            tokens = self.docs.select("text").mapInArrow(_scan_prefix_tokens(self.gram, self.percent, self.rank, known), "token long")
            often = tokens.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > OFTEN)
            cells = often.mapInArrow(_often_cells, "cell int, c int").groupBy("cell").agg(F.max("c").alias("c")).toArrow()
            classes = classes.copy()
            at = cells.column("cell").to_numpy()
            classes[at] = np.maximum(classes[at], np.minimum(cells.column("c").to_numpy(), 126).astype(np.uint8))
        return self.spark.sparkContext.broadcast(classes)

    def index(self) -> None:
        rows = self.docs.select("text").mapInArrow(_scan_prefixes(self.gram, self.percent, self.rank, self.frequent()), "u long, n long, prefix array<long>, bits binary")
        rows = rows.groupBy("u").agg(*[F.first(c).alias(c) for c in ("n", "prefix", "bits")])
        rows = materialise(rows.select("u", F.xxhash64("prefix", "n").alias("g"), "n", "prefix", "bits"))
        self.bits = rows.select("u", "n", "bits")
        self.in_group = narrow(materialise(rows.select("u", "g", "n")), self.n_units)
        # a group is indexed once, by its first member
        several = self.in_group.groupBy("g").agg(F.min("u").alias("first"), F.count("*").alias("w")).filter("w > 1")
        others = materialise(narrow(self.in_group.join(several, "g").filter("u <> first").select("u"), self.n_units))
        others = F.broadcast(others) if others.count() <= 1 << 15 else others
        groups = rows.select("u", "g", "n", "prefix").join(others, "u", "left_anti").select("g", "n", "prefix")
        shared = groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("lists")).filter("lists > 1")
        shared = materialise(shared)
        words = shared.select("token").mapInArrow(_token_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        seen = np.zeros(1 << (TOKEN_BITS - 6), np.uint64)  # 4 MB whatever the input
        seen[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
        seen = self.spark.sparkContext.broadcast(seen)
        index = materialise(groups.mapInArrow(_shared_tokens(seen), "token long, pos int, n long, g long, score int"))
        self.lists = materialise(attach(index, shared, ["token"], "lists").select("token", "pos", "n", "g", "score"))

    def overlap(self, n, m):
        """The shingles that linked sets of sizes n and m share at least."""
        return F.ceil(F.lit(self.percent) * (n + m) / F.lit(100 + self.percent) - F.lit(1e-9))

    def near(self, x: str, y: str):
        """Size and position filters on columns n and pos of two index rows."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        return ((100 * n >= self.percent * m) & (100 * m >= self.percent * n)
                & (F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos")) >= self.overlap(n, m)))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose parity bits differ in no more places than linked sets may differ in shingles."""
        for side in ("a", "b"):
            bits = self.bits.select(F.col("u").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}"))
            known = pairs.groupBy(side).agg(F.count("*").alias("w")).join(bits, side)
            known = materialise(known)
            pairs = materialise(attach(pairs, known, [side], "w").drop("w"))
        return pairs.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_plausible(self.percent), "a long, b long")

    def sets_of(self, units: DataFrame, name: str, size: int) -> DataFrame:
        """Shingle sets of the units (and of a few more documents), recomputed from the texts."""
        wanted = units.join(self.units.select("u", "id"), "u").select(F.xxhash64("id").alias("h"))
        wanted = materialise(narrow(wanted, size))
        bits = max(10, min(24, (16 * wanted.count()).bit_length()))
        texts = self.docs.filter(has_bits(bit_set(wanted, "h", bits), F.xxhash64("id"), bits)).select("text")
        return texts.mapInArrow(_scan_sets(self.gram), f"{name} long, s{name} binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct unit pairs (a, b); a is the side with few, much used units."""
        pairs = materialise(pairs)
        pairs = materialise(self.plausible(narrow(pairs, pairs.count())))
        size = pairs.count()
        if not size:
            return pairs
        pairs = narrow(pairs, size)
        pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
        left, right = (pairs.select(F.col(c).alias("u")).distinct() for c in ("a", "b"))
        first = pairs.join(self.sets_of(right, "b", size), "b")
        second = pairs.select("a", "salt").distinct().join(self.sets_of(left, "a", size), "a")
        both = first.join(second, ["a", "salt"])
        return both.select("a", "b", "sa", "sb").mapInArrow(_verify(self.percent), "a long, b long")

    def pivot_pairs(self) -> DataFrame:
        """In every list and size class: the member that shares most tokens, with each other member."""
        first = self.in_group.groupBy("g").agg(F.min("u").alias("u"), F.count("*").alias("m"))
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(self.percent / 100)) if self.percent < 100 else 1e-9)).cast("long")
        rows = self.lists.withColumn("k", size)
        best = rows.groupBy("token", "k").agg(F.max(F.struct("score", "g", "n", "pos")).alias("p"), F.count("*").alias("w"))
        best = materialise(best.filter("w > 1").select("token", "k", "w", F.col("p.g").alias("pg"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos")))
        both = attach(rows, best, ["token", "k"], "w").filter("g <> pg")
        both = both.select(F.struct("n", "pos").alias("x"), F.struct(F.col("pn").alias("n"), F.col("ppos").alias("pos")).alias("y"), "g", "pg")
        across = materialise(both.filter(self.near("x", "y")).select("pg", "g").distinct())
        unit = first.select("g", F.col("u").alias("b"))
        across = across.join(unit, "g").join(unit.select(F.col("g").alias("pg"), F.col("b").alias("a")), "pg").select("a", "b")
        # members of one group: its first member with each other one
        inside = self.in_group.join(first.filter("m > 1").select("g", F.col("u").alias("a")), "g").filter("u <> a").select("a", F.col("u").alias("b"))
        return across.unionByName(inside).distinct()

    def apart(self, x: str, y: str):
        """Places in which the folded parity bits of two rows differ."""
        return sum((F.bit_count(F.col(f"{x}.q{j}").bitwiseXOR(F.col(f"{y}.q{j}"))) for j in range(FOLDED)), F.lit(0))

    def rest_pairs(self, comp: DataFrame) -> DataFrame:
        """Unit pairs of different classes whose groups share a token and that pass the filters.

        The parity bits, folded to a few longs, are compared in the join: pairs
        of near copies that stay below the threshold are not formed.
        """
        unit = self.in_group.join(comp.withColumnRenamed("node", "u"), "u", "left").withColumn("comp", F.coalesce("comp", "u"))
        unit = materialise(narrow(unit, self.n_units))
        nodes = unit.groupBy("g", "comp").agg(F.count("*").alias("m"))
        rows = self.lists.drop("score").join(nodes, "g")
        mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("w")).filter("lo <> hi")
        mixed = materialise(mixed.select("token", "w"))
        rows = materialise(attach(materialise(rows), mixed, ["token"], "w").select("token", "pos", "n", "g", "comp"))
        folded = self.bits.select("u", "bits").mapInArrow(_folded, "u long, " + ", ".join(f"q{j} long" for j in range(FOLDED)))
        # units of one group that fell into different classes; sets that must agree in every shingle are one unit already
        several = nodes.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g")
        same = unit.filter(self.overlap(F.col("n"), F.col("n")) < F.col("n")).join(several, "g").select("g", "n", "comp", "u")
        wanted = rows.select("g", "comp").distinct().join(unit.select("g", "comp", "u"), ["g", "comp"]).select("u").unionByName(same.select("u")).distinct()
        folded = materialise(folded.join(wanted, "u"))
        q = [f"q{j}" for j in range(FOLDED)]
        members = materialise(folded.join(unit.select("u", "g", "comp"), "u"))
        rows = materialise(rows.join(members, ["g", "comp"]).select("token", "pos", "n", "comp", "u", *q))
        x, y = rows.alias("x"), rows.alias("y")
        n, m = F.col("x.n"), F.col("y.n")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") < F.col("y.comp")) & self.near("x", "y")
                       & (self.apart("x", "y") <= n + m - 2 * self.overlap(n, m)))
        pairs = pairs.select(F.col("x.u").alias("a"), F.col("y.u").alias("b"))
        same = same.join(folded, "u")
        s, t = same.alias("s"), same.alias("t")
        n = F.col("s.n")
        same = s.join(t, (F.col("s.g") == F.col("t.g")) & (F.col("s.comp") < F.col("t.comp")) & (self.apart("s", "t") <= 2 * (n - self.overlap(n, n))))
        return pairs.unionByName(same.select(F.col("s.u").alias("a"), F.col("t.u").alias("b"))).distinct()

    def classes(self) -> DataFrame:
        """(node, comp) over units with a link."""
        self.scan()
        self.index()
        # texts of one repeated id belong together
        several = self.members.filter("u is not null").groupBy("id").agg(F.min("u").alias("a"), F.max("u").alias("z")).filter("a <> z")
        same_id = self.members.filter("u is not null").join(several.select("id", "a"), "id").select("a", F.col("u").alias("b")).filter("a <> b")
        links = materialise(self.verified(self.pivot_pairs()).unionByName(same_id))
        comp = components(links)
        more = materialise(self.verified(self.rest_pairs(comp)))
        return components(links.unionByName(more)) if more.head(1) else comp


def jaccard_classes(docs: DataFrame, gram: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id, unit) per document row; unit is the hash of the shingle set."""
    join = _Join(docs, gram, percent)
    comp = join.classes()
    units = join.units.join(comp.withColumnRenamed("node", "u"), "u", "left").withColumn("comp", F.coalesce("comp", "u"))
    units = materialise(narrow(units.select("u", "id", "n_rows", "comp"), join.n_units))
    least = materialise(narrow(units.groupBy("comp").agg(F.min("id").alias("component"), F.count("*").alias("w")), join.n_units))
    units = materialise(narrow(attach(units, least, ["comp"], "w").select("u", "n_rows", "component"), join.n_units))
    linked = attach(join.members.filter("u is not null"), units, ["u"], "n_rows").select("id", "n", "component", "u")
    empty = join.members.filter("u is null").select("id", "n", F.col("id").alias("component"), "u")
    return linked.unionByName(empty).select(id_back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                                            id_back(F.col("component")).alias("component_id"), F.col("u").alias("unit"))


def keep_one(docs: DataFrame, gram: int = 5, percent: int = 80) -> DataFrame:
    """The documents with the smallest id of their class, all columns."""
    gone = jaccard_classes(docs, gram, percent).select(id_key("doc_id").alias("id"), id_key("component_id").alias("c"))
    gone = gone.filter("id <> c").select("id").distinct()
    return docs.select(id_key().alias("id"), packed(docs)).join(gone, "id", "left_anti").select("row.*")
