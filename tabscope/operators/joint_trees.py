"""Joint growth of many trees over one packed table (forests, bagging, boosting).

The training rows are binned once and packed in blocks of some 2^15 rows: one
record holds the bins of a block feature by feature, its labels, row hashes and
the state of a boosting loop as bytes. The table is checkpointed, so the plan of
every later job is "scan the blocks, one Arrow pass, one aggregation", however
many trees exist already, and the passes run on contiguous columns.

A level of all trees is one job. Tasks route their rows through the splits made
so far (small arrays that travel with the function), add up a histogram over
(open node, feature, bin) in numpy and emit its cells; Spark sums the cells and
the best cut of every node is found per node from its summed histogram, with
the left-hand sums, so children need no extra pass. Cells per task are bounded:
levels with more open nodes are split into several jobs over groups of nodes.

Bootstrap counts and the features a node may use are functions of hashes of
(seed, tree, row) and (seed, tree, node): nothing is stored per tree and row,
and a lost executor recomputes the same numbers.
"""

from __future__ import annotations

import math
import sys
import threading
import weakref
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators.trees import EPS, Node, TreeModel, _impurity_py
from tabscope.session import ensure_checkpoint_dir

for _module in (__name__, "tabscope.operators.trees"):  # executors need numpy and pyarrow, but no copy of this package
    cloudpickle.register_pickle_by_value(sys.modules[_module])

#: Histogram cells that a task holds at most per statistic.
CELLS = 1 << 21
#: Packed rows that one task takes at least; small tables would else pay for their number of tasks.
PART_ROWS = 1 << 14
#: Packed rows that one task takes at most, if every core has a task; a task's start costs as much as some 2^18 rows.
PART_MOST = 1 << 21
#: Bytes of an Arrow batch of blocks. By default all blocks of a task would stand in one, copied while it grows.
BATCH_BYTES = "2m"
#: Rows of a block, the unit that is packed and worked on.
BLOCK_ROWS = 1 << 15
#: Cells that come to the driver at most, to be combined and to choose cuts there; it holds some twenty numbers a cell meanwhile.
FEW_CELLS = 1 << 17
#: Nodes that one byte can number: such trees are walked by comparing whole columns.
FEW_NODES = 255
#: Tests of a tree whose outcomes are the bits of one byte.
FEW_TESTS = 8
#: Joint bins of several features that are counted together, and cells up to which that is done.
JOINT, JOINT_CELLS = 1 << 10, 1 << 15
#: Whole weights below this are summed together with the rows that have them.
WHOLE = float(1 << 27)
#: Rows in nodes that are finished locally up to which their trees come to the driver.
NEAR_ROWS = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser with full avalanche (murmur3's)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def uniforms(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on (key, seed, stream) only."""
    return _unit(_mixed(keys, seed, stream))


def _mixed(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) ^ mix(np.array([seed * 1_000_003 + stream + 1], np.int64)))


def _unit(bits: np.ndarray) -> np.ndarray:
    return (bits >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def poisson_counts(keys: np.ndarray, seed: int, stream: int, rate: float) -> np.ndarray:
    """Poisson bootstrap counts by inversion of the distribution function."""
    cdf, table = _poisson_table(rate)
    bits = _mixed(keys, seed, stream)
    n = table[bits >> np.uint64(64 - TABLE_BITS)]
    near = np.flatnonzero(n < 0)  # the distribution function steps inside this cell
    n[near] = np.searchsorted(cdf, _unit(bits[near]), "right")
    return n


#: Leading bits of a hash that decide a bootstrap count unless a step of the distribution function shares them.
TABLE_BITS = 12


#: Tables of this process by rate.
_tables: dict[float, tuple[np.ndarray, np.ndarray]] = {}


def _poisson_table(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The distribution function, and the count for every value of the leading bits (-1: not known from them)."""
    if rate in _tables:
        return _tables[rate]
    p, cdf = math.exp(-rate), [math.exp(-rate)]
    while cdf[-1] < 1 - 1e-12 and len(cdf) < 400:
        p *= rate / len(cdf)
        cdf.append(cdf[-1] + p)
    first = np.arange(1 << TABLE_BITS, dtype=np.uint64) << np.uint64(64 - TABLE_BITS)
    low, high = (np.searchsorted(cdf, _unit(v), "right") for v in (first, first | np.uint64((1 << 64 - TABLE_BITS) - 1)))
    return _tables.setdefault(rate, (np.array(cdf), np.where(low == high, low, -1).astype(float)))


# ---- packed rows ------------------------------------------------------------

@dataclass
class Packed:
    """``df(n long, x, y, key, state binary)``, one record per block, with the layout of ``x``; cached while in use."""
    df: DataFrame
    features: list[str]
    cuts: list[list[float]]
    kind: str
    rows: int

    def __post_init__(self):
        # every level reads the blocks; a lost executor reads its own again from the checkpoint
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        weakref.finalize(self, self.df.unpersist).atexit = False

    @property
    def parts(self) -> int:
        return _parts(self.df, self.rows)

    def fetch(self, df: DataFrame) -> pa.Table:
        """The rows of a table that is made from the blocks."""
        with small_batches(df):
            return df.toArrow()

    def gather(self, fn: Callable, schema: str, keys: list[str], how: dict[str, str], groups: int) -> pa.Table:
        """One Arrow pass over the rows; columns aggregated by key, fetched.

        ``groups`` bounds the rows that a task emits. If those of all tasks
        together are few they are fetched as they are and combined here, which
        spares an exchange.
        """
        out = self.df.mapInArrow(fn, schema)
        if self.parts * groups > FEW_CELLS:
            return self.fetch(out.groupBy(*keys).agg(*[getattr(F, f)(c).alias(c) for c, f in how.items()]))
        table = self.fetch(out)
        if self.parts == 1:
            return table
        table = table.group_by(keys).aggregate(list(how.items()))
        return table.rename_columns({f"{c}_{f}": c for c, f in how.items()}).select([*keys, *how])

    @property
    def offsets(self) -> np.ndarray:
        """First histogram position of each feature, and the number of positions."""
        return np.concatenate([[0], np.cumsum([len(c) + 1 for c in self.cuts])]).astype(np.int64)

    def with_state(self, step: Callable) -> Packed:
        """New state per row, written to the shared checkpoint folder."""
        kind, n = self.kind, len(self.features)

        def run(batches):
            for x, y, key, state in blocks(batches, n, kind):
                yield _block(x, y, key, step(x, y, key, state))
        return Packed(_written(self.df.mapInArrow(run, PACKED_SCHEMA), self.rows)[0], self.features, self.cuts, self.kind, self.rows)


#: Actions that hold the size of Arrow batches down and the size before, by session.
_holding: dict = {}
_hold = threading.Lock()


@contextmanager
def small_batches(df: DataFrame):
    """Actions in here pass blocks to Python in batches of ``BATCH_BYTES``; several threads may be in here at a time."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    with _hold:
        users, before = _holding.get(spark) or (0, spark.conf.get(name))
        if not users:
            spark.conf.set(name, BATCH_BYTES)
        _holding[spark] = users + 1, before
    try:
        yield
    finally:
        with _hold:
            users, before = _holding.pop(spark)
            if users > 1:
                _holding[spark] = users - 1, before
            else:
                spark.conf.set(name, before)


def _parts(df: DataFrame, rows: int) -> int:
    """One task a core, within the bounds on the rows of a task; where cores take several, all take as many."""
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    share = -(-rows // cores)
    if share > PART_MOST:
        return cores * -(-share // PART_MOST)
    return max(1, -(-rows // max(1, PART_ROWS, share)))


def _written(df: DataFrame, rows: int | None = None) -> tuple[DataFrame, int]:
    """The checkpointed blocks in as many partitions as their rows need at most, and their rows.

    New blocks (``rows`` unknown) are dealt out anew where one task would hold
    more than one and a half times its share; a later state keeps their places.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with small_batches(df):
        df = df.checkpoint(eager=True)
    if rows is not None:
        return df.coalesce(_parts(df, rows)), rows
    rows = df.agg(F.sum("n")).first()[0] or 0
    parts = _parts(df, rows)
    merged = df.coalesce(parts)
    # filled partitions often stand side by side among empty ones, and merging neighbours puts them in one task
    most = max([r[1] for r in merged.groupBy(F.spark_partition_id()).agg(F.sum("n")).collect()], default=0)
    return (df.repartition(parts).checkpoint(eager=True) if 2 * most > 3 * -(-rows // parts) else merged), rows


PACKED_SCHEMA = "n long, x binary, y binary, key binary, state binary"


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * k).astype(np.int32)), pa.array(values.ravel()))


def _bytes(*values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())


def _block(x: np.ndarray, y: np.ndarray, key: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), _bytes(x.T), _bytes(y.astype("<f8")), _bytes(key.astype("<i8")),
                                       _bytes(state.astype("<f8"))], ["n", "x", "y", "key", "state"])


def blocks(batches, n_features: int, kind: str):
    """(x, y, key, state) of the packed rows, small blocks put together; x is (rows, features) with contiguous columns."""
    waiting, held = [], 0

    def together():
        if len(waiting) == 1:
            x, y, key, state = waiting[0]
            return x.T, y, key, state
        x, y, key, state = zip(*waiting)
        return np.concatenate(x, 1).T, np.concatenate(y), np.concatenate(key), np.concatenate(state)
    for b in batches:
        for n, *parts in zip(b.column(0).to_pylist(), *(b.column(i) for i in range(1, 5))):
            if not n:
                continue
            x, y, key, state = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, (kind, "<f8", "<i8", "<f8")))
            waiting.append((x.reshape(n_features, n), y, key, state.reshape(n, -1) if len(state) else np.zeros((n, 0))))
            held += n
            if held >= BLOCK_ROWS // 2:
                yield together()
                waiting, held = [], 0
    if waiting:
        yield together()


def _bins(values: np.ndarray, cuts: np.ndarray) -> np.ndarray | int:
    """Number of cuts strictly below each value, so that ``bin <= j`` is exactly ``value <= cuts[j]``."""
    if not len(cuts):
        return 0
    if np.isnan(values).any():
        raise ValueError("features must not be null or NaN")
    if len(cuts) > 16:
        return np.searchsorted(cuts, values)
    out = np.zeros(len(values), np.uint8)
    for c in cuts:
        out += values > c
    return out


def pack(df: DataFrame, features: Sequence[str], label, cuts: list[list[float]], init: Sequence[float] = (),
         key: str | None = None) -> Packed:
    """Bin and pack the rows; ``label`` is a numeric column expression, ``init`` the first state of every row.

    ``key`` names a column whose hash identifies a row for the bootstrap; by
    default its place in the scan does.
    """
    features = list(features)
    most = max((len(c) for c in cuts), default=0)
    kind = "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"
    ident = F.xxhash64(key) if key else F.monotonically_increasing_id()
    rows = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], label.cast("double").alias("_y"), ident.alias("_k"))
    start, edges = np.array(list(init), float), [np.array(c, float) for c in cuts]

    def run(batches):
        waiting, held = [], 0

        def block():
            x, y, k = zip(*waiting)
            y = np.concatenate(y)
            return _block(np.concatenate(x, 1).T, y, np.concatenate(k), np.tile(start, (len(y), 1)))
        for b in batches:
            x = np.empty((len(edges), b.num_rows), kind)
            for i, e in enumerate(edges):
                x[i] = _bins(b.column(i).to_numpy(zero_copy_only=False), e)
            waiting.append((x, *(b.column(b.num_columns - i).to_numpy(zero_copy_only=False) for i in (2, 1))))
            held += b.num_rows
            if held >= BLOCK_ROWS:
                yield block()
                waiting, held = [], 0
        if held:
            yield block()
    table, n = _written(rows.mapInArrow(run, PACKED_SCHEMA))
    return Packed(table, features, cuts, kind, n)


# ---- trees under growth -------------------------------------------------------

class Grove:
    """Splits of several trees as flat arrays; node ``roots[t]`` starts tree t."""

    def __init__(self, n_trees: int):
        self.roots = list(range(n_trees))
        self.tree, self.heap, self.depth = list(range(n_trees)), [1] * n_trees, [0] * n_trees
        self.feature, self.bin, self.left, self.right = ([-1] * n_trees for _ in range(4))

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, bin_
        for side in (0, 1):
            self.tree.append(self.tree[node])
            self.heap.append(2 * self.heap[node] + side)
            self.depth.append(self.depth[node] + 1)
            for a in (self.feature, self.bin, self.left, self.right):
                a.append(-1)
        self.left[node], self.right[node] = len(self.tree) - 2, len(self.tree) - 1
        return self.left[node], self.right[node]

    def arrays(self) -> Routes:
        return Routes(np.array(self.roots), *(np.array(a, np.int32) for a in (self.feature, self.bin, self.left, self.right)), max(self.depth))


@dataclass
class Routes:
    roots: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: int

    def walk(self, tree: int) -> Callable:
        return walker(self.roots[tree], self.feature, self.bin, self.left, self.right, self.depth)

    def node_of(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node each row of bins has reached in a tree."""
        return self.walk(tree)(x)


def walker(root: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> Callable:
    """A function that gives the node every row of a matrix reaches from ``root``.

    Small trees number their nodes in level order, two children side by side:
    a row's number is moved by comparisons of whole columns. Bins of a byte are
    looked up where there are at most ``FEW_TESTS`` tests: a bin gives the tests
    of its feature that it passes, and all of them give the node.
    """
    nodes, moves, i = [int(root)], [], 0
    while i < len(nodes) and len(nodes) <= FEW_NODES:
        f = int(feature[nodes[i]])
        if f >= 0:
            moves.append((i, f, cut[nodes[i]].item(), len(nodes) + 1))
            nodes += [int(left[nodes[i]]), int(right[nodes[i]])]
        i += 1
    if len(nodes) > FEW_NODES:
        def deep(x: np.ndarray) -> np.ndarray:
            at, rows = np.full(len(x), root, np.int64), np.arange(len(x))
            for _ in range(depth):
                f = feature[at[rows]]
                rows = rows[f >= 0]
                if not len(rows):
                    break
                here = at[rows]
                at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])
            return at
        return deep
    ids, tables = np.array(nodes), []

    def looked_up() -> list:
        """Per feature the tests that a bin passes, and the node's number by the tests that are passed."""
        if not tables:
            bits, codes, at = {}, np.arange(1 << len(moves)), np.zeros(1 << len(moves), np.uint8)
            for j, (i, f, c, to) in enumerate(moves):
                passed = bits.setdefault(f, np.full(256, sum(1 << k for k, m in enumerate(moves) if m[1] != f), np.uint8))
                passed |= (np.arange(256) <= c).astype(np.uint8) << np.uint8(j)
                at = np.where(at == i, to - (codes >> j & 1), at).astype(np.uint8)
            tables.extend([[(f, t.tobytes()) for f, t in bits.items()], at])
        return tables

    def few(x: np.ndarray, of: np.ndarray = ids) -> np.ndarray:
        if x.dtype == np.uint8 and 0 < len(moves) <= FEW_TESTS:
            (first, *others), at = looked_up()
            code = _translated(x, *first)
            for f, passed in others:
                code = code & _translated(x, f, passed)
            return of[at].take(code, 0)
        code = np.zeros(len(x), np.uint8)
        for i, f, c, to in moves:
            low = x[:, f] <= c
            if i:
                here = code == i
                low &= here
                code += here.view(np.uint8) * np.uint8(to - i)
            else:
                code += np.uint8(to)
            code -= low.view(np.uint8)
        return of[code]
    few.ids = ids
    return few


def _translated(x: np.ndarray, column: int, table: bytes) -> np.ndarray:
    """Bytes of a column by table; quicker than indexing."""
    return np.frombuffer(x[:, column].tobytes().translate(table), np.uint8)


def placer(walk: Callable, place: np.ndarray) -> Callable:
    """``place[walk(x)]``; the nodes of a small tree are looked up once, not once a row."""
    ids = getattr(walk, "ids", None)
    if ids is None:
        return lambda x: place[walk(x)]
    of = place[ids]
    return lambda x: walk(x, of)


def _weight(values: np.ndarray, n_impurity: int, task: str) -> np.ndarray:
    return values[:n_impurity].sum(0) if task == "classification" else values[0]


def _joint(widths: list[int], nodes: int) -> list[list[int]]:
    """Features whose joint bins are few are counted together and told apart afterwards."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(widths)), key=lambda f: -widths[f]):
        for k, (size, members) in enumerate(groups):
            if size * widths[f] <= JOINT and size * widths[f] * nodes <= JOINT_CELLS:
                groups[k] = (size * widths[f], [*members, f])
                break
        else:
            groups.append((widths[f], [f]))
    return [members for _, members in groups]


def _histogram(packed: Packed, routes: Routes, slot: np.ndarray, slots_of: list[tuple[int, int]], stats: Callable, n_stats: int,
               n_impurity: int, task: str):
    """Cells (slot, pos, c, s0, ...) of this task. ``slots_of[t]``: first and end slot of tree t (a contiguous run)."""
    offsets, n_features, kind = packed.offsets, len(packed.features), packed.kind
    width, names = int(offsets[-1]), ["slot", "pos", "c", *[f"s{j}" for j in range(n_stats)]]
    widths = [len(c) + 1 for c in packed.cuts]

    def run(batches):
        first, end = min(a for a, z in slots_of if z > a), max(z for a, z in slots_of)
        groups = _joint(widths, max(z - a for a, z in slots_of) + 1)
        sizes = [math.prod(widths[f] for f in g) for g in groups]
        # per group of features: statistics x (slots, and one for rows of no slot per tree) x joint bins
        # rows of no slot of their tree are counted in one slot more, which is dropped
        trees = [(t, a, z, placer(routes.walk(t), np.where((slot >= a) & (slot < z), slot - a, z - a))) for t, (a, z) in enumerate(slots_of) if z > a]
        sums = [[np.zeros((1 + n_stats, (z - a + 1) * size)) for size in sizes] for _, a, z, _ in trees]
        for x, y, key, state in blocks(batches, n_features, kind):
            given = stats(x, y, key, state)
            bins = []
            for g in groups:
                at = np.zeros(len(x), np.int64)
                for f in g:
                    at = at * widths[f] + x[:, f]
                bins.append(at)
            for (t, a, z, place), into in zip(trees, sums):
                values = given(t)  # (n_stats, rows); the first is the weight
                s, w, at = place(x), _weight(values, n_impurity, task), bins
                drawn = w > 0
                # rows without weight add nothing; taking the others out costs more unless they are few
                use = (s < z - a) & drawn
                if np.count_nonzero(use) < len(s) // 2 or w.min(initial=0) < 0 or not math.isfinite(values.sum()):
                    use = np.flatnonzero(use)
                    s, values, w, at = s[use], values[:, use], w[use], [v[use] for v in bins]
                _count(s, w, values, at, sizes, into, n_impurity if task == "classification" else 1)
        parts = []
        for (t, a, z, _), into in zip(trees, sums):
            cells = np.zeros((1 + n_stats, z - a, width))
            for g, size, v in zip(groups, sizes, into):
                v = v.reshape(1 + n_stats, z - a + 1, *[widths[f] for f in g])[:, :-1]
                for k, f in enumerate(g):
                    cells[:, :, offsets[f]:offsets[f + 1]] = v.sum(tuple(2 + j for j in range(len(g)) if j != k))
            cells = cells.reshape(1 + n_stats, -1)
            full = np.flatnonzero(cells[0])
            parts.append([full // width + a, full % width, np.rint(cells[0, full]).astype(np.int64), *cells[1:, full]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)
    return run


def _count(s: np.ndarray, w: np.ndarray, values: np.ndarray, bins: list[np.ndarray], sizes: list[int], into: list[np.ndarray], n_weights: int) -> None:
    """Add rows of slots ``s`` and weights ``w`` to the sums of every group of features: rows, then the statistics."""
    one = n_weights == 1 and bool((w == 1).all())
    whole = not one and bool((w == np.floor(w)).all()) and w.max(initial=0) * len(w) < WHOLE
    both = [v + WHOLE * (v > 0) for v in values[:n_weights]] if whole else []
    for at, size, total in zip(bins, sizes, into):
        at, n = s * size + at, total.shape[1]
        few = n > 4 * len(at)  # many cells, few rows

        def add(j: int, v: np.ndarray) -> None:
            if few:
                np.add.at(total[j], at, v)
            else:
                total[j] += np.bincount(at, v, n)
        if whole and not few:
            for j in range(n_weights):
                got = np.bincount(at, both[j], n)
                counted = np.floor(got / WHOLE)
                total[0] += counted
                total[1 + j] += got - WHOLE * counted
        elif one and not few:
            got = np.bincount(at, None, n)
            total[0] += got
            total[1] += got
        else:
            add(0, (w > 0).astype(float))
            for j in range(n_weights):
                add(1 + j, values[j])
        for j in range(n_weights, len(values)):
            add(1 + j, values[j])


def _impurity(s: np.ndarray, criterion: str) -> tuple[np.ndarray, np.ndarray]:
    """Weight and impurity of class-weight rows."""
    w = s.sum(0)
    p = s / np.where(w > 0, w, 1)
    if criterion == "gini":
        return w, 1 - (p * p).sum(0)
    return w, -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(0)


def _gain(left: np.ndarray, right: np.ndarray, task: str, criterion: str) -> tuple[np.ndarray, np.ndarray]:
    """Impurity decrease per unit weight, and where both sides have weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if task == "classification":
            (wl, il), (wr, ir), (w, parent) = (_impurity(s, criterion) for s in (left, right, left + right))
            return parent - (wl * il + wr * ir) / w, (wl > 0) & (wr > 0)
        wl, wr = left[0], right[0]
        w = wl + wr
        if criterion == "poisson":
            def term(sy, ww):
                return np.where(sy > 0, sy * np.log(np.where(sy > 0, sy, 1) / np.where(ww > 0, ww, 1)), 0)
            gain = (term(left[1], wl) + term(right[1], wr) - term(left[1] + right[1], w)) / w
            return gain, (wl > 0) & (wr > 0) & (left[1] > 0) & (right[1] > 0)
        return (wl * wr / w) * (left[1] / wl - right[1] / wr) ** 2 / w, (wl > 0) & (wr > 0)


def _node_impurity(s: np.ndarray, task: str, criterion: str) -> np.ndarray:
    """``trees._impurity_py`` of many nodes: (n_impurity, nodes) statistics."""
    if task == "classification":
        w, impurity = _impurity(s, "gini" if criterion == "gini" else "entropy")
        return np.where(w > 0, impurity, 0)
    w, sy, syy = s
    some = np.where(w > 0, w, 1)
    mean = sy / some
    spread = np.maximum(syy / some - mean * mean, 0)
    if criterion == "poisson":
        spread = np.where(mean > 0, spread / np.where(mean > 0, 2 * mean, 1), 0)
    return np.where(w > 0, spread, 0)


def best_cuts(table: pa.Table, offsets: np.ndarray, n_stats: int, n_impurity: int, task: str, criterion: str, min_leaf: int,
              ranks: Callable[[int], np.ndarray] | None, n_try: int) -> pa.Table:
    """Per slot: totals, and the best cut with its left sums (feature -1 without one).

    Ties go to the first feature, then the lowest bin. ``ranks(slot)`` orders
    the features a node looks at: the first ``n_try``, then one more at a time
    until one has a valid cut.
    """
    slot, pos = table.column("slot").to_numpy(), table.column("pos").to_numpy()
    order = np.lexsort((pos, slot))
    slot, pos = slot[order], pos[order]
    c = table.column("c").to_numpy()[order]
    s = np.stack([table.column(f"s{j}").to_numpy()[order] for j in range(n_stats)])
    feature = np.searchsorted(offsets, pos, "right") - 1
    run = slot * len(offsets) + feature
    first = np.flatnonzero(np.diff(run, prepend=-1))
    last = np.append(first[1:], len(run)) - 1
    seg = np.repeat(np.arange(len(first)), last - first + 1)

    def running(v):
        total = np.cumsum(v, -1)
        base = total[..., first] - v[..., first]
        left = total - base[..., seg]
        return left, left[..., last][..., seg]
    nl, nt = running(c)
    left, total = running(s)
    gain, ok = _gain(left[:n_impurity], (total - left)[:n_impurity], task, criterion)
    ok &= (nl >= min_leaf) & (nt - nl >= min_leaf) & (nl < nt)
    turn = np.zeros(len(slot), np.int64)
    if ranks is not None:
        for q in np.unique(slot):
            here = slot == q
            turn[here] = np.maximum(0, ranks(int(q))[feature[here]] - n_try + 1)
    pick = np.lexsort((pos, feature, -np.where(ok, gain, -np.inf), turn, ~ok, slot))
    pick = pick[np.flatnonzero(np.diff(slot[pick], prepend=-1))]
    good = ok[pick]
    return pa.table({
        "slot": pa.array(slot[pick]), "feature": pa.array(np.where(good, feature[pick], -1)),
        "bin": pa.array(pos[pick] - offsets[feature[pick]]), "gain": pa.array(np.where(good, gain[pick], 0.0)),
        "n": pa.array(nt[pick]), "n_left": pa.array(nl[pick]),
        "total": _lists(total[:, pick].T), "left": _lists(left[:, pick].T)})


def _cutter(*how):
    def best(table: pa.Table) -> pa.Table:
        return best_cuts(table, *how)
    return best


_BEST = "slot long, feature long, bin long, gain double, n long, n_left long, total array<double>, left array<double>"


def grow(packed: Packed, n_trees: int, stats: Callable, n_stats: int, n_impurity: int, task: str, criterion: str,
         max_depth: int, min_samples_split: int = 2, min_samples_leaf: int = 1, classes: list | None = None,
         max_features: int | None = None, seed: int = 0, first_tree: int = 0, local_rows: int = 0) -> Trees:
    """Grow ``n_trees`` trees level by level.

    Nodes of at most ``local_rows`` rows are finished where their rows meet, one
    bounded group per node (``TreeModel.tails``); the levels above are joint.
    If those nodes hold more than ``NEAR_ROWS`` rows together, what grows below
    them is never fetched: it is written as one record per node (``Trees.far``).

    ``stats(x, y, key, state)`` returns a function of the tree number that
    gives the statistics of the batch, (n_stats, rows): weights first, or
    class weights; the first ``n_impurity`` decide the cuts, all are summed.
    Node.stats hold all of them.
    """
    offsets, n_features, n_trees_all = packed.offsets, len(packed.features), n_trees
    grove = Grove(n_trees)
    models = [TreeModel(packed.features, task, criterion, classes) for _ in range(n_trees)]
    open_ = list(range(n_trees))
    weigh = (lambda st: sum(st[:n_impurity])) if task == "classification" else (lambda st: st[0])

    def node(i: int, n: int, st: list[float]) -> Node:
        w = weigh(st)
        made = Node(grove.heap[i], grove.depth[i], n, w, st, _impurity_py(st[:n_impurity], w, task, criterion))
        models[grove.tree[i]].nodes[made.node_id] = made
        return made

    def splits(made: Node, i: int) -> bool:
        root = models[grove.tree[i]].nodes[1]
        return (made.depth < max_depth and made.n >= max(min_samples_split, 2 * min_samples_leaf, 2)
                and made.impurity > EPS * root.impurity)

    def ranks_of(nodes: list[int] | None) -> Callable | None:
        """Order of the features per slot of ``nodes``, or per (tree, heap number) without nodes."""
        if max_features is None or max_features >= n_features:
            return None
        ident = None if nodes is None else [(grove.tree[i], grove.heap[i]) for i in nodes]
        features = np.arange(n_features)

        def by_place(tree: int, heap: int) -> np.ndarray:
            u = uniforms(features + (heap % (1 << 40)) * 65_537, seed, 7_000_000 + first_tree + tree)
            out = np.empty(n_features, np.int64)
            out[np.argsort(u, kind="stable")] = features
            return out
        return by_place if ident is None else lambda slot: by_place(*ident[slot])

    per_job = max(1, CELLS // max(1, int(offsets[-1]) * (1 + n_stats)))
    small: list[int] = []
    while open_:
        small += [i for i in open_ if grove.heap[i] in models[grove.tree[i]].nodes and models[grove.tree[i]].nodes[grove.heap[i]].n <= local_rows]
        open_ = sorted(set(open_) - set(small))
        nxt = []
        open_.sort(key=lambda i: grove.tree[i])
        for lo in range(0, len(open_), per_job):
            nodes = open_[lo:lo + per_job]
            slot = np.full(len(grove.tree), -1, np.int64)
            slot[nodes] = np.arange(len(nodes))
            trees = np.array([grove.tree[i] for i in nodes])
            runs = [(int(np.searchsorted(trees, t)), int(np.searchsorted(trees, t, "right"))) for t in range(n_trees_all)]
            task_fn = _histogram(packed, grove.arrays(), slot, runs, stats, n_stats, n_impurity, task)
            sums = {"c": "sum", **{f"s{j}": "sum" for j in range(n_stats)}}
            schema = "slot long, pos long, c long, " + ", ".join(f"s{j} double" for j in range(n_stats))
            best = _cutter(offsets, n_stats, n_impurity, task, criterion, min_samples_leaf, ranks_of(nodes), max_features or n_features)
            if len(nodes) * int(offsets[-1]) <= FEW_CELLS:
                summed = packed.gather(task_fn, schema, ["slot", "pos"], sums, len(nodes) * int(offsets[-1]))
                found = best(summed).to_pylist() if summed.num_rows else []
            else:
                cells = packed.df.mapInArrow(task_fn, schema).groupBy("slot", "pos").agg(*[F.sum(c).alias(c) for c in sums])
                found = packed.fetch(cells.groupBy("slot").applyInArrow(best, _BEST)).to_pylist()
            for r in found:
                i = nodes[r["slot"]]
                st = r["total"]
                if grove.heap[i] == 1:
                    if not splits(node(i, r["n"], st), i):
                        continue
                if r["feature"] < 0:
                    continue
                made = models[grove.tree[i]].nodes[grove.heap[i]]
                made.feature, made.threshold, made.improvement = r["feature"], packed.cuts[r["feature"]][r["bin"]], r["gain"]
                a, z = grove.split(i, r["feature"], r["bin"])
                right = [t - l for t, l in zip(st, r["left"])]
                for child, n, sums_ in ((a, r["n_left"], r["left"]), (z, r["n"] - r["n_left"], right)):
                    if splits(node(child, n, sums_), child):
                        nxt.append(child)
        open_ = nxt
    for m in models:
        m.nodes.setdefault(1, Node(1, 0, 0, 0.0, [0.0] * n_stats, 0.0))
    grown = Trees(models)
    if small:
        _finish(packed, grove, grown, small, stats, n_stats, n_impurity, task, criterion, max_depth, min_samples_split,
                min_samples_leaf, ranks_of, max_features or n_features)
    return grown


class Trees(list):
    """Grown trees; parts below small nodes that are too many for the driver stand in ``far``.

    ``far`` is a checkpointed table (slot, packed tail); ``slots[t]`` gives the slots of tree t by node id.
    """
    far: DataFrame | None = None
    slots: list[dict[int, int]] = []


@dataclass
class Tail:
    """The part of a tree below one node: nodes in level order, children by place, statistics per node."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    stats: np.ndarray


def _finish(packed: Packed, grove: Grove, models: Trees, nodes: list[int], stats: Callable, n_stats: int, n_impurity: int,
            task: str, criterion: str, max_depth: int, min_split: int, min_leaf: int, ranks_of: Callable, n_try: int) -> None:
    """Collect the rows of every small node in one group and grow the rest of its tree there."""
    nodes = sorted(nodes, key=lambda i: grove.tree[i])
    slot = np.full(len(grove.tree), -1, np.int64)
    slot[nodes] = np.arange(len(nodes))
    routes, offsets, n_features, kind = grove.arrays(), packed.offsets, len(packed.features), packed.kind
    trees = sorted({grove.tree[i] for i in nodes})
    depth = np.array([grove.depth[i] for i in nodes])
    floor_ = np.array([EPS * models[grove.tree[i]].nodes[1].impurity for i in nodes])
    heap = [grove.heap[i] for i in nodes]
    owner = [grove.tree[i] for i in nodes]
    ranked = ranks_of(nodes) is not None
    rank_for = _ranker(owner, heap, ranks_of) if ranked else None

    def rows(batches):
        for x, y, key, state in blocks(batches, n_features, kind):
            given = stats(x, y, key, state)
            for t, walk in [(t, routes.walk(t)) for t in trees]:
                s, values = slot[walk(x)], given(t)
                use = np.flatnonzero((s >= 0) & (_weight(values, n_impurity, task) > 0))
                yield from bundles(s[use], {"x": x[use], "s": values[:, use].T})

    def build(table: pa.Table) -> pa.Table:
        q = table.column("slot")[0].as_py()
        x, s = unbundle(table, "x", kind, n_features), unbundle(table, "s", "<f8", n_stats).T
        # rows come in any order; sums must not depend on it
        order = np.lexsort((*s, *x.T))
        x, s = x[order], s[:, order]
        at = np.zeros(len(x), np.int64)
        feature, bins, left, right, n, heaps = (np.array([v], np.int64) for v in (-1, 0, -1, -1, len(x), 1))
        level, deep, sums_ = np.array([0]), int(depth[q]), s.sum(1)[None, :]
        while len(level) and deep < max_depth:
            width = int(offsets[-1])
            place = np.full(len(n), -1, np.int64)
            place[level] = np.arange(len(level))
            node = place[at]
            use = node >= 0
            cell, inverse = np.unique((node[use][:, None] * width + offsets[:-1] + x[use]).ravel(), return_inverse=True)
            sums = [np.bincount(inverse, np.repeat(v[use], n_features)) for v in s]
            names = ["slot", "pos", "c", *[f"s{j}" for j in range(n_stats)]]
            cells = pa.table([pa.array(cell // width), pa.array(cell % width), pa.array(np.bincount(inverse)), *[pa.array(v) for v in sums]], names)
            ranks = None if rank_for is None else (lambda k, level=level, heaps=heaps: rank_for(q, int(heaps[level[k]])))
            found = best_cuts(cells, offsets, n_stats, n_impurity, task, criterion, min_leaf, ranks, n_try)
            cut = np.flatnonzero(found.column("feature").to_numpy() >= 0)
            one = {c: found.column(c).to_numpy()[cut] for c in ("slot", "feature", "bin", "n", "n_left")}
            total, low = (found.column(c).chunk(0).flatten().to_numpy().reshape(-1, n_stats)[cut] for c in ("total", "left"))
            i, child = level[one["slot"]], len(n) + np.arange(2 * len(cut))
            feature[i], bins[i], left[i], right[i] = one["feature"], one["bin"], child[::2], child[1::2]
            # two children of a node side by side, in the order of the nodes
            st = np.stack([low, total - low], 1).reshape(-1, n_stats)
            rows_ = np.stack([one["n_left"], one["n"] - one["n_left"]], 1).ravel()
            heaps = np.append(heaps, np.stack([2 * heaps[i], 2 * heaps[i] + 1], 1).ravel())
            feature, left, right = (np.append(v, np.full(len(child), -1)) for v in (feature, left, right))
            bins, n, sums_ = np.append(bins, np.zeros(len(child), np.int64)), np.append(n, rows_), np.concatenate([sums_, st])
            open_ = (rows_ >= max(min_split, 2 * min_leaf, 2)) & (_node_impurity(st[:, :n_impurity].T, task, criterion) > floor_[q])
            go = feature[at] >= 0  # of the nodes that hold rows, those that were split just now
            right_ = x[np.arange(len(x)), np.maximum(feature[at], 0)] > bins[at]
            at = np.where(go, left[at] + right_, at)
            level, deep = child[open_], deep + 1
        feature = feature.astype(np.int32)
        threshold = np.zeros(len(feature))
        for j in np.unique(feature[feature >= 0]):
            threshold[feature == j] = cut_values[j][bins[feature == j]]
        return pa.table([pa.array([q]), *(_bytes(np.array(v, t)) for v, t in zip(
            (feature, threshold, left, right, n, sums_), TAIL_TYPES))], TAIL_NAMES)

    cut_values = [np.array([*c, math.inf]) for c in packed.cuts]
    found = packed.df.mapInArrow(rows, "slot long, x binary, s binary").groupBy("slot").applyInArrow(build, TAIL_SCHEMA)
    if sum(models[grove.tree[i]].nodes[grove.heap[i]].n for i in nodes) > NEAR_ROWS:
        with small_batches(found):
            models.far, models.slots = found.checkpoint(eager=True), [{} for _ in models]
        for k, i in enumerate(nodes):
            models.slots[grove.tree[i]][grove.heap[i]] = k
        return
    found = packed.fetch(found)
    for k in range(found.num_rows):
        i = nodes[found.column("slot")[k].as_py()]
        models[grove.tree[i]].tails[grove.heap[i]] = read_tail(found, k, n_stats)


TAIL_NAMES = ["slot", "feature", "threshold", "left", "right", "n", "stats"]
TAIL_TYPES = ("<i4", "<f8", "<i4", "<i4", "<i8", "<f8")
TAIL_SCHEMA = "slot long, " + ", ".join(f"{c} binary" for c in TAIL_NAMES[1:])


def read_tail(table: pa.Table, row: int, n_stats: int) -> Tail:
    feature, threshold, left, right, n, stats = (np.frombuffer(table.column(c)[row].as_buffer(), t) for c, t in zip(TAIL_NAMES[1:], TAIL_TYPES))
    return Tail(feature, threshold, left, right, n, stats.reshape(-1, n_stats))


def bundles(slot: np.ndarray, values: dict[str, np.ndarray]):
    """One record per slot with its rows of every matrix as bytes."""
    if not len(slot):
        return
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    first = np.flatnonzero(np.diff(slot, prepend=slot[0] - 1))
    parts = {c: [p.tobytes() for p in np.split(np.ascontiguousarray(v[order]), first[1:])] for c, v in values.items()}
    yield pa.RecordBatch.from_arrays([pa.array(slot[first]), *(pa.array(p, pa.binary()) for p in parts.values())], ["slot", *parts])


def unbundle(table: pa.Table, column: str, kind: str, width: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(column)]).reshape(-1, width)


def _ranker(owner: list[int], heap: list[int], ranks_of: Callable) -> Callable[[int, int], np.ndarray]:
    rank = ranks_of(None)

    def of(slot: int, below: int) -> np.ndarray:
        # the place in the whole tree: the node's own path, then the path below it
        steps = below.bit_length() - 1
        return rank(owner[slot], (heap[slot] << steps) | (below - (1 << steps)))
    return of


# ---- applying models ------------------------------------------------------------

class Forest:
    """Trees with a vector per leaf as flat arrays, for bins (boosting state) or raw values (scoring).

    ``values(tree number, stats, node id)`` maps the (nodes, n_stats) statistics
    of some nodes to their vectors; ids are None below a bounded node (tails).
    """

    def __init__(self, trees: Sequence[TreeModel], values: Callable, cuts: list[list[float]] | None = None):
        self.roots, parts, size, self.depth = [], [], 0, 0
        for t, tree in enumerate(trees):
            ids = sorted(tree.nodes)
            at = {nid: size + k for k, nid in enumerate(ids)}
            self.roots.append(at[1])
            size += len(ids)
            tails = []
            for nid, tail in tree.tails.items():
                at[nid] = size  # the tail's first node stands in for the node itself
                tails.append((size, tail))
                size += len(tail.n)
            nodes = [tree.nodes[nid] for nid in ids]
            inner = np.array([not n.is_leaf for n in nodes])
            threshold = [0 if n.is_leaf else float(n.threshold) if cuts is None else cuts[n.feature].index(n.threshold) for n in nodes]
            parts.append((np.array([-1 if n.is_leaf else n.feature for n in nodes]), np.array(threshold),
                          np.array([at[2 * n.node_id] if i else -1 for n, i in zip(nodes, inner)]),
                          np.array([at[2 * n.node_id + 1] if i else -1 for n, i in zip(nodes, inner)]),
                          values(t, np.array([n.stats for n in nodes], float), ids)))
            if 1 in tree.tails:
                self.roots[-1] = at[1]
            for first, tail in tails:
                go = tail.feature >= 0
                parts.append((tail.feature, tail.threshold, np.where(go, tail.left + first, -1), np.where(go, tail.right + first, -1),
                              values(t, tail.stats, None)))
            self.depth = max(self.depth, tree.depth + max((_tail_depth(x) for _, x in tails), default=0))
        if parts:
            self.feature, self.threshold, self.left, self.right = (np.concatenate([p[k] for p in parts]) for k in range(4))
            self.value = np.concatenate([p[4] for p in parts])
            self.feature, self.left, self.right = (a.astype(np.int32) for a in (self.feature, self.left, self.right))

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        return self._walk(tree)(x)

    def _walk(self, tree: int) -> Callable:
        walks = self.__dict__.setdefault("_walks", {})
        if tree not in walks:
            walks[tree] = walker(self.roots[tree], self.feature, self.threshold, self.left, self.right, self.depth)
        return walks[tree]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_walks"}

    def add(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Add every tree's leaf vector to the rows of ``out``."""
        for t in range(len(self.roots)):
            if out.shape[1] == 1:
                out[:, 0] += self._first(x, t)
            else:
                out += self.value[self.leaves(x, t)]
        return out

    def each(self, x: np.ndarray) -> np.ndarray:
        """First leaf value of every tree, (rows, trees)."""
        return np.stack([self._first(x, t) for t in range(len(self.roots))], 1)

    def _first(self, x: np.ndarray, tree: int) -> np.ndarray:
        return placer(self._walk(tree), self.value[:, 0])(x)


def _tail_depth(tail: Tail) -> int:
    deep = np.zeros(len(tail.n), np.int64)
    for i in np.flatnonzero(tail.feature >= 0):  # parents stand before their children
        deep[tail.left[i]] = deep[tail.right[i]] = deep[i] + 1
    return int(deep.max(initial=0))


def score_column(features: Sequence[str], of_matrix: Callable[[np.ndarray], np.ndarray]):
    """An Arrow-batched column array<double>: ``of_matrix`` maps a (rows, features) matrix to a (rows, k) matrix."""
    @F.arrow_udf("array<double>")
    def scores(first: pa.Array, *rest: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (first, *rest)]).T
        return _lists(np.ascontiguousarray(of_matrix(x), dtype=float))
    return scores(*[F.col(f).cast("double") for f in features])


def far_scores(df: DataFrame, key: str, features: Sequence[str], trees: Trees, top: Forest, values: Callable, n_stats: int) -> DataFrame:
    """(key, tree, v) of every row and tree whose parts below small nodes stand in ``trees.far``.

    Rows are routed through the upper parts and meet the rest of a tree in one
    group per small node; ``top`` holds the upper parts, ``values`` as in ``Forest``.
    """
    slot_of = []
    for tree, slots in zip(trees, trees.slots):
        slot_of += [slots.get(i, -1) for i in sorted(tree.nodes)]
    slot_of, n_trees, n_features = np.array(slot_of), len(trees), len(features)

    def route(batches):
        waiting, held = [], 0

        def out():
            ids, x = (np.concatenate(v) for v in zip(*waiting))
            for t in range(n_trees):
                at = top.leaves(x, t)
                slot = slot_of[at]
                near, far = np.flatnonzero(slot < 0), np.flatnonzero(slot >= 0)
                if len(near):
                    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([t]), _bytes(ids[near]), _bytes(top.value[at[near]])], ["slot", "tree", "k", "x"])
                for b in bundles(slot[far], {"k": ids[far][:, None], "x": x[far]}):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t] * b.num_rows), b.column(1), b.column(2)], ["slot", "tree", "k", "x"])
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            waiting.append((cols[0], np.stack(cols[1:], 1).astype(float)))
            held += b.num_rows
            if held >= BLOCK_ROWS:
                yield from out()
                waiting, held = [], 0
        if waiting:
            yield from out()

    def finish(tail: pa.Table, rows: pa.Table) -> pa.Table:
        if not tail.num_rows or not rows.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))], ["k", "tree", "v"])
        tail = read_tail(tail, 0, n_stats)
        walk = walker(0, tail.feature, tail.threshold, tail.left, tail.right, _tail_depth(tail))
        x, ids = unbundle(rows, "x", "<f8", n_features), unbundle(rows, "k", "<i8", 1)[:, 0]
        t = rows.column("tree")[0].as_py()
        v = values(t, tail.stats, None)[walk(x)]
        return pa.table([pa.array(ids), pa.array(np.full(len(ids), t)), _lists(v)], ["k", "tree", "v"])

    def near(batches):
        for b in batches:
            for t, ids, v in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), t)),
                                                  _lists(np.frombuffer(v.as_buffer(), "<f8").reshape(len(ids), -1))], ["k", "tree", "v"])

    placed = df.select(key, *[F.col(f).cast("double") for f in features]).mapInArrow(route, "slot long, tree long, k binary, x binary")
    schema = "k long, tree long, v array<double>"
    below = trees.far.groupBy("slot").cogroup(placed.where("slot >= 0").groupBy("slot")).applyInArrow(finish, schema)
    return placed.where("slot < 0").mapInArrow(near, schema).unionByName(below).withColumnRenamed("k", key)


# ---- order statistics per group ------------------------------------------------

def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = (v + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _unsortable(k: np.ndarray) -> np.ndarray:
    return np.where(k >> np.uint64(63) == 1, k & np.uint64((1 << 63) - 1), ~k).view(np.float64)


DIGIT = 16
PICK_ROWS = 1 << 18


#: Rows that guess where quantiles are, and rows that a pass may expect to bring from there.
GUIDE_ROWS, GUIDED_ROWS = 1 << 19, 1 << 20


def guide(packed: Packed) -> tuple | None:
    """(x, y, key, state) of some ``GUIDE_ROWS`` evenly chosen rows on the driver, for ``group_quantiles``; small tables need none."""
    n_features, kind, every = len(packed.features), packed.kind, -(-packed.rows // GUIDE_ROWS)
    if packed.rows <= max(PICK_ROWS, GUIDE_ROWS):
        return None

    def run(batches):
        for x, y, key, state in blocks(batches, n_features, kind):
            yield _block(x[::every], y[::every], key[::every], state[::every])
    table = packed.fetch(packed.df.mapInArrow(run, PACKED_SCHEMA))
    parts = list(blocks(table.to_batches(), n_features, kind))
    x, y, key, state = zip(*parts)
    return np.concatenate([v.T for v in x], 1).T, np.concatenate(y), np.concatenate(key), np.concatenate(state)


def _guesses(guided: tuple, values: Callable, prob: float, rows: int) -> dict[int, tuple[int, int]] | None:
    """Per group an interval of sortable values that almost surely holds the quantile, or None if too many rows are expected in them."""
    g, v = values(*guided)
    k, out, inside = _sortable(np.ascontiguousarray(v, dtype=float)), {}, 0
    for group in _groups(g):
        here = np.sort(k[g == group])
        at, slack = (len(here) - 1) * prob, 5 * math.sqrt(len(here) * prob * (1 - prob)) + 5
        lo, hi = math.floor(at - slack), math.ceil(at + slack)
        a, z = (int(here[lo]) if lo >= 0 else 0), (int(here[hi]) if hi < len(here) else (1 << 64) - 1)
        out[int(group)] = a, z
        inside += int(np.searchsorted(here, np.uint64(z), "right") - np.searchsorted(here, np.uint64(a)))
    return out if out and inside * (rows / len(k)) <= GUIDED_ROWS else None


def _guided_quantiles(packed: Packed, values: Callable, prob: float, guesses: dict[int, tuple[int, int]]) -> dict[int, float] | None:
    """One pass that counts each group's values below its interval and brings those inside. None if an interval misses its quantile,
    a group has none, or a task finds far more values there than expected."""
    n_features, kind = len(packed.features), packed.kind

    def run(batches):
        count, parts, held = {}, [], 0
        for row in blocks(batches, n_features, kind):
            g, v = values(*row)
            k = _sortable(np.ascontiguousarray(v, dtype=float))
            for group in _groups(g):
                here = k[g == group]
                a, z = guesses.get(group, (1, 0))
                cell = count.setdefault(group, [0, 0])
                cell[0] += len(here)
                cell[1] += int(np.count_nonzero(here < np.uint64(a)))
                if held >= 0:
                    parts.append(_counted(group, here[(here >= np.uint64(a)) & (here <= np.uint64(z))]))
                    held += len(parts[-1][0])
            if held > GUIDED_ROWS:
                parts, held = [], -1  # the guess was bad: only say so
        g, p, n = _merged(parts)
        groups = np.array(list(count), np.int64)
        # kind 0: values inside; 1: rows of a group; 2: rows below; 3: too many
        tags = [np.zeros(len(g)), np.ones(len(groups)), np.full(len(groups), 2), np.full(int(held < 0), 3)]
        both = np.array(list(count.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(tags).astype(np.int32)), pa.array(np.concatenate([g, groups, groups, np.zeros(int(held < 0), np.int64)])),
            pa.array(np.concatenate([p.view(np.int64), np.zeros(2 * len(groups) + int(held < 0), np.int64)])),
            pa.array(np.concatenate([n, both[:, 0], both[:, 1], np.zeros(int(held < 0), np.int64)]))], ["t", "g", "p", "n"])
    table = packed.fetch(packed.df.mapInArrow(run, "t int, g long, p long, n long"))
    t, g, n = (table.column(c).to_numpy() for c in ("t", "g", "n"))
    p = table.column("p").to_numpy().view(np.uint64)
    if (t == 3).any():
        return None
    out = {}
    for group in np.unique(g[t == 1]).tolist():
        if group not in guesses:
            return None
        of = g == group
        rows, below = int(n[of & (t == 1)].sum()), int(n[of & (t == 2)].sum())
        inside = of & (t == 0)
        order = np.argsort(p[inside])
        keys, ends = p[inside][order], np.cumsum(n[inside][order])
        at = (rows - 1) * prob
        lo, hi = math.floor(at) - below, math.ceil(at) - below
        if lo < 0 or not len(ends) or hi >= ends[-1]:
            return None
        v = _unsortable(keys[np.searchsorted(ends, [lo, hi], "right")])
        out[group] = float(v[0] + (v[1] - v[0]) * (at - math.floor(at)))
    return out


def _counted(group: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, n = np.unique(k, return_counts=True)
    return np.full(len(p), group, np.int64), p, n


def group_quantiles(packed: Packed, values: Callable, prob: float, guided: tuple | None = None) -> dict[int, float]:
    """Exact linear-interpolation quantile of a value per group.

    ``guided`` (``guide``, its state kept up to date) tells where the quantiles
    about are: if they are there, one pass counts and brings what decides them.
    Else, and without it:

    ``values(x, y, key, state)`` gives (group, value) of a batch. Selection by
    digits of 16 bits: every pass counts the next digit of the values that
    share the wanted prefixes; as soon as few enough rows are left they are
    fetched and ranked. At most four passes, each one aggregation.
    """
    n_features, kind = len(packed.features), packed.kind
    guesses = _guesses(guided, values, prob, packed.rows) if guided is not None else None
    known = _guided_quantiles(packed, values, prob, guesses) if guesses else None
    if known is not None:
        return known

    def digits(shift: int, wanted: dict[int, list[int]] | None):
        def run(batches):
            parts = []
            for row in blocks(batches, n_features, kind):
                g, v = values(*row)
                k = _sortable(np.ascontiguousarray(v, dtype=float))
                if wanted is not None:
                    g, k = _among(g, k, shift + DIGIT, wanted)
                parts.append(_tally(g, k >> np.uint64(shift)))
                if sum(len(p[0]) for p in parts) > PICK_ROWS:
                    parts = [_merged(parts)]
            g, p, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(p.view(np.int64)), pa.array(n)], ["g", "p", "n"])
        return run

    def fetch(shift: int, wanted: dict[int, list[int]] | None):
        def run(batches):
            for row in blocks(batches, n_features, kind):
                g, v = values(*row)
                k = _sortable(np.ascontiguousarray(v, dtype=float))
                if wanted is not None:
                    g, k = _among(g, k, shift, wanted)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(k.view(np.int64))], ["g", "k"])
        return run

    def fetched(shift: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        rows = packed.fetch(packed.df.mapInArrow(fetch(shift, wanted), "g long, k long"))
        return rows.column("g").to_numpy(), rows.column("k").to_numpy().view(np.uint64)

    if packed.rows <= PICK_ROWS:
        g, k = fetched(64, None)
        out = {}
        for group in np.unique(g).tolist():
            v = _unsortable(np.sort(k[g == group]))
            at = (len(v) - 1) * prob
            lo = math.floor(at)
            out[group] = float(v[lo] + (v[math.ceil(at)] - v[lo]) * (at - lo))
        return out
    shift, wanted, need = 64 - DIGIT, None, {}
    while True:
        # the first digits are sign, exponent and four more bits: few differ, so few tasks' counts need no exchange
        got = packed.gather(digits(shift, wanted), "g long, p long, n long", ["g", "p"], {"n": "sum"}, 1 << 12 if wanted is None else FEW_CELLS)
        gs, ps, ns = got.column("g").to_numpy(), got.column("p").to_numpy().view(np.uint64), got.column("n").to_numpy()
        order = np.lexsort((ps, gs))
        gs, ps, ns = gs[order], ps[order], ns[order]
        if wanted is None:
            for g in np.unique(gs).tolist():
                at = (int(ns[gs == g].sum()) - 1) * prob
                need[g] = (at, {None: (math.floor(at), math.ceil(at))})
        nxt, left = {}, 0
        for g, (at, ranks) in need.items():
            a, z = np.searchsorted(gs, [g, g + 1])
            found: dict = {}
            for prefix, local in ranks.items():
                here = slice(a, z) if prefix is None else a + np.flatnonzero(ps[a:z] >> np.uint64(DIGIT) == np.uint64(prefix))
                p, n = ps[here], ns[here]
                ends = np.cumsum(n)
                for r in local:
                    k = int(np.searchsorted(ends, r, "right"))
                    one = int(p[k])
                    found.setdefault(one, []).append(r - int(ends[k] - n[k]))
                    if one not in nxt.setdefault(g, []):
                        nxt[g].append(one)
                        left += int(n[k])
            need[g] = (at, {p: tuple(r) for p, r in found.items()})
        wanted = nxt
        if shift == 0 or left <= PICK_ROWS:
            break
        shift -= DIGIT
    g, k = fetched(shift, wanted) if shift else (None, None)
    out = {}
    for group, (at, ranks) in need.items():
        keys = []
        for p, local in ranks.items():
            v = None if g is None else np.sort(k[(g == group) & (k >> np.uint64(shift) == np.uint64(p))])
            keys += [p if v is None else int(v[r]) for r in local]
        v = _unsortable(np.array(sorted(keys), np.uint64))
        out[group] = float(v[0] + (v[-1] - v[0]) * (at - math.floor(at)))
    return out


def _tally(g: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows per (group, digits)."""
    out = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
    for group in _groups(g):
        digits, n = np.unique(p[g == group], return_counts=True)
        out.append((np.full(len(digits), group, np.int64), digits, n))
    return tuple(np.concatenate(c) for c in zip(*out))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, p, n = (np.concatenate(c) for c in zip(*(parts or [_tally(np.empty(0, np.int64), np.empty(0, np.uint64))])))
    order = np.lexsort((p, g))
    g, p, n = g[order], p[order], n[order]
    first = np.flatnonzero((np.diff(g, prepend=0) != 0) | (np.diff(p, prepend=np.uint64(0)) != 0) | (np.arange(len(g)) == 0))
    return g[first], p[first], np.add.reduceat(n, first) if len(first) else n


def _groups(g: np.ndarray) -> list[int]:
    if len(g) and g.min() >= 0 and g.max() < len(g):
        return np.flatnonzero(np.bincount(g)).tolist()
    return np.unique(g).tolist()


def _among(g: np.ndarray, k: np.ndarray, shift: int, wanted: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose value starts with a wanted prefix of their group."""
    prefix, keep = k >> np.uint64(shift), np.zeros(len(k), bool)
    for group, prefixes in wanted.items():
        keep |= (g == group) & np.isin(prefix, np.array(prefixes, np.uint64))
    return g[keep], k[keep]


def group_most(packed: Packed, values: Callable) -> dict[int, float]:
    """Largest value per group; ``values`` as in ``group_quantiles``."""
    n_features, kind = len(packed.features), packed.kind

    def run(batches):
        most: dict[int, float] = {}
        for row in blocks(batches, n_features, kind):
            g, v = values(*row)
            for group in _groups(g):
                most[group] = max(most.get(group, -math.inf), float(v[g == group].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], ["g", "v"])
    return {r["g"]: r["v"] for r in packed.gather(run, "g long, v double", ["g"], {"v": "max"}, 64).to_pylist()}


def group_sums(packed: Packed, values: Callable, most: bool = False) -> dict[int, tuple]:
    """Sum and number of a value per group, and with ``most`` the largest value; ``values`` as in ``group_quantiles``."""
    n_features, kind = len(packed.features), packed.kind
    how = {"s": "sum", "n": "sum", **({"m": "max"} if most else {})}

    def run(batches):
        total: dict[int, list] = {}
        for row in blocks(batches, n_features, kind):
            g, v = values(*row)
            for group in _groups(g):
                here = v[g == group]
                cell = total.setdefault(group, [0.0, 0, -math.inf])
                cell[0] += float(here.sum())
                cell[1] += len(here)
                cell[2] = max(cell[2], float(here.max()))
        cells = list(total.values())
        columns = [pa.array(list(total), pa.int64()), *(pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.float64(), pa.int64(), pa.float64())))]
        yield pa.RecordBatch.from_arrays(columns[:1 + len(how)], ["g", *how])
    rows = packed.gather(run, "g long, s double, n long" + ", m double" * most, ["g"], how, 64).to_pylist()
    return {r["g"]: tuple(r[c] for c in how) for r in rows}
