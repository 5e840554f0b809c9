"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit (bounded, from training rows only): up to ``max_examples`` labelled
documents, half per class, by hash order. Terms are all words of the examples.
Up to ``max_terms`` words, and first four and five letters of words (stems of
inflected words), that toxic examples use clearly more often only weigh more;
their uses are counted over distinct left neighbours in distinct texts, so that
copies of one text count once. Examples become TF-IDF vectors, equal vectors are
merged, and the index stores posting lists in blocks of 64 examples with the
largest weight of each term in each block.

Search is exact: rare words find the examples, block maxima bound what frequent
words can add to a block, blocks are completed by falling bound, in doubling
steps, until the k-th best similarity is above the next bound; texts are
searched a few at a time and equal texts of a batch once. The vote of the k nearest, weighted by squared similarity, is mapped to
a probability by an isotonic fit on leave-one-out votes with the class shares
of all training rows. Every document of the corpus is scored from its whole
text; the nearest examples are its evidence.

Edge cases: a null or empty text, or one that shares no word with the examples,
gets the toxic share of such examples; null labels or ids never train; a doc_id labelled twice trains with
its largest label, one with several texts with the first in order; without training rows of both classes every score is the
toxic share (0 if nothing is labelled); repeated rows repeat their score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.common import materialise

MAX_EXAMPLES = 4000
MAX_TERMS = 512
MIN_Z = 5.0
MIN_LIFT = 3.0
MIN_CONTEXTS = 6
#: Share of a term's uses that do not follow its most frequent left neighbour; in copied passages the neighbours are the same.
MIN_SPREAD = 0.3
#: How much more a term of toxic examples weighs than its idf.
TOXIC_WEIGHT = 8.0
DENSITIES = 16
STEMS = (4, 5)
K = 16
BLOCK = 64
#: Blocks scored before the k-th best cosine is held against the bounds of the others.
FIRST_BLOCKS = 4
#: Terms of more than one in so many examples only complete cosines.
FREQUENT = 16
#: Texts that are searched together.
TOGETHER = 64

_TOKEN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The one tokeniser of examples and documents: runs of letters, lower-cased."""
    return _TOKEN.findall(text.lower())


def _tokenised(batches):
    for b in batches:
        words = [words_of(t.as_py() or "") for t in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "y", "w"])


def _weights(tf: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.array(sorted(tf), np.int64)
    w = (1 + np.log([tf[t] for t in terms.tolist()])) * idf[terms] if len(terms) else np.empty(0)
    norm = float(np.sqrt((w * w).sum())) if len(terms) else 0.0
    return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one after the other."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class BlockMaxIndex:
    """Posting lists of unit vectors in blocks, with the largest weight per term and block.

    Rare terms (the essential ones) have flat posting lists. Frequent terms
    are kept per block as a small matrix: they never find a vector, they only
    complete the cosines of blocks whose bound is high enough.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        lengths = [len(t) for t, _ in vectors]
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        w = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        row = np.repeat(np.arange(self.n), lengths)
        df = np.bincount(term, minlength=n_terms)
        often = np.flatnonzero(df > max(BLOCK // 4, self.n // FREQUENT))
        self.place = np.full(n_terms, -1, np.int32)  # of a frequent term among the frequent ones
        self.place[often] = np.arange(len(often))
        rare = self.place[term] < 0
        order = np.lexsort((row[rare], term[rare]))
        self.first = np.searchsorted(term[rare][order], np.arange(n_terms + 1))
        self.row, self.w = row[rare][order].astype(np.int32), w[rare][order]
        full = np.zeros((len(often), self.blocks * BLOCK))
        full[self.place[term[~rare]], row[~rare]] = w[~rare]
        self.full = np.ascontiguousarray(full.reshape(len(often), self.blocks, BLOCK).transpose(1, 0, 2))
        self.top = self.full.max(2).T  # (frequent terms, blocks)

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per query: rows and cosines of the k most similar vectors (cosine over 0; ties by row), and the blocks scored."""
        m, width = len(queries), self.blocks * BLOCK
        terms = np.concatenate([np.empty(0, np.int64), *(t for t, _ in queries)])
        w = np.concatenate([np.empty(0), *(w for _, w in queries)])
        who = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        place = self.place[terms]
        x = np.zeros((m, self.full.shape[1]))
        x[who[place >= 0], place[place >= 0]] = w[place >= 0]
        n = self.first[terms + 1] - self.first[terms]
        at = _spans(self.first[terms], n)
        sims = np.bincount(np.repeat(who * width, n) + self.row[at], np.repeat(w, n) * self.w[at], m * width).reshape(m, width).astype(float)
        # a block's bound: its best sum over rare terms, and the block maxima of the frequent ones
        bound = sims.reshape(m, self.blocks, BLOCK).max(2) + x @ self.top
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, 1)
        done, worst, scored, lo, step = np.zeros((m, self.blocks), bool), np.zeros(m), np.zeros(m, int), 0, FIRST_BLOCKS
        while lo < self.blocks:
            # a bound is a sum in another order than the cosine
            take = (ranked[:, lo:lo + step] >= worst[:, None] - 1e-12) & (ranked[:, lo:lo + step] > 0)
            if not take.any():
                break
            q, c = np.nonzero(take)
            block = order[q, lo + c]
            scored += take.sum(1)
            by_block = np.argsort(block, kind="stable")
            q, block = q[by_block], block[by_block]
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(block)]):
                b = int(block[a])
                sims[q[a:z], b * BLOCK:(b + 1) * BLOCK] += x[q[a:z]] @ self.full[b]
            done[q, block] = True
            if width >= k:
                seen = np.where(np.repeat(done, BLOCK, 1), sims, 0.0)
                worst = np.maximum(0.0, np.partition(seen, width - k, 1)[:, width - k])
            lo, step = lo + step, 2 * step
        out = []
        for i in range(m):
            rows = np.flatnonzero((sims[i] > 0) & (sims[i] >= worst[i]) & np.repeat(done[i], BLOCK))
            rows = rows[np.lexsort((rows, -sims[i, rows]))[:k]]
            out.append((rows, sims[i, rows], int(scored[i])))
        return out

    def nearest(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        return self.nearest_many([(terms, w)], k)[0]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators fit: knots and their values."""
    stack: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        stack.append([x[i], y[i] * w[i], w[i], x[i]])
        while len(stack) > 1 and (stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2] or stack[-2][3] == stack[-1][0]):
            a = stack.pop()
            stack[-1] = [stack[-1][0], stack[-1][1] + a[1], stack[-1][2] + a[2], a[3]]
    knots, values = [], []
    for lo, s, n, hi in stack:
        knots += [lo, hi]
        values += [s / n, s / n]
    return np.array(knots), np.array(values)


class Terms:
    """All words of the examples, the stems that toxic examples use more often, and a term per class of the density of such
    words and stems among all words; ``weight`` is per term."""

    def __init__(self, words: list[str], toxic: list[str]):
        self.ids = {t: i for i, t in enumerate(sorted({*words, *toxic}))}
        self.toxic, self.stems = set(toxic), {t[1:] for t in toxic if t[0] == "~"}
        self.density = len(self.ids)
        self.size = self.density + DENSITIES
        self.weight = np.ones(self.size)
        self.weight[[*(self.ids[t] for t in toxic), *range(self.density, self.size)]] = TOXIC_WEIGHT

    def counts(self, words: dict[str, int]) -> dict[int, int]:
        """Term counts of counted words."""
        ids, stems, out, hits = self.ids, self.stems, {}, 0
        for word, n in words.items():
            found = word in self.toxic
            if word in ids:
                out[ids[word]] = n
            for k in STEMS:
                if len(word) > k and word[:k] in stems:
                    t, found = ids["~" + word[:k]], True
                    out[t] = out.get(t, 0) + n
            hits += n * found
        if hits:
            out[self.density + min(DENSITIES - 1, int(2 * np.log2(1 + 200 * hits / sum(words.values()))))] = 3
        return out


class Model:
    """What the tasks need: terms, index, labels of the examples, calibration. Bounded by the fit's parameters."""

    def __init__(self, terms: Terms, idf: np.ndarray, examples: list, prior: float, k: int = K):
        self.terms, self.idf, self.k = terms, idf, k
        merged: dict[tuple, list] = {}
        zero = [0, 0]
        class_n = [max(1, sum(y == c for _, y, _ in examples)) for c in (0, 1)]
        weight = [(1 - prior) / class_n[0], prior / class_n[1]]
        for doc, y, tf in examples:
            t, w = _weights(tf, idf)
            if not len(t):
                zero[y] += 1
                continue
            m = merged.setdefault((t.tobytes(), np.round(w, 9).tobytes()), [t, w, [0, 0], doc])
            m[2][y] += 1
            m[3] = min(m[3], doc)
        # neighbours in order of their heaviest terms share blocks, which tightens the bounds
        rows = sorted(merged.values(), key=lambda m: (sorted(zip((-m[1]).tolist(), m[0].tolist()))[:8], m[3]))
        self.index = BlockMaxIndex([(m[0], m[1]) for m in rows], terms.size)
        self.votes = np.array([m[2] for m in rows], float).reshape(-1, 2) * np.array(weight)
        self.docs = [m[3] for m in rows]
        zero_w = [(zero[c] + (0.5 if c == 0 else 0.0)) * weight[c] for c in (0, 1)]
        self.base = zero_w[1] / (zero_w[0] + zero_w[1]) if sum(zero_w) else prior
        x, y, w = [], [], []
        every = [found for lo in range(0, len(rows), TOGETHER) for found in self.index.nearest_many([(m[0], m[1]) for m in rows[lo:lo + TOGETHER]], self.k)]
        for i, (m, found) in enumerate(zip(rows, every)):
            for c in (0, 1):
                if m[2][c]:
                    x.append(self._vote(found, without=(i, c, weight[c])))
                    y.append(c)
                    w.append(m[2][c] * weight[c])
        self.knots, self.values = isotonic(np.array(x), np.array(y, float), np.array(w)) if x else (np.zeros(1), np.full(1, prior))

    def _vote(self, found, without=None) -> float:
        rows, sims, _ = found
        votes = self.votes[rows].copy()
        if without:
            i, c, one = without
            votes[rows == i, c] = np.maximum(votes[rows == i, c] - one, 0)
        share = (sims * sims) @ votes if len(rows) else np.zeros(2)
        return float(share[1] / share.sum()) if share.sum() > 0 else 0.5

    def score_many(self, texts: list[str]) -> list[tuple[float, str]]:
        """(score, evidence) per text."""
        queries = [_weights(self.terms.counts(Counter(words_of(t))), self.idf) for t in texts]
        out = []
        for (terms, _), found in zip(queries, self.index.nearest_many(queries, self.k)):
            if not len(terms):
                out.append((self.base, ""))
                continue
            vote = self._vote(found)
            p = 0.98 * float(np.interp(vote, self.knots, self.values)) + 0.02 * vote
            best = zip(found[0][:3].tolist(), found[1][:3].tolist())
            out.append((min(1.0, max(0.0, p)), ",".join(f"{self.docs[r]}:{s:.3f}" for r, s in best)))
        return out


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Model:
    """Fit on at most ``max_examples`` training documents; everything collected is bounded by the two parameters."""
    train = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
             .filter("doc_id is not null and y in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")))
    train = materialise(train)
    share = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = share.get(1, 0) / max(1, sum(share.values()))
    half = [train.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2) for c in (0, 1)]
    chosen = materialise(half[0].unionByName(half[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most max_examples rows
    # an id with several texts counts with the first one in order
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = materialise(texts.mapInArrow(_tokenised, "doc_id long, y int, w array<string>"))
    texts = rows.dropDuplicates(["y", "w"])
    uses = texts.select("doc_id", "y", "w", F.posexplode("w").alias("i", "t")).select("doc_id", "y", "t", F.get("w", F.col("i") - 1).alias("before"))
    stems = [F.when(F.char_length("t") > n, F.concat(F.lit("~"), F.substring("t", 1, n))) for n in STEMS]
    uses = uses.select("doc_id", "y", "before", F.explode(F.array_compact(F.array("t", *stems))).alias("t"))
    spread = uses.select("y", "t", "before").distinct().groupBy("t").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    spread = materialise(spread.filter(F.col("a") + F.col("b") >= MIN_CONTEXTS))
    after = uses.groupBy("t", "before").agg(F.count("*").alias("n"))
    used = after.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    size = {r["y"]: r["n"] for r in uses.select("y", "t", "before").distinct().groupBy("y").agg(F.count("*").alias("n")).collect()}
    a_all, b_all = size.get(1), size.get(0)
    toxic: list[str] = []
    if a_all and b_all:
        per = spread.join(used, "t").filter(F.col("n") - F.col("most") >= MIN_SPREAD * F.col("n"))
        p = (F.col("a") + F.col("b")) / F.lit(float(a_all + b_all))
        z = (F.col("a") / F.lit(float(a_all)) - F.col("b") / F.lit(float(b_all))) / F.sqrt(p * (1 - p) * F.lit(1 / a_all + 1 / b_all))
        lifted = F.col("a") / F.lit(float(a_all)) >= MIN_LIFT * (F.col("b") + 1) / F.lit(float(b_all))
        top = per.withColumn("z", z).filter((F.col("z") >= MIN_Z) & lifted)
        toxic = [r["t"] for r in top.orderBy(F.desc("z"), "t").limit(max_terms).collect()]

    def counted(batches):
        for b in batches:
            found = [Counter(w.as_py()) for w in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(f) for f in found], pa.list_(pa.string())),
                                              pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))], ["doc_id", "y", "t", "n"])

    kept = rows.select("doc_id", "y", "w").mapInArrow(counted, "doc_id long, y int, t array<string>, n array<long>").toArrow().to_pydict()
    vocabulary = Terms([t for words in kept["t"] for t in words], toxic)
    examples = [(doc, y, vocabulary.counts(dict(zip(t, n)))) for doc, y, t, n in zip(*(kept[c] for c in ("doc_id", "y", "t", "n")))]
    df = np.zeros(vocabulary.size)
    for _, _, tf in examples:
        df[list(tf)] += 1
    idf = np.log((len(examples) + 1) / (df + 1)) * vocabulary.weight
    return Model(vocabulary, idf, sorted(examples, key=lambda e: e[0]), prior)


def _score(model: Model):
    def run(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(2)]
            distinct = list(dict.fromkeys(texts))
            known = {}
            for lo in range(0, len(distinct), TOGETHER):
                part = distinct[lo:lo + TOGETHER]
                known.update(zip(part, model.score_many(part)))
            got = [known[t] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in got], pa.float64()),
                                              pa.array([e for _, e in got], pa.string())], ["doc_id", "held_out", "score", "evidence"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **limits) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per document row."""
    model = fit(docs, labels, **limits)  # travels with the function, by value
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, evidence string")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
