"""Line dedup: drop lines that many documents share, keep the rest in place.

Every line gets a key (ends stripped, A-Z lower-cased). Keys are hashed to
128 bits once per document, counted with map-side partial aggregates, and
those found in at least ``min_docs`` documents lose all their lines but the
ones of the smallest ``doc_id`` that holds them. The texts are shuffled once,
by id, to meet their own list of dropped keys; no line text is shuffled.

Edge cases: a null or empty text is one empty line; a key shorter than
``min_chars`` code points is never dropped; a key repeated inside one document
counts once and, in the document that keeps it, all its lines stay; rows with
the same id are one document for the count, and each keeps its own text; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import WS_CHARS, attach, id_key, materialise, packed

_WS = WS_CHARS.encode()


def line_keys(text: bytes | None, min_chars: int) -> Iterator[tuple[bytes, bytes | None]]:
    """(line, digest of its key or None if the key is too short to count)."""
    for line in (text or b"").split(b"\n"):
        key = line.strip(_WS).lower()
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
            yield line, None
        else:
            yield line, blake2b(key, digest_size=16).digest()


def _keys_of_documents(min_chars: int):
    def run(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            out_id, digests = [], []
            for i, text in zip(ids, texts):
                found = {d for _, d in line_keys(text.as_py(), min_chars) if d}
                out_id += [i] * len(found)
                digests += found
            k = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(out_id, pa.int64())], ["k1", "k2", "id"])
    return run


def _reassemble(min_chars: int, text_at: int, names: list[str], counts: bool):
    def run(batches):
        for b in batches:
            columns = b.column(0).flatten()  # the rows as they came, in their order
            texts, drop = columns[text_at].cast(pa.binary()), b.column(1)
            n_lines, n_dropped, kept = [], [], []
            for text, d in zip(texts, drop):
                raw = text.as_py()
                gone = set()
                if d.is_valid:
                    k1, k2 = d.values.field(0).to_numpy(), d.values.field(1).to_numpy()
                    found = np.stack([k1, k2], 1).astype("<i8").tobytes()
                    gone = {found[i:i + 16] for i in range(0, len(found), 16)}
                lines = (raw or b"").split(b"\n")
                if gone:
                    stay = [ln for ln, key in line_keys(raw, min_chars) if key not in gone]
                    kept.append(b"\n".join(stay))
                else:
                    stay = lines
                    kept.append(raw or b"")
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            if counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def drop_shared_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, counts: bool = False) -> DataFrame:
    """All columns of ``docs`` with the shortened text, whatever their names; with ``counts`` also ``n_lines`` and ``n_dropped``."""
    keys = materialise(docs.select(id_key().alias("id"), "text").mapInArrow(
        _keys_of_documents(min_chars), "k1 long, k2 long, id long"))
    found = keys.groupBy("k1", "k2").agg(F.min("id").alias("keep"), F.max("id").alias("top"), F.count("*").alias("n"))
    found = found.filter((F.col("keep") < F.col("top")) & (F.col("n") >= min_docs)).drop("top")
    if min_docs > 2:  # repeated ids must not count twice
        found = found.drop("n").join(keys.distinct().groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"])
        found = found.filter(F.col("n") >= min_docs)
    found = materialise(found)
    drops = attach(keys, found, ["k1", "k2"], "n").filter(F.col("id") != F.col("keep"))
    per_doc = drops.groupBy("id").agg(F.collect_set(F.struct("k1", "k2")).alias("drop"))
    both = docs.select(id_key().alias("id"), packed(docs)).join(per_doc, "id", "left").select("row", "drop")
    fields = list(docs.schema.fields)
    if counts:
        fields += [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    text_at = [f.name.lower() for f in docs.schema.fields].index("text")
    return both.mapInArrow(_reassemble(min_chars, text_at, [f.name for f in fields], counts), T.StructType(fields))


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per document row."""
    return drop_shared_lines(docs.select("doc_id", "text"), min_chars, min_docs, counts=True)
