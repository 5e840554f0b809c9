"""Token-id files in directly addressable codes.

An id is cut into chunks of 8, 8 and 16 bits, lowest first. Level 1 holds the
first chunk of every id of a file, level 2 the second chunk of those ids that
need one, and so on. Each level but the last has a continuation bitmap, one bit
per chunk, and a rank directory: the set bits before every block of 512. The
place of an id's next chunk is the rank of its bit, so any id is read with one
lookup per level and no block is decoded; a span of ids is a span of every level.

File: 8 bytes of magic, the length of a JSON header and the header (counts, and
the offset of every section), then document ids (null as the largest long), the
end offsets of the documents, and per level chunks, bitmap and directory, all
little-endian and aligned to 8 bytes.

Writing: texts are range-partitioned by (id, text hash, a running number that
splits equal rows) and sorted, tasks tokenise and write files of about
``roll`` ids under names that no other attempt uses, and return manifest rows
(one per file, with a CRC of its bytes). The manifest, ordered, gives every
file its first position; it is stored as a table in ``_manifest``. Files of
lost or repeated attempts are in no manifest and are never read.

Edge cases: a null text is empty and has only the end id; null document ids
come last; rows that repeat an id are documents of their own, ordered by text
hash; a document longer than a file has a file of its own; an empty table makes
an empty manifest.
"""

from __future__ import annotations

import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import NULL_ID, id_key, materialise
from tabscope.llm.warc import _fs

MAGIC = b"TOKDAC1\n"
WIDTHS = (8, 8, 16)
BLOCK = 512
ROLL = 1 << 22
PART_BYTES = 32 << 20
CACHE = 1 << 18
LINE = 64
_TYPES = {8: np.dtype("u1"), 16: np.dtype("<u2"), 32: np.dtype("<u4")}


# ---- the code ------------------------------------------------------------

def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes, rank directory) per level; bitmap and directory of the last level are empty."""
    if len(ids) and int(ids.max()) >> sum(widths):
        raise ValueError("an id needs more bits than all levels have")
    levels, rest = [], ids.astype(np.uint64)
    none = np.empty(0, np.uint8), np.empty(0, "<u8")
    for k, width in enumerate(widths):
        chunks = (rest & np.uint64((1 << width) - 1)).astype(_TYPES[width])
        rest = rest >> np.uint64(width)
        more = rest > 0
        if k == len(widths) - 1 or not more.any():
            levels.append((chunks, *none))
            break
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bitmap.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        levels.append((chunks, bitmap, (np.cumsum(ones) - ones).astype("<u8")))
        rest = rest[more]
    return levels


class TokenFile:
    """Random access to the ids and documents of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16:16 + size])
        self.n_ids, self.n_docs, self.widths = head["n_ids"], head["n_docs"], head["widths"]

        def section(name, kind):
            at, length = head["sections"][name]
            return np.frombuffer(data, kind, length, at)
        self.doc_ids, self.ends = section("doc_ids", "<i8"), section("ends", "<u8")
        self.levels = [(section(f"chunks{k}", _TYPES[w]), section(f"bitmap{k}", "u1"), section(f"ranks{k}", "<u8"))
                       for k, w in enumerate(self.widths)]

    def rank(self, level: int, i: int) -> int:
        """Set continuation bits before place ``i``."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        if block == len(ranks):  # the end of a full last block
            return int(ranks[-1]) + int(np.bitwise_count(bitmap[-BLOCK // 8:].view("<u8")).sum())
        bits = np.unpackbits(bitmap[block * BLOCK // 8:(i + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:i - block * BLOCK].sum())

    def token(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not len(bitmap) or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self.rank(k, i), shift + self.widths[k]
        return value

    def span(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids at places ``a`` to ``b`` (exclusive): a span of chunks on every level."""
        chunks, bitmap, _ = self.levels[level]
        out = chunks[a:b].astype("<u4")
        if len(bitmap) and b > a:
            bits = np.unpackbits(bitmap[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a]
            more = np.flatnonzero(bits)
            if len(more):
                at = self.rank(level, a)
                out[more] |= self.span(at, at + len(more), level + 1) << np.uint32(self.widths[level])
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def file_bytes(doc_ids: list[int], lengths: list[int], ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    levels = encode(ids, widths)
    parts = [("doc_ids", np.array(doc_ids, "<i8")), ("ends", np.cumsum(lengths).astype("<u8"))]
    for k, (chunks, bitmap, ranks) in enumerate(levels):
        parts += [(f"chunks{k}", chunks), (f"bitmap{k}", bitmap), (f"ranks{k}", ranks)]
    head = {"n_ids": len(ids), "n_docs": len(doc_ids), "widths": list(widths[:len(levels)]),
            "sections": {name: [10 ** 15, len(a)] for name, a in parts}}
    room = len(json.dumps(head)) // 8 * 8 + 16  # offsets have fewer digits than the stand-ins
    at = 16 + room
    for name, a in parts:
        head["sections"][name][0] = at
        at += a.nbytes + -a.nbytes % 8
    out = [MAGIC, room.to_bytes(8, "little"), json.dumps(head).encode().ljust(room)]
    for _, a in parts:
        out += [a.tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(out)


# ---- tokenising ----------------------------------------------------------

class WordEncoder:
    """Ids of texts, word by word, for tokenizers that lower-case and drop white space.

    Such a tokenizer never joins what white space parts, nor an ASCII letter and
    a following full stop or comma, so equal words are encoded once per call and
    the ``CACHE`` words met first once per task. ASCII words are lower-cased
    beforehand unless they may hold the string of a special token, which is
    matched before lower-casing.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.known, self.flat, self.size = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Plain ASCII words go to the tokenizer in lines of ``LINE``; a token's place in the line tells its word."""
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        one, other = words.filter(plain).to_pylist(), words.filter(pc.invert(plain))
        start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in one])]).astype(np.int64)
        lines = [" ".join(one[i:i + LINE]) for i in range(0, len(one), LINE)]
        found = self.tokenizer.encode_batch(lines, add_special_tokens=False)
        n = [len(e.ids) for e in found]
        flat = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32, sum(n))
        at = np.fromiter((o[0] for e in found for o in e.offsets), np.int64, sum(n)) + np.repeat(start[:-1][::LINE], n)
        size = np.empty(len(words), np.int64)
        rest, size_rest = TextEncoder(self.tokenizer)(other)
        here = plain.to_numpy(zero_copy_only=False)
        size[here] = np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(one) + 1)[:len(one)]
        size[~here] = size_rest
        out = np.empty(int(size.sum()), np.uint32)
        side = np.repeat(here, size)
        out[side], out[~side] = flat, rest
        return out, size

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id buffer, and the first place and number of ids of every word; all words differ."""
        place = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(place < 0)
        unseen = words.take(pa.array(new))
        flat, size = self._encode(unseen)
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        place[new] = len(self.size) + np.arange(len(new))
        first = np.cumsum(size) - size
        keep = min(CACHE - len(self.size), len(new))
        if keep > 0:
            self.known, self.size = pa.concat_arrays([self.known, unseen.slice(0, keep)]), size[:len(self.size) + keep]
            self.flat = flat[:int(self.size.sum())]
        return flat, first[place], size[place]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,]+)", r"\1 \2"))
        raw = words.flatten().dictionary_encode()
        lower = pc.and_(pc.string_is_ascii(raw.dictionary), pc.invert(pc.match_substring(raw.dictionary, "<|")))
        low = pc.if_else(lower, pc.ascii_lower(raw.dictionary), raw.dictionary).dictionary_encode()
        flat, first, size = self._ids(low.dictionary)
        index = low.indices.to_numpy()[raw.indices.to_numpy()]
        n = size[index]
        ends = np.cumsum(n)
        out = flat[np.repeat(first[index] - (ends - n), n) + np.arange(int(n.sum()))]
        return out, np.diff(np.concatenate([[0], ends])[words.offsets.to_numpy()])


class TextEncoder:
    """Ids of whole texts, for any other tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())), size


def _pieces(texts: pa.Array, limit: int = 8 << 20) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes, so that a batch's words stay few."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


# ---- Spark ---------------------------------------------------------------

_MANIFEST = "path string, first_id long, first_hash long, first_row long, n_docs long, n_ids long, bytes long, crc long"


def _write(base: str, tokenizer_path: str, end_id: int | None, by_word: bool, roll: int, widths: tuple[int, ...]):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        encoder = (WordEncoder if by_word else TextEncoder)(Tokenizer.from_file(tokenizer_path))
        store, root = _fs(base)
        rows, docs, sizes, parts, held, first = [], [], [], [], 0, None

        def close():
            nonlocal docs, sizes, parts, held, first
            if docs:
                data = file_bytes(docs, sizes, np.concatenate(parts), widths)
                path = f"{uuid.uuid4().hex}.tok"
                with store.open_output_stream(f"{root}/{path}", compression=None) as out:
                    out.write(data)
                rows.append((path, *first, len(docs), held, len(data), crc32(data)))
            docs, sizes, parts, held, first = [], [], [], 0, None

        store.create_dir(root, recursive=True)
        for b in batches:
            done = 0
            for texts in _pieces(b.column(3)):
                flat, size = encoder(texts)
                ends = np.cumsum(size)
                for k, (n, end) in enumerate(zip(size.tolist(), ends.tolist())):
                    i = done + k
                    if held and held + n >= roll:
                        close()
                    if first is None:
                        first = tuple(b.column(c)[i].as_py() for c in range(3))
                    docs.append(b.column(0)[i].as_py())
                    parts.append(flat[end - n:end])
                    if end_id is not None:
                        parts.append(np.array([end_id], np.uint32))
                        n += 1
                    sizes.append(n)
                    held += n
                done += len(texts)
        close()
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        types = [pa.string()] + [pa.int64()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)
    return run


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int | None = 1, by_word: bool = False,
                      roll: int = ROLL, part_bytes: int = PART_BYTES, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Tokenise and write all documents; returns the manifest (path, nth, start, n_docs, n_ids, bytes, crc)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    rows = docs.select(id_key().alias("id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    rows = rows.repartitionByRange(1 + total // part_bytes, "id", "h", "row").sortWithinPartitions("id", "h", "row")
    files = materialise(rows.mapInArrow(_write(out_dir, tokenizer_path, end_id, by_word, roll, widths), _MANIFEST))
    listed, start = [], 0
    # one row per file of up to ``roll`` ids
    for nth, f in enumerate(files.orderBy("first_id", "first_hash", "first_row").collect()):
        listed.append((f["path"], nth, start, f["n_docs"], f["n_ids"], f["bytes"], f["crc"]))
        start += f["n_ids"]
    manifest = spark.createDataFrame(listed, "path string, nth long, start long, n_docs long, n_ids long, bytes long, crc long")
    manifest.coalesce(1).write.parquet(f"{out_dir}/_manifest")
    return manifest


def _open(base: str, path: str, crc: int) -> TokenFile:
    store, root = _fs(base)
    with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
        data = stream.read()
    if crc32(data) != crc:
        raise ValueError(f"{path}: damaged")
    return TokenFile(data)


def _read(base: str):
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches):
        for b in batches:
            for path, start, crc in zip(*(b.column(k).to_pylist() for k in range(3))):
                f = _open(base, path, crc)
                ends = f.ends.astype(np.int64)
                begin = np.concatenate([[0], ends[:-1]])
                for lo in range(0, f.n_docs, 1024):
                    hi = min(f.n_docs, lo + 1024)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(f.doc_ids[lo:hi], mask=f.doc_ids[lo:hi] == NULL_ID), pa.array(begin[lo:hi] + start),
                        pa.array((ends - begin)[lo:hi]), pa.array([f.document(k).tobytes() for k in range(lo, hi)], pa.binary())], names)
    return run


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, in binary."""
    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    n = max(1, manifest.count())
    return manifest.repartitionById(n, F.col("nth").cast("int")).select("path", "start", "crc").mapInArrow(
        _read(out_dir), "doc_id long, start long, n_tokens long, ids binary")


def _lookup(base: str):
    def run(batches):
        path, f = None, None
        for b in batches:
            found = []
            for p, start, crc, position in zip(*(b.column(k).to_pylist() for k in range(4))):
                if p != path:
                    path, f = p, _open(base, p, crc)
                found.append(f.token(position - start))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(found, pa.int64())], ["position", "token"])
    return run


def tokens_at(positions: DataFrame, out_dir: str) -> DataFrame:
    """(position, token) for rows of ``position`` over all files; null or absent positions have a null token.

    Positions meet their file by its number, found in the ordered first
    positions of the files (one long per file).
    """
    spark = positions.sparkSession
    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    listed = [(r["start"], r["n_ids"]) for r in manifest.orderBy("nth").collect()]
    starts = [s for s, _ in listed]
    top = starts[-1] + listed[-1][1] if listed else 0

    def number(batches):
        for b in batches:
            nth = [bisect_right(starts, p) - 1 if p is not None and 0 <= p < top else None for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nth, pa.int64())], ["position", "nth"])
    placed = positions.select(F.col("position").cast("long")).mapInArrow(number, "position long, nth long")
    there = placed.filter("nth is not null").join(manifest, "nth").select("path", "start", "crc", "position")
    there = there.sortWithinPartitions("path").mapInArrow(_lookup(out_dir), "position long, token long")
    return there.unionByName(placed.filter("nth is null").select("position", F.lit(None).cast("long").alias("token")))
