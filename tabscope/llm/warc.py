"""WARC archives: deterministic sharded writer and reader.

Records are range-partitioned by page id into shards of about ``shard_bytes``
of payload. The ranges come from an exact histogram of payload bytes over a
fixed number of id cells, so they depend on the rows alone and not on how
Spark read them; a cell above the limit is divided by digest. Inside a shard
records are sorted, files roll by compressed size, every record is its own
gzip member, and headers, record ids and digests are made anew from the rows.

Commit: tasks write under temporary names that no other attempt uses and
return manifest rows; the manifest is stored first, then each file it names is
moved to its final name, and ``_manifest`` is written last. Files of lost or
repeated attempts are in no manifest.

Duplicates: among equal payloads of at least ``min_revisit`` bytes the one with
the largest page id is the response, the others are revisits of it. The
verdicts travel as slim rows into the sorted shard and stand right before the
record they belong to; hot payloads are joined by ``attach``.

Edge cases: a null payload is empty; null page ids come last and are one id;
of rows that repeat an id and payload the first is the response (if that id is
the largest) and the others revisit it; a null url is written as an empty one;
an empty table makes no files.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm.common import NULL_ID, attach, id_key, materialise
from tabscope.session import ensure_checkpoint_dir

CELLS = 1 << 14
SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6


def _fs(uri: str):
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page: int, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=sha1(f'{page}|{digest}|{nth}'.encode()).digest()[:16], version=5)}>"


def _page(page: int) -> str:
    return "" if page == NULL_ID else str(page)


def record(page: int, url: str, payload: bytes, refers_to: int | None, nth: int = 0) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP headers only."""
    digest = sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page, digest, nth)), ("WARC-Date", DATE),
            ("WARC-Target-URI", "".join(url.split())), ("WARC-Page-ID", _page(page)),
            ("WARC-Payload-Digest", "sha1:" + _b32(digest)), ("WARC-Block-Digest", "sha1:" + _b32(sha1(block).hexdigest()))]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _record_id(refers_to, digest, 0)), ("WARC-Refers-To-Page-ID", _page(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(base: str, roll: int, min_revisit: int, level: int):
    names = ["path", "temp", "shard", "seq", "records", "bytes"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        store, root = _fs(base)
        done, out, shard, seq, temp, size, records = [], None, None, 0, "", 0, 0
        last, nth, keep = None, 0, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"part-{shard:06d}-{seq:05d}.warc.gz", temp, shard, seq, records, size))
                out = None

        for b in batches:
            for sh, page, digest, kind, to, url, payload in zip(*(b.column(k).to_pylist() for k in range(7))):
                if (page, digest) != last:
                    last, nth, keep = (page, digest), 0, None
                if kind == 0:
                    keep = to
                    continue
                refers = keep if keep is not None else page if nth and len(payload) >= min_revisit else None
                if sh != shard:
                    close()
                    shard, seq = sh, 0
                elif out is not None and size >= roll:
                    close()
                    seq += 1
                if out is None:
                    temp, size, records = f"_temporary/{uuid.uuid4().hex}", 0, 0
                    store.create_dir(f"{root}/_temporary", recursive=True)
                    out = store.open_output_stream(f"{root}/{temp}", compression=None)
                    info = f"software: sharded writer\r\nformat: WARC File Format 1.1\r\nshard: {shard}-{seq}\r\n".encode()
                    data = _member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(shard, 'info', seq)}\r\nWARC-Date: {DATE}\r\n"
                                   f"Content-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n", level)
                    out.write(data)
                    size += len(data)
                data = _member(record(page, url, payload, refers, nth), level)
                out.write(data)
                size, records, nth = size + len(data), records + 1, nth + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 6, types)], names)
    return run


def _commit(base: str):
    def run(batches):
        store, root = _fs(base)
        for b in batches:
            for path, temp in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                from pyarrow import fs
                if store.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    store.move(f"{root}/{temp}", f"{root}/{path}")
            yield b
    return run


def _shards(slim: DataFrame, shard_bytes: int) -> tuple[dict, int]:
    """First shard and number of shards of every id cell, from exact byte sums; at most CELLS + 1 rows reach the driver."""
    lo, hi = slim.filter(F.col("page") != NULL_ID).agg(F.min("page"), F.max("page")).first()
    lo, hi = lo or 0, hi or 0
    cell = F.when(F.col("page") == NULL_ID, F.lit(CELLS)).otherwise(F.least(F.lit(CELLS - 1), F.floor(
        (F.col("page").cast("double") - F.lit(float(lo))) / F.lit(max(1.0, (float(hi) - float(lo) + 1) / CELLS))).cast("int")))
    sums = {r["cell"]: r["b"] for r in slim.groupBy(cell.alias("cell")).agg(F.sum(F.col("bytes") + 600).alias("b")).collect()}
    first, parts, at, room = [], [], -1, 0
    for c in range(CELLS + 1):
        b = sums.get(c, 0)
        if b > shard_bytes:
            first.append(at + 1)
            parts.append(-(-b // shard_bytes))
            at, room = at + parts[-1], 0
        else:
            if b > room:
                at, room = at + 1, shard_bytes
            first.append(max(at, 0))
            parts.append(1)
            room -= b
    ints = lambda a: F.from_json(F.lit(json.dumps(a)), "array<int>")
    shard = F.get(ints(first), F.col("cell")) + F.pmod(F.xxhash64("digest"), F.get(ints(parts), F.col("cell")).cast("long")).cast("int")
    return {"cell": cell, "shard": shard}, at + 1


def write_warc(pages: DataFrame, out_dir: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
               min_revisit: int = MIN_REVISIT, level: int = LEVEL) -> DataFrame:
    """Write one record per row; the manifest (path, shard, seq, records, bytes) is returned and stored in out_dir/_manifest."""
    text = F.coalesce("html", F.lit(""))
    full = pages.select(id_key("page_id").alias("page"), F.sha1(text).alias("digest"), F.coalesce("url", F.lit("")).alias("url"),
                        text.cast("binary").alias("payload"))
    slim = materialise(full.select("page", "digest", F.octet_length("payload").cast("long").alias("bytes")))
    how, n = _shards(slim, shard_bytes)
    same = slim.filter(F.col("bytes") >= min_revisit).groupBy("digest").agg(F.max("page").alias("keep"), F.min("page").alias("low"), F.count("*").alias("w"))
    same = materialise(same.filter("low < keep").drop("low"))
    refs = attach(slim, same, ["digest"], "w").filter("page < keep").select("page", "digest", "keep").distinct()
    verdicts = refs.select("page", "digest", F.lit(0).alias("kind"), "keep", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    rows = verdicts.unionByName(full.select("page", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keep"), "url", "payload"))
    rows = rows.withColumn("cell", how["cell"]).withColumn("shard", how["shard"]).drop("cell")
    rows = rows.repartitionById(max(n, 1), F.col("shard")).sortWithinPartitions("shard", "page", "digest", "kind", "url")
    rows = rows.select(F.col("shard").cast("long"), "page", "digest", "kind", "keep", "url", "payload")
    written = materialise(rows.mapInArrow(_write(out_dir, roll_bytes, min_revisit, level),
                                          "path string, temp string, shard long, seq long, records long, bytes long"))
    moved = materialise(written.mapInArrow(_commit(out_dir), written.schema))
    manifest = moved.drop("temp")
    manifest.write.parquet(f"{out_dir}/_manifest")
    store, root = _fs(out_dir)
    from pyarrow import fs
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    return manifest


def read_records(stream, chunk: int = 1 << 20):
    """(headers, block) of every record of an open .warc.gz stream, member by member."""
    z, data = zlib.decompressobj(31), bytearray()
    raw = b""
    while True:
        if not raw:
            raw = stream.read(chunk)
            if not raw:
                break
        data += z.decompress(raw)
        raw = z.unused_data
        if not z.eof:
            raw = b""
            continue
        z = zlib.decompressobj(31)
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        if lines[0] != "WARC/1.1" or len(rest) != size + 4:
            raise ValueError("damaged record")
        yield fields, rest[:size]
        data.clear()
    if data:
        raise ValueError("the last record is cut off")


def _read(base: str):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(text: str) -> int | None:
        return int(text) if text else None

    def run(batches):
        store, root = _fs(base)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    for f, block in read_records(stream):
                        if f["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        digest = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex()
                        if f["WARC-Block-Digest"] != "sha1:" + _b32(sha1(block).hexdigest()) or f["WARC-Type"] == "response" and (
                                len(payload) != size or sha1(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: wrong digest in {f['WARC-Record-ID']}")
                        rows.append((number(f["WARC-Page-ID"]), f["WARC-Target-URI"], size, digest, f["WARC-Type"],
                                     number(f["WARC-Refers-To-Page-ID"]) if f["WARC-Type"] == "revisit" else None))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
    return run


def read_warc(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per record that the manifest in ``out_dir`` lists, checked against its digests."""
    manifest = spark.read.parquet(f"{out_dir}/_manifest")
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n, "path").mapInArrow(
        _read(out_dir), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def scratch_dir(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
