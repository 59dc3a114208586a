"""Operator 5: token ids as length-delimited binary records, with a separate offset index.

A shard is a run of frames in ascending document order. A frame is

    payload length  u64 | masked CRC of those 8 bytes  u32 | payload | masked CRC of the payload  u32 | newline

all little-endian. The payload is the document id (i64), the id width in bytes (u8: 2 or 4), whether the document id
is null (u8), two zero bytes, then the ids. A masked CRC is CRC-32 rotated right by 15 bits plus a constant, so that
checksums of data that hold checksums stay sound. The index file beside each shard has a fixed 28-byte entry for each
frame: document id i64, byte offset u64, frame length u64, masked CRC of those 24 bytes u32, then newline; a shuffled
reader seeks by it. Files go through Spark's committer to any file system Spark writes, and a lost task is redone.

Cases: null text is the empty text, so its record holds the end id alone; null ``doc_id`` sorts first; repeated ids
are each a record, in the order of a hash of their texts; an empty table gives no shard and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

_HEAD, _META = "<QI", "<qBBH"
_META_SIZE = struct.calcsize(_META)
_CHUNK = 3 << 19


def masked(data) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(content: bytes) -> Iterator[memoryview]:
    """Payloads of a shard; a damaged frame raises."""
    view, at = memoryview(content), 0
    while at < len(view):
        n, crc = struct.unpack_from(_HEAD, view, at)
        if masked(view[at : at + 8]) != crc:
            raise ValueError(f"length checksum differs at byte {at}")
        payload = view[at + 12 : at + 12 + n]
        if len(payload) != n or struct.unpack_from("<I", view, at + 12 + n)[0] != masked(payload) or view[at + 16 + n] != 10:
            raise ValueError(f"payload checksum differs at byte {at}")
        yield payload
        at += n + 17


def write(docs: DataFrame, path: str, end_id: int | None = 1, tokenizer: str | None = None, chunked: bool = True, shard_bytes: int = 24 << 20) -> None:
    """Encode all texts and write shards under ``path`` (``kind=0`` records, ``kind=1`` index)."""
    docs = scratch.documents(docs)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(8)), F.lit(0))).first()[0]
    shards = max(1, -(-int(n_bytes) // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, chunked=chunked)
        seq = at = 0
        for batch in batches:
            text = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
            _, off = words.buffers(text)
            for lo, hi in words.spans(off, _CHUNK):
                ids, n = enc.encode(text.slice(lo, hi - lo).to_pylist())
                wide = 2 if max(int(ids.max(initial=0)), end_id or 0) < 1 << 16 else 4
                raw = memoryview(ids.astype(f"<u{wide}").tobytes())
                end = b"" if end_id is None else int(end_id).to_bytes(wide, "little")
                stops = (np.cumsum(n) * wide).tolist()
                records, entries, begin = [], [], 0
                for doc_id, stop in zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), stops):
                    records.append(frame(b"".join((struct.pack(_META, doc_id or 0, wide, doc_id is None, 0), raw[begin:stop], end))))
                    entry = struct.pack("<qQQ", doc_id or 0, at, len(records[-1]))
                    entries.append(entry + struct.pack("<I", masked(entry)) + b"\n")
                    at += len(records[-1])
                    begin = stop
                k = np.arange(seq, seq + len(records))
                seq += len(records)
                for kind, rows in ((0, [r[:-1] for r in records]), (1, [e[:-1] for e in entries])):
                    yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(rows, pa.binary())], ["kind", "seq", "frame"])

    # Rows of one id, null among them, are dealt out by a hash of their texts, so that none makes a shard of its own.
    docs = docs.withColumn("tie", F.xxhash64("text"))
    ordered = docs.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = ordered.select("doc_id", "text").mapInArrow(encode, "kind int, seq long, frame binary").sortWithinPartitions("kind", "seq")
    rows.select("kind", F.col("frame").cast("string").alias("value")).write.partitionBy("kind").option("lineSep", "\n").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the shards under ``path``: doc_id, start (ids of all documents before), n_tokens, ids (u32)."""
    schema = "shard int, doc_id long, start long, n_tokens long, ids binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                got: list[tuple] = []
                size = start = 0
                for p in frames(content.as_buffer()):
                    doc_id, wide, no_id, _ = struct.unpack_from(_META, p)
                    ids = np.frombuffer(p, f"<u{wide}", offset=_META_SIZE).astype("<u4").tobytes()
                    got.append((shard, None if no_id else doc_id, start, len(ids) // 4, ids))
                    start += len(ids) // 4
                    size += len(ids)
                    if size > _CHUNK:
                        yield _rows(got)
                        got, size = [], 0
                if got:
                    yield _rows(got)

    def _rows(got: list[tuple]) -> pa.RecordBatch:
        shard, doc_id, start, n, ids = zip(*got)
        return pa.record_batch([pa.array(shard, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["shard", "doc_id", "start", "n_tokens", "ids"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                view, at, n = memoryview(content.as_buffer()), 0, 0
                while at < len(view):
                    size, _ = struct.unpack_from(_HEAD, view, at)
                    n += (size - _META_SIZE) // view[at + 20]
                    at += size + 17
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([n], pa.int64())], ["shard", "n"])

    try:
        shards = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/kind=0")
    except Exception as e:  # no document, no shard
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).drop("shard")
    shards = shards.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    # One row per shard: what comes before each. Written first, so that its size is known when the join is planned.
    base = shards.mapInArrow(totals, "shard int, n long").select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    base = scratch.materialise(base, "bases")
    rows = shards.mapInArrow(parse, schema)
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
