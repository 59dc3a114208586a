"""Operator 7: token counts by a separator scan over flat, unindexed token files.

Token files are nothing but ids of two bytes (little-endian) with an end-of-document id after each document. The scan
cuts files into blocks, finds end ids in each block with one vectorised comparison, and keeps three numbers and a list
per block: ids before its first end, ids after its last, ends in it, and the lengths between. A prefix scan over
the blocks of a file carries the open document and the document ordinal from block to block, so no block needs
another's ids.

The end id is the vocabulary's own ``<|endoftext|>``; the encoder treats that string in a text as ordinary text, so
the id cannot occur inside a document. Document ids lie in a second file in the same order, ten bytes each: the id and the
end id, which is what the writer puts after every row.

A file is read as one row, so a task that writes begins another one (``cut``) where the next step would take it beyond
``file_bytes``: how much of the corpus a task gets decides how many files it writes, not how large they are.

Cases: null text is empty and counts 0 ids; null ``doc_id`` comes back null; repeated rows are separate documents; a
document may span any number of blocks; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch, tokens, words

END_ID = 49407
_NO_ID = -(1 << 63)
_ENTRY = np.dtype([("doc_id", "<i8"), ("end", "<u2")])
_CHUNK = 1 << 19


def write(docs: DataFrame, path: str, tokenizer: str | None = None, chunked: bool = True, end_id: int = END_ID, file_bytes: int = 8 << 20) -> None:
    """Flat token files under ``path/kind=0``, document ids under ``path/kind=1``; no shuffle. A token file has at most
    ``file_bytes``, or the ids of one step of 512 KB of text or of one longer text."""
    docs = scratch.documents(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer, special_as_text=True, chunked=chunked)
        seq = cut = size = 0
        for batch in batches:
            tokens.trim()
            text = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
            _, off = words.buffers(text)
            for lo, hi in words.spans(off, _CHUNK):
                ids, n = enc.encode(text.slice(lo, hi - lo).to_pylist())
                if len(ids) and int(ids.max()) >= 1 << 16 or (ids == end_id).any():
                    raise ValueError("ids must fit two bytes and leave the end id free")
                flat = np.insert(ids.astype("<u2"), np.cumsum(n), end_id)[:-1].tobytes()  # the writer adds the last end
                who = np.full(hi - lo, end_id, _ENTRY)
                who["doc_id"] = batch.column("doc_id").slice(lo, hi - lo).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                if size and size + len(flat) + 2 > file_bytes:
                    cut, size = cut + 1, 0
                size += len(flat) + 2
                rows = [flat, who.tobytes()[:-2]]
                yield pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([cut, cut], pa.int32()), pa.array([seq, seq], pa.int64()), pa.array(rows, pa.binary())], ["kind", "cut", "seq", "bytes"])
                seq += 1

    rows = docs.mapInArrow(encode, "kind int, cut int, seq long, bytes binary").sortWithinPartitions("kind", "cut", "seq")
    lines = rows.select("kind", "cut", F.col("bytes").cast("string").alias("value"))
    lines.write.partitionBy("kind", "cut").option("encoding", "ISO-8859-1").option("lineSep", int(end_id).to_bytes(2, "little").decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str, kind: int) -> DataFrame:
    """Token files (0) or files of document ids (1): file, a number by task and cut that is the same for both, and content."""
    found = spark.read.format("binaryFile").load(f"{path.rstrip('/')}/kind={kind}")
    part = F.regexp_extract("path", r"part-(\d+)[^/]*\z", 1).cast("long")
    return found.select((F.shiftleft(part, 32) + F.regexp_extract("path", r"/cut=(\d+)/[^/]*\z", 1).cast("long")).alias("file"), "content")


def scan(files: DataFrame, end_id: int = END_ID, block_ids: int = 1 << 20) -> DataFrame:
    """Lengths of the documents of token files (file, content): file, ordinal (from 0), n_tokens without the end id."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for k, lo in enumerate(range(0, len(ids), block_ids)):
                    part = ids[lo : lo + block_ids]
                    at = np.flatnonzero(part == end_id)
                    head, tail = (at[0], len(part) - at[-1] - 1) if len(at) else (0, len(part))
                    yield pa.record_batch(
                        [pa.array([file], pa.int64()), pa.array([k], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                        ["file", "block", "ends", "head", "tail", "between"],
                    )

    found = files.mapInArrow(blocks, "file long, block int, ends long, head long, tail long, between array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"open": F.coalesce(F.sum("tail").over(before), F.lit(0)), "ordinal": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    since = F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("open")), ignorenulls=True).over(before), F.lit(0))
    found = found.withColumn("carried", F.col("open") - since).where("ends > 0")
    lengths = F.concat(F.array(F.col("carried") + F.col("head")), F.col("between"))
    return found.select("file", "ordinal", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens")


def counts(spark: SparkSession, path: str, end_id: int = END_ID, block_ids: int = 1 << 20) -> DataFrame:
    """doc_id and n_tokens of every document in the token files under ``path``."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                who = np.frombuffer(content.as_buffer(), _ENTRY)["doc_id"].astype(np.int64)
                for lo in range(0, len(who), 1 << 16):
                    part = who[lo : lo + (1 << 16)]
                    yield pa.record_batch([pa.array(np.full(len(part), file, np.int64)), pa.array(np.arange(lo, lo + len(part))), pa.array(part, mask=part == _NO_ID)], ["file", "ordinal", "doc_id"])

    try:
        files = _files(spark, path, 0)
    except Exception as e:  # no document, no file
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "doc_id long, n_tokens long")
    who = _files(spark, path, 1).mapInArrow(listed, "file long, ordinal long, doc_id long")
    return who.join(scan(files, end_id, block_ids), ["file", "ordinal"]).select("doc_id", "n_tokens")
