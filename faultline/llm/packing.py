"""Operator 2: packing by first-fit decreasing in randomised groups.

Documents become token ids with an end id. Pieces of at most one sequence's capacity go to groups at
random (a seeded hash of the task and of the piece's number in it, so equal rows spread too) and are written with their
groups, so a task that is run again cannot deal a piece to another group; each group is packed on its own by first-fit decreasing, with a tournament tree of bin capacities that finds
the leftmost bin with room in O(log bins). Documents may be cut, so gaps that first-fit leaves are filled from the
group's emptiest bins, and the one bin that stays partial is cut at powers of two, which need no padding.

Cases: null text counts as empty and yields the end id alone; null ``doc_id`` is carried through; repeated rows are
packed once each; texts of any length become as many pieces as needed; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens, words

_CHUNK = 1 << 19


class Tournament:
    """Leftmost bin with at least a given capacity; new bins open at the right."""

    def __init__(self, capacity: int, bins: int):
        self.capacity, self.used = capacity, 0
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [0] * (2 * self.leaves)

    def _set(self, i: int, room: int) -> None:
        best, i = self.best, i + self.leaves
        best[i] = room
        while i > 1:
            i >>= 1
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top

    def place(self, size: int) -> int:
        """Put an item into the leftmost bin with room, or a new one; the bin's number."""
        best = self.best
        if best[1] < size:
            bin_, room = self.used, self.capacity
            self.used += 1
        else:
            i = 1
            while i < self.leaves:
                i = 2 * i if best[2 * i] >= size else 2 * i + 1
            bin_, room = i - self.leaves, best[i]
        self._set(bin_, room - size)
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. Ties keep the order of the items."""
    tree = Tournament(capacity, len(sizes))
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, from, length): first-fit decreasing, then gaps filled from the emptiest bins."""
    bins = [[(i, 0, sizes[i]) for i in b] for b in first_fit_decreasing(sizes, capacity)]
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -fill[b])
    lo, hi = 0, len(order) - 1
    while lo < hi:
        into, out = order[lo], order[hi]
        room = capacity - fill[into]
        if not room:
            lo += 1
        elif not bins[out]:
            hi -= 1
        else:
            item, start, length = bins[out].pop()
            take = min(room, length)
            if take < length:
                bins[out].append((item, start + take, length - take))
            bins[into].append((item, start, take))
            fill[into] += take
            fill[out] -= take
    packed = [bins[b] for b in order if fill[b] == capacity]
    for b in (b for b in order if 0 < fill[b] < capacity):  # one at most
        rest, left = fill[b], list(reversed(bins[b]))
        while rest:
            size = want = 1 << (rest.bit_length() - 1)
            sequence = []
            while want:
                item, start, length = left.pop()
                take = min(want, length)
                sequence.append((item, start, take))
                if take < length:
                    left.append((item, start + take, length - take))
                want -= take
            packed.append(sequence)
            rest -= size
    return packed


def _binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of ``parts``; ends in bytes."""
    off = np.concatenate(([0], ends)).astype(np.int64)
    kind = pa.binary() if off[-1] < 1 << 31 else pa.large_binary()
    return pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(off.astype(np.int32 if kind == pa.binary() else np.int64)), pa.py_buffer(np.ascontiguousarray(parts))])


def sequences(
    docs: DataFrame, capacity: int = 4096, end_id: int = 2, tokenizer: str | None = None, chunked: bool = True, group_tokens: int = 1 << 20, seed: int = 17
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``group_tokens`` is the mean size of a group, whatever the size of the corpus; a group's pieces are held by one
    task. A sequence lies in one group.
    """
    docs = scratch.documents(docs)
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(8)), F.lit(0))).first()[0]
    groups = max(1, int(n_bytes) // (3 * group_tokens))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = tokens.encoder(tokenizer, chunked=chunked)
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens.trim()  # also of what other stages left
            text = batch.column("text").fill_null("") if batch.column("text").null_count else batch.column("text")
            _, off = words.buffers(text)
            for lo, hi in words.spans(off, _CHUNK):
                ids, n = enc.encode(text.slice(lo, hi - lo).to_pylist())
                at = np.cumsum(n)
                ids = np.insert(ids, at, end_id)  # after each document
                n = n + 1
                at = np.cumsum(n) - n
                pieces = -(-n // capacity)
                which = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, n[which] - start)
                small = ids.max() < 1 << 16
                raw = ids.astype("<u2" if small else "<u4").view(np.uint8)
                wide = 2 if small else 4
                salt = words.mix((np.arange(seen, seen + len(which)) + ((task << 40) + (seed << 20))).astype(np.uint64))
                seen += len(which)
                yield pa.record_batch(
                    [pa.array((salt % np.uint64(groups)).astype(np.int64)), batch.column("doc_id").slice(lo, hi - lo).take(pa.array(which)), pa.array(start), pa.array(length), pa.array(n[which]), pa.array(np.full(len(which), wide, np.int32)), _binary(raw, np.cumsum(length) * wide)],
                    ["grp", "doc_id", "start", "length", "doc_tokens", "wide", "ids"],
                )

    pieces = scratch.materialise(docs.mapInArrow(encode, "grp long, doc_id long, start long, length long, doc_tokens long, wide int, ids binary"), "pieces")

    def one_group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_tokens", "ascending"), ("doc_id", "ascending"), ("start", "ascending")]).combine_chunks()
        group = table.column("grp")[0].as_py()
        sizes = table.column("length").to_pylist()
        cut = [(i, s, n, q, o) for q, seq in enumerate(pack(sizes, capacity)) for (i, s, n), o in zip(seq, _offsets(seq))]
        item, start, length, seq, offset = (np.array([c[k] for c in cut], np.int64) for k in range(5))
        wide, ids = table.column("wide").to_pylist(), [x.as_buffer() for x in table.column("ids").combine_chunks()]
        raw = [np.frombuffer(ids[i], "<u2" if wide[i] == 2 else "<u4")[s : s + n] for i, s, n, _, _ in cut]
        take = pa.array(item)
        return pa.table(
            {
                "doc_id": table.column("doc_id").take(take),
                "start": pa.array(table.column("start").to_numpy()[item] + start),
                "length": pa.array(length),
                "ids": _binary(np.concatenate(raw).astype("<u4").view(np.uint8), np.cumsum(length) * 4),
                "doc_tokens": table.column("doc_tokens").take(take),
                "sequence_id": pa.array((np.int64(group) << 32) + seq),
                "offset": pa.array(offset),
            }
        )

    return pieces.groupBy("grp").applyInArrow(one_group, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _offsets(sequence: list[tuple[int, int, int]]) -> Iterator[int]:
    at = 0
    for _, _, n in sequence:
        yield at
        at += n
