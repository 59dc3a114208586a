"""Vectorised word splitting and hashing over Arrow text buffers.

Texts stay UTF-8 bytes. A word class is a 256-entry byte table: word bytes map to themselves (ASCII capitals to
lower case where asked), all other bytes to 0. Non-ASCII code points consist of bytes >= 0x80 only, so a class
that takes all of them, or none, is exact on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_powers: dict[int, np.ndarray] = {}


def _class(is_word, lower: bool) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        if is_word(c):
            t[b] = c
    return t


#: Runs of bytes other than white space, ASCII capitals lowered.
NON_SPACE = _class(lambda c: c != 0x20 and not 0x09 <= c <= 0x0D and c != 0, True)
NON_SPACE[0] = 0xFF  # a word character; no UTF-8 text has this byte
#: ASCII digits and letters (lowered) and all non-ASCII characters.
ALNUM = _class(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80, True)
#: ASCII digits and letters (lowered) alone.
ASCII = _class(lambda c: 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A, True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(offsets: np.ndarray, limit: int, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together, or that are one row; of ``rows`` rows at most."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, _SEGMENT + 1), base, np.uint64)
        p[0] = 1
        have = _powers[base] = np.multiply.accumulate(p)
        if n > 4 * _SEGMENT:
            _powers.pop(base)  # of one very long word; not worth keeping
    return have


class Words:
    """Words of a run of texts: byte starts and ends, first word of each text, lowered bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.low = low = table[data]
        n = len(low)
        isw = low != 0
        s, e = isw.copy(), isw.copy()
        if n:
            s[1:] &= ~isw[:-1]
            e[:-1] &= ~isw[1:]
            cut = offsets[(offsets > 0) & (offsets < n)]
            s[cut] = isw[cut]
            e[cut - 1] = isw[cut - 1]
        self.start = np.flatnonzero(s)
        self.end = np.flatnonzero(e) + 1
        self.first = np.searchsorted(self.start, offsets)  # words before each text, and in all
        self.count = np.diff(self.first)

    def text(self, a: int, b: int) -> bytes:
        """Words a..b-1 joined by single spaces."""
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist()))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands."""
        start, end, low = self.start, self.end, self.low
        out = np.empty(len(start), np.uint64)
        a = 0
        while a < len(start):
            b = max(a + 1, int(np.searchsorted(end, start[a] + _SEGMENT, "right")))
            lo, hi = int(start[a]), int(end[b - 1])
            p = _power(_BASE, hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(low[lo:hi].astype(np.uint64) * p[: hi - lo], out=sums[1:])
            s, e = start[a:b] - lo, end[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * _power(_INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64)
            a = b
        return mix(out)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive word hashes; the caller drops those that cross texts."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + m]
    return mix(h)


def sieve(table: np.ndarray) -> np.ndarray:
    """Which values of sixteen bits end some hash of the table."""
    small = np.zeros(1 << 16, bool)
    small[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    return small


def member(hashes: np.ndarray, table: np.ndarray, small: np.ndarray) -> np.ndarray:
    """Positions of hashes that are in the sorted table; its sieve drops most others."""
    near = np.flatnonzero(small[(hashes & np.uint64(0xFFFF)).astype(np.uint16)])
    h = hashes[near]
    i = np.searchsorted(table, h)
    i[i == len(table)] = 0
    return near[table[i] == h] if len(table) else near[:0]
