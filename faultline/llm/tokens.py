"""Token ids by a public tokenizer file, with a bounded cache of white-space chunks.

Chunks between a space or a newline never share a token under a tokenizer that splits on white space and drops
it (and lowers case), so each distinct chunk is encoded once per cache life and its ids are gathered for every occurrence. The ids
equal those of encoding the whole text; ``tests/llm`` compares both. A tokenizer of another kind must be used
with ``chunked=False``: it then encodes whole texts.
"""

from __future__ import annotations

import ctypes
import os
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa

DEFAULT = "word_bpe_49k.json"
#: Stands between chunks that are encoded in one text; a batch of chunks that has it is encoded chunk by chunk.
_MARK = "\x01"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Encoder:
    """Encodes lists of texts to flat ids and lengths. About ``limit`` chunks are kept, the first to come; others are
    encoded anew in each call, until they are a quarter of what comes."""

    def __init__(self, path: str | None = None, special_as_text: bool = False, chunked: bool = True, limit: int = 500_000):
        """``chunked`` is for tokenizers that drop white space and lower case, as the default one does."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = special_as_text
        self.chunked, self.limit, self.mark = chunked, limit, None
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.at, self.size, self.flat = array("q", [0]), array("i", [0]), array("I")

    def _batch(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of chunks. Many go in one text, apart by a mark that is one token: one text costs less than many."""
        if self.mark is None:
            ids = self._batch([_MARK])[0]
            self.mark = ids[0] if len(ids) == 1 else -1
        if self.mark >= 0 and not any(_MARK in c for c in chunks):
            groups = [chunks[i : i + 64] for i in range(0, len(chunks), 64)]
            flat: list[int] = []
            for ids in self._batch([f" {_MARK} ".join(g) + f" {_MARK}" for g in groups]):
                flat += ids
            ids = np.asarray(flat, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(chunks):
                return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1
        each = self._batch(chunks)
        return np.asarray([i for x in each for i in x], np.uint32), np.asarray([len(x) for x in each], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts in a row, and each text's number of ids (int64)."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.chunked:
            ids = [np.asarray(x, np.uint32) for x in self._batch(texts)]
            return np.concatenate(ids), np.asarray([len(x) for x in ids], np.int64)
        chunks: list[str] = []
        ends = []
        for t in texts:
            if "<|" not in t:
                t = t.encode().lower().decode()  # ASCII capitals only
            chunks += t.replace("\n", " ").split(" ")
            ends.append(len(chunks))
        which = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        absent = np.flatnonzero(which < 0)
        if len(self.index) > self.limit and 4 * len(absent) > len(chunks):  # the texts have changed: begin anew
            self._clear()
            return self.encode(texts)
        full, kept = len(self.index) > self.limit, (len(self.at), len(self.flat))
        if len(absent):
            index = {} if full else self.index
            new = list(dict.fromkeys([chunks[i] for i in absent.tolist()]))
            for lo in range(0, len(new), 50_000):
                part = new[lo : lo + 50_000]
                ids, size = self._chunks(part)
                index.update(zip(part, range(len(self.at), len(self.at) + len(part))))
                self.at.frombytes((np.cumsum(size) - size + len(self.flat)).astype(np.int64).tobytes())
                self.size.frombytes(size.astype(np.int32).tobytes())
                self.flat.frombytes(ids.tobytes())
            which[absent] = np.fromiter(map(index.__getitem__, [chunks[i] for i in absent.tolist()]), np.int64, len(absent))
        at, size = np.frombuffer(self.at, np.int64)[which], np.frombuffer(self.size, np.int32)[which].astype(np.int64)
        done = np.cumsum(size)
        place = np.repeat(at - (done - size), size) + np.arange(int(done[-1]))
        ids = np.frombuffer(self.flat, np.uint32)[place] if len(place) else np.zeros(0, np.uint32)
        if full:
            del self.at[kept[0] :], self.size[kept[0] :], self.flat[kept[1] :]
        return ids, np.diff(done[np.asarray(ends) - 1], prepend=0)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None, special_as_text: bool = False, chunked: bool = True) -> Encoder:
    """The worker's own encoder for these settings; workers are reused, so its cache lives across tasks."""
    key = (path, special_as_text, chunked)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text, chunked)
    return _encoders[key]


def trim() -> None:
    """Give free memory back to the system: what earlier batches and stages took stays with a worker otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def forget() -> None:
    """Give back what encoders hold; called where a worker, which is used again, turns to other work."""
    if _encoders:
        _encoders.clear()
        trim()
