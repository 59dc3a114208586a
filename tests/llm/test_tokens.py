"""Token operators against the tokenizers library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import packing, records, separators
from faultline.llm.tokens import Encoder, default_path

TEXTS = [None, "", "  \n ", "Hello, World!", "a\nb  c\td", "İstanbul ΑΣ Σ é é <|endoftext|> x<|startoftext|>y", "\x01 \x00 z", "word " * 9000, '" # !', "don't we'll I'M", "  x​y"]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda x, special=False: (setattr(t, "encode_special_tokens", special), t.encode(x or "", add_special_tokens=False).ids)[1]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, ids string").repartition(3)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_chunked_encoding_is_the_whole_texts(texts):
    e = _ENCODERS["chunked"]
    got, n = e.encode(texts)
    want = [x.ids for x in _ENCODERS["plain"].tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want]
    assert got.tolist() == [i for x in want for i in x]


_ENCODERS = {"chunked": Encoder(limit=5), "plain": Encoder(chunked=False)}


def _crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_packing_round_trip(docs, ids):
    rows = packing.sequences(docs, group_tokens=4096).collect()
    texts = dict(enumerate(TEXTS))
    filled, seen = {}, {}
    for r in rows:
        want = [*ids(texts[r.doc_id]), 2]
        assert r.doc_tokens == len(want) and r.length > 0
        assert list(np.frombuffer(bytes(r.ids), "<u4")) == want[r.start : r.start + r.length]
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids(texts[d])) + 1
    assert set(seen) == set(texts)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60))
def test_first_fit_decreasing_is_the_plain_one(sizes):
    bins, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(bins))
        if k == len(bins):
            bins.append([])
            room.append(32)
        bins[k].append(i)
        room[k] -= sizes[i]
    assert packing.first_fit_decreasing(sizes, 32) == bins
    cut = packing.pack(sizes, 32)
    got = sorted((i, a, n) for seq in cut for i, a, n in seq)
    for i, size in enumerate(sizes):
        at = 0
        for _, a, n in (p for p in got if p[0] == i):
            assert a == at
            at += n
        assert at == size
    assert all((f := sum(n for _, _, n in seq)) == 32 or f & (f - 1) == 0 for seq in cut)


def test_records_round_trip(spark, docs, ids, tmp_path):
    path = f"file://{tmp_path}/shards"
    records.write(docs, path, shard_bytes=20_000)
    rows = {r.doc_id: r for r in records.read(spark, path).collect()}
    at = 0
    for i, t in enumerate(TEXTS):
        want = [*ids(t), 1]
        assert (rows[i].start, rows[i].n_tokens) == (at, len(want))
        assert bytes(rows[i].ids) == np.array(want, "<u4").tobytes()
        at += len(want)


def test_record_index_points_at_frames(docs, tmp_path):
    import struct
    from pathlib import Path

    records.write(docs, f"file://{tmp_path}/s", shard_bytes=20_000)
    shards = {p.name[:10]: p.read_bytes() for p in Path(tmp_path, "s/kind=0").glob("part-*")}
    n = 0
    for p in Path(tmp_path, "s/kind=1").glob("part-*"):
        data, shard = p.read_bytes(), shards[p.name[:10]]
        for k in range(0, len(data), 29):
            doc_id, offset, size, crc = struct.unpack_from("<qQQI", data, k)
            assert records.masked(data[k : k + 24]) == crc
            (payload,) = records.frames(shard[offset : offset + size])
            assert struct.unpack_from("<q", payload)[0] == doc_id
            n += 1
    assert n == len(TEXTS)


def test_damage_is_seen():
    good = records.frame(b"payload") + records.frame(b"x")
    assert [bytes(p) for p in records.frames(good)] == [b"payload", b"x"]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(Exception):
            list(records.frames(bytes(bad)))


def test_separator_scan(spark, docs, ids, tmp_path):
    path = f"file://{tmp_path}/flat"
    separators.write(docs, path)
    for block in (1, 7, 4096, 1 << 20):
        got = {r.doc_id: r.n_tokens for r in separators.counts(spark, path, block_ids=block).collect()}
        assert got == {i: len(ids(t, True)) for i, t in enumerate(TEXTS)}


def test_token_files_stay_small(spark, ids, tmp_path):
    """What one task writes is cut into files of few bytes, each read as one row: a text longer than a file, an empty one and a null
    one, which count as they do in one file."""
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(400)] + ["", None, "long " * 200_000] + ["a b"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: len(ids(t or "", True)) for i, t in enumerate(texts)}
    separators.write(docs, f"file://{tmp_path}/one")
    separators.write(docs, f"file://{tmp_path}/cut", file_bytes=1 << 12)
    for name in ("one", "cut"):
        got = separators.counts(spark, f"file://{tmp_path}/{name}", block_ids=100).collect()
        assert len(got) == len(texts) and {r.doc_id: r.n_tokens for r in got} == want
    sizes = [p.stat().st_size for p in (tmp_path / "cut" / "kind=0").rglob("part-*")]
    assert len(sizes) > 1 and sum(sizes) == 2 * (sum(want.values()) + len(texts))
    # With the query's own sizes: a task that has more than a file.
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 500).alias("text")).coalesce(1)
    separators.write(big, f"file://{tmp_path}/big")
    sizes = [p.stat().st_size for p in (tmp_path / "big" / "kind=0").rglob("part-*")]
    assert len(sizes) > 1 and max(sizes) <= 8 << 20 < sum(sizes)
    assert separators.counts(spark, f"file://{tmp_path}/big").count() == 6000


def test_nulls_repeats_and_nothing(spark, tmp_path):
    rows = [(None, "a b"), (None, None), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_tokens) for r in packing.sequences(docs).collect()) == [(False, 2), (False, 2), (True, 1), (True, 3)]
    records.write(docs, f"file://{tmp_path}/r")
    got = [(r.doc_id, r.start, r.n_tokens) for r in records.read(spark, f"file://{tmp_path}/r").orderBy("start").collect()]
    assert got in ([(None, 0, 1), (None, 1, 3), (3, 4, 2), (3, 6, 2)], [(None, 0, 3), (None, 3, 1), (3, 4, 2), (3, 6, 2)])
    separators.write(docs, f"file://{tmp_path}/f")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in separators.counts(spark, f"file://{tmp_path}/f").collect()) == [(0, 0), (0, 2), (3, 1), (3, 1)]
    none = docs.limit(0)
    assert packing.sequences(none).count() == 0
    records.write(none, f"file://{tmp_path}/r0")
    assert records.read(spark, f"file://{tmp_path}/r0").count() == 0
    separators.write(none, f"file://{tmp_path}/f0")
    assert separators.counts(spark, f"file://{tmp_path}/f0").count() == 0
