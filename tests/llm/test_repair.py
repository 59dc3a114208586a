"""Repairs against a search over all edit strings, in plain Python."""

import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
import xxhash

from faultline.llm import queries, repair

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, at string, block int"


def spark_hash(*values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """One conversation after damage."""
    empty = hashlib.sha256(b"").hexdigest()
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", empty)
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), spark_hash(r[2], r[3])))
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # cheapest, then least string: a queue ordered by both reaches each state first by its best
    legal = lambda said, new: re.fullmatch("(s?(ua)*u?)?|s", said[-2:] + new) is not None

    def state(s, c):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((s, c))

    queue, done = [(0, "", 0, "", [])], set()
    while queue:
        cost, letters, i, s, lines = heapq.heappop(queue)
        if i == len(rows) and s in ("", "a"):
            break
        if (i, s) in done:
            continue
        done.add((i, s))
        for c, word in (("u", "user"), ("a", "assistant")):
            if (t := state(s, c)) is not None:
                heapq.heappush(queue, (cost + 2, letters + "I", i, t, [*lines, word + ":"]))
        if i < len(rows):
            heapq.heappush(queue, (cost + 3, letters + "D", i + 1, s, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if (t := state(s, initials[i])) is not None:
                    heapq.heappush(queue, (cost + more, letters + "K", i + 1, t, [*lines, f"{rows[i][2]}:{rows[i][3]}"]))
                for c, word in (("u", "user"), ("a", "assistant")):
                    if (t := state(s, c)) is not None:
                        heapq.heappush(queue, (cost + 2 + more, letters + "R", i + 1, t, [*lines, f"{word}:{rows[i][3]}"]))
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(rows, got):
    live = {r[0]: [] for r in rows}
    for r in damaged(rows):
        live[r[0]].append(r)
    assert len(got) == len(live) and {r.conv_id for r in got} == set(live)
    for r in got:
        assert tuple(r)[1:9] == plain(live[r.conv_id]), (r, live[r.conv_id])


def random_rows(rng, convs, longest):
    rows = []
    for c in range(convs):
        for turn in range(rng.integers(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "úser"], p=[0.42, 0.36, 0.1, 0.06, 0.03, 0.03])
            text = rng.choice(["Yes.", "No!", "cut off", " \n", "Why? ", "Ünï. \x0b", "a.b", f"Say {turn}.", f"say {turn}\nmore."])
            rows.append((c, None if rng.random() < 0.04 else int(turn + rng.integers(0, 2)), str(role), str(text), "z", 1))
    return rows


CASES = [
    (None, None, None, None, "z", 1), (None, 1, "user", "Null id.", "z", 1), (900, None, "assistant", "No turn.", "z", 1), (900, None, "user", "No turn.", "z", 1),
    (901, 5, "user", "", "z", 1), (902, -3, "user", "x" * 50_000 + ".", "z", 1), (902, 9, "assistant", "Far.", "z", 1), (903, 2, "system", "Only.", "z", 1),
] + [(904, 1, "user", "Copy.", "z", 1)] * 6 + [(905, t, "user", "Same again.", "z", 1) for t in range(12)]


def test_repairs(spark):
    rows = CASES + random_rows(np.random.default_rng(8), 120, 14)
    check(rows, repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_conversations_over_many_blocks(spark, monkeypatch):
    """Blocks of four rows: every longer conversation is threaded through several."""
    monkeypatch.setattr(repair, "_BLOCK", 2)
    rows = CASES + random_rows(np.random.default_rng(9), 25, 60)
    check(rows, repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_edges(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check([(gone, 0, "user", "Gone.", "z", 1)], repair.repair(spark.createDataFrame([(gone, 0, "user", "Gone.", "z", 1)], SCHEMA)).collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    d = f"/root/testdata/{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(rows, queries.op13_repair(spark, d).collect())
