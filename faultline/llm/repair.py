"""Operator 13: conversation structure repair over a bidirectional graph of tight arcs.

A conversation's rows are positions; at each there are four states: nothing said yet, after the system's word, after the
user's, after the assistant's. Arcs are edits: Delete, Insert, Keep, Rerole, with their costs; a conversation may end where
nothing is open. Least costs from the start (forward) and to the end (backward) tell which arcs lie on some cheapest repair:
forward cost, arc and backward cost add up to the whole. From the start, a set of states is carried along such arcs; at each
step the least letter that leaves any state of the set is taken, and the set becomes where it leads. Delete sorts first, so
what the letters spell is the least in ASCII order of all cheapest repairs, and a letter and a state fix the role they give.

Conversations may be of any length. Rows, sorted by conversation and turn through ranges, fall into blocks of at most 4,096. A
block's edits are, for each conversation in it, a 4x4 matrix of least costs; within a block prefixes and suffixes are products
of such matrices by doubling, over all conversations at once. Only a conversation that spans blocks needs more: its matrices
are multiplied block after block, then what each block makes of any set of states is followed from block to block.

Equal rows (conversation, turn, role and text) are one row with a number of copies: all but the first are duplicates, deleted
wherever they stand. Texts move only to be grouped and to be hashed. SHA-256 is a chain by its definition, so one task hashes
one conversation, reading sorted lines as they come: its time grows with that conversation, its memory does not.

Cases: null role or text is one space, as is a null in the key of the damage; null ``turn`` sorts first and is left out of
gaps; a null ``conv_id`` is a conversation; rows of one turn go by role, then by a hash of role and text; texts are told apart by
two 64-bit hashes; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1  # costs; CUT for a truncated row that stays
_INF = 1 << 40
_BLOCK = 12  # bits: rows of a block
_SEEN = r"[^\x20\x09-\x0D]"
_ROLES = {2: "user", 3: "assistant"}  # by the state they lead to
#: Where a role that is said, s u a, leads from a state; -1: nowhere.
_STEP = np.array([[1, 2, -1], [-1, 2, -1], [-1, -1, 3], [-1, 2, -1]])
_NEXT = np.array([2, 2, 3, 2])  # where a user's or assistant's word leads from a state
_END = np.array([0, 2 * INSERT, INSERT, 0])  # least cost to a state in which a conversation may end


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after damage with their number of ``copies``: conv, turn, role, text."""
    c = conversations.select(_conv(conversations["conv_id"]).alias("conv"), *(F.coalesce(conversations[k].cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")), conversations["conv_id"].alias("conv_id"), conversations["turn"].cast("long").alias("turn"))
    key = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    c = c.withColumn("k", F.crc32(key) % 20).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return c.select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("k") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _conv(c):
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _closure() -> np.ndarray:
    e = np.full((4, 4), _INF)
    for s in range(4):
        t, cost = s, 0
        while cost < e[s, t]:
            e[s, t] = cost
            t, cost = int(_NEXT[t]), cost + INSERT
    return e


_INSERTS = _closure()


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of matrices in which sums stand for products and minima for sums."""
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), _INF)


class Block:
    """Rows of a block in order, and the conversations they belong to."""

    def __init__(self, frame: pd.DataFrame):
        frame = frame.sort_values("at")
        self.frame, n = frame, len(frame)
        conv = frame.conv.to_numpy()
        new = np.r_[True, conv[1:] != conv[:-1]]
        self.starts = np.flatnonzero(new)
        self.stops = np.r_[self.starts[1:], n]
        self.of = np.cumsum(new) - 1  # each row's conversation
        self.place = np.arange(n) - self.starts[self.of]
        self.left = self.stops[self.of] - 1 - np.arange(n)
        self.names = conv[self.starts]
        self.role = frame.initial.to_numpy()
        self.copies = frame.copies.to_numpy()
        forced, cut = frame.forced.to_numpy(), frame.cut.to_numpy() * CUT
        rest = DELETE * (self.copies - 1)
        s = np.arange(4)
        self.delete = np.repeat((rest + DELETE)[:, None], 4, 1)
        self.keep, self.rerole = np.full((n, 4), _INF), np.full((n, 4), _INF)
        to = np.where(self.role[:, None] < 3, _STEP[:, np.minimum(self.role, 2)].T, -1)
        self.kept_to = to
        self.keep = np.where((to >= 0) & ~forced[:, None], (rest + cut)[:, None], _INF)
        self.rerole = np.where(forced, _INF, rest + cut + REROLE)[:, None].repeat(4, 1)
        arcs = np.full((n, 4, 4), _INF)
        arcs[:, s, s] = self.delete
        rows = np.arange(n)[:, None]
        np.minimum.at(arcs, (rows, s[None], np.maximum(to, 0)), self.keep)
        np.minimum.at(arcs, (rows, s[None], _NEXT[None].repeat(n, 0)), self.rerole)
        self.matrices = _times(np.broadcast_to(_INSERTS, (n, 4, 4)), arcs)

    def scan(self, items: np.ndarray, join, back: bool = False) -> np.ndarray:
        """Products of each row's item with all before it (or after it) in its conversation."""
        out, room, off = items.copy(), self.left if back else self.place, 1
        while True:
            at = np.flatnonzero(room >= off)
            if not len(at):
                return out
            out[at] = join(out[at], out[at + off]) if back else join(out[at - off], out[at])
            off *= 2

    def illegal(self) -> np.ndarray:
        """Adjacent initials that cannot follow each other, by conversation."""
        same = np.isin(self.role * 4 + self.role, _LEGAL, invert=True) * (self.copies - 1)
        pairs = np.r_[0, np.isin(self.role[:-1] * 4 + self.role[1:], _LEGAL, invert=True)] * (self.place > 0)
        return np.add.reduceat(same + pairs, self.starts)


_LEGAL = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]  # su ua au
_CHUNK = "conv string, block long, illegal long, head int, tail int, m array<long>"
_THREAD = "conv string, block long, forward array<long>, backward array<long>, total long, illegal long, last boolean"
_FOLLOW = "conv string, block long, entry int"
_DECIDED = "conv string, block long, at long, turn long, role string, h1 long, h2 long, before string, said string, audit string, cost long"


def summarise(frame: pd.DataFrame) -> pd.DataFrame:
    """For each conversation of a block: its matrix, its first and last initial, and illegal pairs."""
    b = Block(frame)
    product = b.scan(b.matrices, _times)[b.stops - 1]
    return pd.DataFrame({"conv": b.names, "block": frame.block.iloc[0], "illegal": b.illegal(), "head": b.role[b.starts], "tail": b.role[b.stops - 1], "m": [m.ravel().tolist() for m in product]})


def thread(frame: pd.DataFrame) -> pd.DataFrame:
    """Costs before and after each block of one conversation that spans blocks."""
    frame = frame.sort_values("block")
    m = np.stack(frame.m.to_numpy()).reshape(-1, 4, 4)
    forward, backward = [np.array([0, _INF, _INF, _INF])], [_END]
    for x in m[:-1]:
        forward.append(np.minimum((forward[-1][:, None] + x).min(0), _INF))
    for x in m[:0:-1]:
        backward.append(np.minimum((x + backward[-1][None]).min(1), _INF))
    backward.reverse()
    total = int((m[0] + backward[0][None]).min(1)[0])
    head, tail = frame["head"].to_numpy(), frame["tail"].to_numpy()
    between = np.r_[0, np.isin(tail[:-1] * 4 + head[1:], _LEGAL, invert=True)]
    return pd.DataFrame({"conv": frame.conv, "block": frame.block, "forward": [v.tolist() for v in forward], "backward": [v.tolist() for v in backward], "total": total, "illegal": between, "last": [False] * (len(m) - 1) + [True]})


def _bits(mask: np.ndarray) -> np.ndarray:
    return (mask << np.arange(4)).sum(1)


def _image(to: np.ndarray) -> np.ndarray:
    """What a set of states becomes, for all 16 sets, where state s goes to to[s] (-1: nowhere)."""
    out = np.zeros(16, np.int64)
    for s in range(4):
        if to[s] >= 0:
            out |= np.where(np.arange(16) >> s & 1, 1 << int(to[s]), 0)
    return out


_NEXT_SET = _image(_NEXT)
_KEPT_SET = np.stack([*(_image(_STEP[:, r]) for r in range(3)), np.zeros(16, np.int64)])


class Tight:
    """Arcs of a block that lie on cheapest repairs, and the walk along them."""

    def __init__(self, b: Block, forward: np.ndarray, backward: np.ndarray, total: np.ndarray):
        """forward: costs before each conversation's first row here; backward: after its last; total: of its repair."""
        self.block, of = b, b.of
        prefix = b.scan(b.matrices, _times)
        suffix = b.scan(b.matrices, _times, back=True)
        begun = np.repeat(np.where(np.eye(4, dtype=bool), 0, _INF)[None], len(of), 0)
        inner = np.flatnonzero(b.place > 0)
        begun[inner] = prefix[inner - 1]
        reach = np.minimum((forward[of][:, :, None] + begun).min(1), _INF)
        fore = np.minimum((reach[:, :, None] + _INSERTS[None]).min(1), _INF)
        back = np.minimum((suffix + backward[of][:, None, :]).min(2), _INF)
        after = backward[of].copy()
        more = np.flatnonzero(b.left > 0)
        after[more] = back[more + 1]
        whole = total[of][:, None]
        rows = np.arange(len(of))[:, None]
        self.inserts = _bits(fore + INSERT + back[:, _NEXT] == whole)
        self.deletes = _bits(fore + b.delete + after == whole)
        self.keeps = _bits((fore + b.keep + after[rows, np.maximum(b.kept_to, 0)] == whole) & (b.kept_to >= 0))
        self.reroles = _bits(fore + b.rerole + after[:, _NEXT] == whole)

    def step(self, sets: np.ndarray, at: np.ndarray):
        """From sets before the rows ``at``: sets after them, letters before (number of Inserts, sets they give) and own letter."""
        tail = (None,) * (sets.ndim - 1)
        pick = lambda v: v[at][(slice(None), *tail)]
        count, passed = np.zeros(sets.shape, np.int64), []
        for _ in range(2):  # more Inserts in one place would only undo each other
            go = ((sets & pick(self.deletes)) == 0) & ((sets & pick(self.inserts)) != 0)
            sets = np.where(go, _NEXT_SET[sets & pick(self.inserts)], sets)
            count += go
            passed.append(np.where(go, sets, 0))
        d, k, r = (sets & pick(v) for v in (self.deletes, self.keeps, self.reroles))
        letter = np.where(d > 0, 0, np.where(k > 0, 1, 2))
        kept = _KEPT_SET[np.broadcast_to(pick(self.block.role), sets.shape), k]
        return np.where(d > 0, d, np.where(k > 0, kept, _NEXT_SET[r])), count, passed, letter

    def maps(self) -> np.ndarray:
        """What each row, after those before it in its conversation, makes of each of the 16 sets."""
        n = len(self.block.of)
        after, *_ = self.step(np.repeat(np.arange(16)[None], n, 0), np.arange(n))
        return self.block.scan(after, lambda a, b: np.take_along_axis(b, a, 1))


def _edges(b: Block, threads: pd.DataFrame | None):
    """Costs around a block's conversations: of those in ``threads``, what they say; of others, those of a whole conversation."""
    k = len(b.names)
    forward, backward = np.repeat(np.array([[0, _INF, _INF, _INF]]), k, 0), np.repeat(_END[None], k, 0)
    total, last, entry, spans = np.full(k, -1), np.ones(k, bool), np.ones(k, np.int64), np.zeros(k, bool)
    at = {c: i for i, c in enumerate(b.names)}
    for t in () if threads is None else threads.itertuples():
        i = at[t.conv]
        forward[i], backward[i], total[i], last[i], spans[i] = t.forward, t.backward, t.total, t.last, True
        entry[i] = getattr(t, "entry", 1)
    return forward, backward, total, last, entry, spans


def _tight(frame: pd.DataFrame, threads: pd.DataFrame | None):
    b = Block(frame)
    forward, backward, total, last, entry, spans = _edges(b, threads)
    alone = np.flatnonzero(total < 0)
    if len(alone):
        product = b.scan(b.matrices, _times)[b.stops[alone] - 1]
        total[alone] = (product[:, 0, :] + _END[None]).min(1)
    return b, Tight(b, forward, backward, total), total, last, entry, spans


def follow_rows(frame: pd.DataFrame, threads: pd.DataFrame) -> pd.DataFrame:
    """For conversations that span blocks: what this block makes of each set of states."""
    b, tight, _, _, _, spans = _tight(frame, threads)
    maps = tight.maps()[b.stops - 1][spans]
    return pd.DataFrame({"conv": b.names[spans], "block": frame.block.iloc[0], "map": [m.tolist() for m in maps]})


def follow(frame: pd.DataFrame) -> pd.DataFrame:
    """The set of states in which the repair enters each block of one conversation."""
    frame, entry = frame.sort_values("block"), [1]
    for m in frame["map"].iloc[:-1]:
        entry.append(int(m[entry[-1]]))
    return pd.DataFrame({"conv": frame.conv, "block": frame.block, "entry": entry})


def decide(frame: pd.DataFrame, threads: pd.DataFrame) -> pd.DataFrame:
    """Lines that the repair leaves (``said`` null: only Inserts, ``before``), and for each conversation of the block its part
    of the audit and the cost."""
    if frame.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _DECIDED.split(", ")])
    b, tight, total, last, entry, _ = _tight(frame, threads)
    f, n, maps = b.frame, len(b.of), tight.maps()
    sets = entry[b.of]
    inner = np.flatnonzero(b.place > 0)
    sets[inner] = maps[inner - 1, sets[inner]]
    after, count, passed, letter = tight.step(sets, np.arange(n))
    state = lambda s: np.log2(np.maximum(s, 1)).astype(int)
    words = [np.array(["u", "u", "u", "a"])[state(p)] for p in passed]
    before = np.where(count == 0, "", np.where(count == 1, words[0], np.char.add(words[0], words[1])))
    said = np.where(letter == 1, f.role.to_numpy().astype(object), np.where(letter == 2, np.array([None, None, "user", "assistant"], object)[state(after)], None))
    letters = np.char.add(np.array(["", "I", "II"])[count], np.array(["D", "K", "R"])[letter]).tolist()
    for i in np.flatnonzero(b.copies > 1).tolist():
        letters[i] += "D" * int(b.copies[i] - 1)
    shown = (count > 0) | (letter > 0)
    lines = f[["conv", "block", "at", "turn", "role", "h1", "h2"]].assign(before=before, said=said, audit=None, cost=None)[shown]
    closing = np.array(["", "ua", "a", ""])[state(maps[b.stops - 1, entry])]
    closing = np.where(last, closing, "")
    audit = ["".join(letters[i:j]) + "I" * len(c) for i, j, c in zip(b.starts.tolist(), b.stops.tolist(), closing.tolist())]
    at = f["at"].to_numpy()[b.stops - 1]
    ends = pd.DataFrame({"conv": b.names, "block": f.block.iloc[0], "at": at, "turn": None, "role": None, "h1": None, "h2": None, "before": closing, "said": None, "audit": audit, "cost": total})
    out = pd.concat([lines.astype(object), ends.astype(object)])
    return out.where(out.notna(), None)


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lines of each conversation; rows come sorted by conversation and position."""
    name = digest = None
    for frame in frames:
        done = []
        for conv, before, line in zip(frame.conv, frame.before, frame.line):
            if conv != name:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest, first = conv, hashlib.sha256(), True
            for piece in (*(("user:" if c == "u" else "assistant:") for c in before), *(() if line is None else (line,))):
                digest.update(piece.encode() if first else b"\n" + piece.encode())
                first = False
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
    if digest:
        yield pd.DataFrame([(name, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def settle(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``turns`` (conv, turn, role, h1, h2, copies, initial, forced, cut): decisions (see ``decide``), and illegal pairs."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "h1", "h2"))]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = scratch.materialise(rows.withColumn("block", F.shiftright("at", _BLOCK)), "ordered")
    chunks = scratch.materialise(rows.groupBy("block").applyInPandas(summarise, _CHUNK), "chunks")
    many = chunks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    threads = scratch.materialise(chunks.join(many, "conv", "left_semi").groupBy("conv").applyInPandas(thread, _THREAD), "threads")
    met = rows.join(threads.select("block").distinct(), "block", "left_semi")
    maps = met.groupBy("block").cogroup(threads.groupBy("block")).applyInPandas(follow_rows, "conv string, block long, map array<int>")
    entries = scratch.materialise(maps.groupBy("conv").applyInPandas(follow, _FOLLOW), "entries")
    known = threads.join(entries, ["conv", "block"])
    decided = scratch.materialise(rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(decide, _DECIDED), "decided")
    illegal = chunks.select("conv", "illegal").unionByName(threads.select("conv", "illegal")).groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    return decided, illegal


def turns_of(conversations: DataFrame) -> DataFrame:
    """Distinct rows after damage, written, with copies, hashes, initial (0 s, 1 u, 2 a, 3 other), blank, cut and first (no
    earlier row of the conversation has its role and text)."""
    d = damage(conversations).groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    initial = F.substring("role", 1, 1)
    d = d.withColumns(
        {
            "h1": F.xxhash64("role", "text"),
            "h2": F.xxhash64(F.lit(1), "role", "text"),
            "initial": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3),
            "blank": ~F.col("text").rlike(_SEEN),
            "cut": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
        }
    )
    d = scratch.materialise(d, "turns")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = d.groupBy("conv", "h1", "h2").agg(F.min(turn).alias("f")).select(*(F.col(k).alias(f"f_{k}") for k in ("conv", "h1", "h2")), F.col("f.turn").alias("f_turn"))
    same = (F.col("conv") == F.col("f_conv")) & (F.col("h1") == F.col("f_h1")) & (F.col("h2") == F.col("f_h2")) & F.col("turn").eqNullSafe(F.col("f_turn"))
    return d.join(firsts, same, "left").select(*d.columns, F.col("f_conv").isNotNull().alias("first"))


def repair(conversations: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    d = scratch.materialise(turns_of(conversations), "marked")
    alive = ~F.col("blank") & F.col("first")
    n = lambda c: F.sum(c).cast("long")
    none = F.lit(0).cast("long")
    found = d.groupBy("conv").agg(
        n(F.when(F.col("blank"), F.col("copies")).otherwise(none)).alias("blank"),
        n(F.when(~F.col("blank"), F.col("copies") - F.col("first").cast("long")).otherwise(none)).alias("duplicate"),
        n((alive & F.col("cut")).cast("long")).alias("truncated"),
        (F.max("turn") - F.min("turn") + 1).alias("span"),
    )
    turns = d.groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.count("turn").alias("turns"))
    decided, illegal = settle(d.select("conv", "turn", "role", "h1", "h2", "copies", "initial", (~alive).alias("forced"), "cut"))
    audits = decided.where("audit is not null").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("a"), F.max("cost").alias("cost"))
    audits = audits.select("conv", "cost", F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))

    keys = ["conv", "turn", "role", "h1", "h2"]
    said = decided.where("said is not null")
    t = d.select(*(F.col(k).alias(f"t_{k}") for k in keys), "text")
    same = (F.col("conv") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn")) & (F.col("role") == F.col("t_role")) & (F.col("h1") == F.col("t_h1")) & (F.col("h2") == F.col("t_h2"))
    lines = said.join(t, same).select("conv", "at", F.lit(0).alias("last"), "before", F.concat("said", F.lit(":"), "text").alias("line"))
    silent = decided.where("said is null and before <> ''").select("conv", "at", F.col("audit").isNotNull().cast("int").alias("last"), "before", F.lit(None).cast("string").alias("line"))
    sorted_ = lines.unionByName(silent).repartition("conv").sortWithinPartitions("conv", "at", "last")
    digests = sorted_.select("conv", "before", "line").mapInPandas(hashed, "conv string, repaired_sha256 string")

    out = conversations.select(conversations["conv_id"].alias("conv_id")).distinct().withColumn("conv", _conv(F.col("conv_id")))
    for part in (found, turns, illegal, audits, digests):
        out = out.join(scratch.materialise(part, "part"), "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "conv_id",
        zero(F.col("span") - F.col("turns")).alias("gaps"),
        *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
