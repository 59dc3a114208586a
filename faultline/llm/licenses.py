"""Operator 6: license scans by conditional compression.

Templates are short notices and whole license texts. Where at least ``least`` of a template's words stand in a text, in
order, some run of its words stands there unbroken: the templates' runs of up to six words (as many as the number of
words that may be missing guarantees) are searched in every text, and where enough of one template's runs lie on one
line of offsets, the words that the template would take up there, and room for its missing words, are a candidate.
Candidates that touch form a block, of any length. A block's words are compressed on their own and with each template's
as a zstandard raw-content dictionary, and templates are ranked by how much smaller they get. In that order wording
decides: the words of a candidate and of its template are aligned, and if at least ``least`` of the template's words are
there, the license is found and its words are taken from the block; of templates that save nearly the same, the one with
the fewest differences (missing and further words) comes first. The words that differ are reported. A block no
template fits is reported without a license where ``unknown`` asks for it.

A wording that is broken, by missing or further words, at more than about one word in eight is no candidate; line
breaks, comment marks, quotes and other signs are no words and break nothing.

Cases: null and empty texts have no blocks; text in any letters is compared in ASCII lower case; equal blocks are judged
once per worker (a cache bounded in bytes) and reported for each place; a block begins with the copyright lines right
above its wording; several licenses, and several copies of one, in a block are each reported; repeated rows are each
reported; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import scratch, tokens, words

# Public license wording; whole texts are in wording/.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-text": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}
TEMPLATES = NOTICES | {f.name[:-4]: f.read_text() for f in sorted(files(__package__).joinpath("wording").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
_RUN, _GRAM = 6, 8  # longest run that is searched; words of a gram that aligns long texts
_COPYRIGHT = re.compile(rb"[^0-9A-Za-z\n]*(?:copyright|\(c\)|\xc2\xa9)[^\n]*\n\Z", re.I)
_CACHE = 16 << 20
_NEAR = 0.1  # savings that are told apart by wording alone
_CHUNK = 4 << 20


def _matches(want: list, have: list) -> list[tuple[int, int, int]]:
    """Runs (from in ``want``, from in ``have``, size) of an alignment. Long lists are cut at grams that both have once."""
    if len(want) < 4 * _GRAM:
        return [tuple(m) for m in SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]

    def once(x: list) -> dict[tuple, int]:
        at: dict[tuple, int] = {}
        for i in range(len(x) - _GRAM + 1):
            g = tuple(x[i : i + _GRAM])
            at[g] = -1 if g in at else i
        return at

    there = once(have)
    pairs = [(i, there[g]) for g, i in once(want).items() if i >= 0 and there.get(g, -1) >= 0]
    tails: list[int] = []
    back: list[tuple[int, int]] = []  # of each pair: its length in the longest rising chain, and the pair before it
    last: list[int] = []
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        back.append((n, last[n - 1] if n else -1))
        tails[n : n + 1], last[n : n + 1] = [j], [k]
    chain, k = [], last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k][1]
    out, a, b = [], 0, 0
    for i, j in [*reversed(chain), (len(want), len(have))]:
        if i < a or j < b:
            continue
        if i > a and j > b:
            out += [(a + m.a, b + m.b, m.size) for m in SequenceMatcher(None, want[a:i], have[b:j], autojunk=False).get_matching_blocks() if m.size]
        size = 0
        while i + size < len(want) and j + size < len(have) and want[i + size] == have[j + size]:
            size += 1
        if size:
            out.append((i, j, size))
        a, b = i + size, j + size
    return out


class Judge:
    """Finds candidates, ranks templates for a block and confirms them by their wording."""

    def __init__(self, templates: dict[str, str], least: float, level: int = 3):
        import zstandard as z

        self.least, self.level = least, level
        self.names = sorted(templates)
        self.words, grams = [], []
        self.run, self.enough, self.room = [], [], []
        for t, name in enumerate(self.names):
            w = words.Words(*self._bytes(templates[name]), words.ASCII)
            n = len(w.start)
            self.words.append([w.low[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist())])
            missing = int(n * (1 - least) + 1e-9)
            run = min(_RUN, -(-(n - missing) // (missing + 1))) or 1
            self.run.append(run)
            self.room.append(2 * missing)
            self.enough.append(max(1, int(n * (1 - 1.3 * run * (1 - least))) - run))
            grams += [(run, h, t, o) for o, h in enumerate(words.shingles(w.hashes(), run).tolist())]
        self.counts = [Counter(w) for w in self.words]
        self.index = {}
        for k in sorted({g[0] for g in grams}):
            h, t, o = (np.array(x, d) for x, d in zip(list(zip(*sorted(g[1:] for g in grams if g[0] == k))), (np.uint64, np.int64, np.int64)))
            uniq, first = np.unique(h, return_index=True)
            self.index[k] = (uniq, words.sieve(uniq), np.append(first, len(h)), t, o)
        self.given = {n: z.ZstdCompressionDict(b" ".join(w), dict_type=z.DICT_TYPE_RAWCONTENT) for n, w in zip(self.names, self.words) if w}
        for d in self.given.values():
            d.precompute_compress(level=level)
        self.known: dict[tuple, list] = {}
        self.held = 0

    @staticmethod
    def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode(), np.uint8)
        return data, np.array([0, len(data)])

    def hits(self, w: words.Words) -> np.ndarray:
        """Rows of text number, word, template and the template's word for each run that a text has; by text."""
        h, found = w.hashes(), []
        for k, (uniq, small, first, t, o) in self.index.items():
            s = words.shingles(h, k)
            at = words.member(s, uniq, small)
            doc = np.searchsorted(w.first, at, "right") - 1
            inside = at + k <= w.first[doc + 1]
            at, doc = at[inside], doc[inside]
            row = np.searchsorted(uniq, s[at])
            many = first[row + 1] - first[row]
            each = np.repeat(first[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found.append(np.stack([np.repeat(doc, many), np.repeat(at - w.first[doc], many), t[each], o[each]], axis=1))
        rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def candidates(self, hits: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
        """(first word, last word plus one, template) of each place of a text where a template may stand."""
        out = []
        for t in np.unique(hits[:, 2]).tolist():
            p, o = hits[hits[:, 2] == t][:, [1, 3]].T
            n, d = len(self.words[t]), p - o
            order = np.argsort(d, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(d[order]) > max(4, n // 5)) + 1):
                if len(np.unique(o[part])) >= self.enough[t]:
                    out.append((max(0, int(d[part].min()) - self.room[t]), min(n_words, int(d[part].max()) + n + self.room[t]), t))
        return sorted(out)

    def rank(self, block: list[bytes]) -> list[tuple[float, str]]:
        """(share of the compressed size of the block's words that the template saves, template), best first."""
        import zstandard as z

        data = b" ".join(block)
        alone = len(z.ZstdCompressor(level=self.level, write_content_size=False).compress(data))
        size = {k: len(z.ZstdCompressor(level=self.level, write_content_size=False, dict_data=d).compress(data)) for k, d in self.given.items()}
        return sorted(((round((alone - n) / alone, 6), k) for k, n in size.items()), key=lambda x: (-x[0], x[1]))

    def _align(self, want: list, block: list) -> tuple[int, list[str], list[tuple[int, int]]]:
        matches = _matches(want, block)
        there = {i for a, _, n in matches for i in range(a, a + n)}
        return len(there), [w.decode() for i, w in enumerate(want) if i not in there], [(b, b + n) for _, b, n in matches]

    def _fit(self, t: int, block: list) -> tuple[int, list[str], list[tuple[int, int]]] | None:
        """Matched words, missing words and places of the template in the block, if enough of it stands close together."""
        want, have = self.words[t], Counter(block)
        most = len(want)
        if sum(min(n, have[w]) for w, n in self.counts[t].items()) < self.least * most - 1e-9:
            return None
        held, missing, places = self._align(want, block)
        if held >= self.least * most - 1e-9 and places[-1][1] - places[0][0] <= 2 * most:
            return held, missing, places
        return self._near(want, block) if len(block) > (most if most < 64 else 1.5 * most) else None

    def _near(self, want: list, block: list) -> tuple[int, list[str], list[tuple[int, int]]] | None:
        """As _fit, around the longest runs of the template's words: single words further off do not count."""
        block, most = list(block), len(want)
        while True:
            m = SequenceMatcher(None, want, block, autojunk=False).find_longest_match()
            if m.size < min(3, most):
                return None
            lo = max(0, m.b - m.a - most // 2)
            held, missing, places = self._align(want, block[lo : m.b - m.a + most + most // 2])
            if held >= self.least * most - 1e-9:
                return held, missing, [(lo + a, lo + b) for a, b in places]
            block[m.b : m.b + m.size] = [None] * m.size

    def confirm(self, block: list[bytes], candidates: list[tuple[int, int, int]]) -> list[tuple]:
        """(license, saving, matched words, template words, missing words, first word, last word plus one) of a block."""
        key = (b" ".join(block), tuple(candidates))
        if key in self.known:
            return self.known[key]
        left, out, order = list(block), [], self.rank(block)
        while order:
            near = [(saving, k) for saving, k in order if saving >= order[0][0] - _NEAR]
            fits = [((len(fit[1]) + fit[2][-1][1] - fit[2][0][0] - fit[0]) / len(self.words[t]), -saving, k, a, t, fit) for saving, k in near for a, b, t in candidates if self.names[t] == k and (fit := self._fit(t, left[a:b]))]
            if not fits:
                order = order[len(near) :]
                continue
            _, saving, name, a, t, (held, missing, places) = min(fits)
            out.append((name, -saving, held, len(self.words[t]), missing, a + places[0][0], a + places[-1][1]))
            for x, y in places:
                left[a + x : a + y] = [None] * (y - x)
        if self.held + len(key[0]) > _CACHE:
            self.known.clear()
            self.held = 0
        self.known[key] = out
        self.held += len(key[0])
        return out

    def blocks(self, data: bytes, low: np.ndarray, start: np.ndarray, end: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, str, list[tuple]]]:
        """Line number (from 0), text and licenses of each block of a text, given the places of its words and its hits."""
        found = self.candidates(hits, len(start))
        i = 0
        while i < len(found):
            a, b, j = found[i][0], found[i][1], i + 1
            while j < len(found) and found[j][0] <= b:
                b, j = max(b, found[j][1]), j + 1
            took = self.confirm([low[s:e].tobytes() for s, e in zip(start[a:b].tolist(), end[a:b].tolist())], [(x - a, y - a, t) for x, y, t in found[i:j]])
            lo, hi = (a + min(f[5] for f in took), a + max(f[6] for f in took)) if took else (a, b)
            begin = int(start[lo])
            line = data.rfind(b"\n", 0, begin) + 1
            if not re.search(rb"[0-9A-Za-z]", data[line:begin]):
                while m := _COPYRIGHT.search(data, data.rfind(b"\n", 0, max(line - 1, 0)) + 1, line):
                    begin = line = m.start()
            yield data.count(b"\n", 0, begin), data[begin : end[hi - 1]].decode(), [f[:5] for f in took]
            i = j

    def judge(self, text: str) -> list[tuple]:
        """(license, saving, template words in the text, template words, missing words) of each license of a text."""
        w = words.Words(*self._bytes(text), words.ASCII)
        return [f for *_, took in self.blocks(text.encode(), w.low, w.start, w.end, self.hits(w)) for f in took]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.9, unknown: bool = False) -> DataFrame:
    """doc_id, line, license, saving, matched_words, template_words, missing (words), block; one row per license found."""
    docs = scratch.documents(docs)
    chosen = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)  # wording alone, whatever the corpus

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        judge = Judge(chosen.value, least)
        names = ["doc_id", "line", "license", "saving", "matched_words", "template_words", "missing", "block"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
        for batch in batches:
            data, off = words.buffers(batch.column("text"))
            for lo, hi in words.spans(off, _CHUNK):
                part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                w = words.Words(part, at, words.ASCII)
                hits = judge.hits(w)
                rows = []
                for own in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else ():
                    d = int(own[0, 0])
                    a, b = w.first[d], w.first[d + 1]
                    text = part[at[d] : at[d + 1]].tobytes()
                    doc_id = batch.column("doc_id")[lo + d].as_py()
                    for line, block, took in judge.blocks(text, w.low[at[d] : at[d + 1]], w.start[a:b] - at[d], w.end[a:b] - at[d], own):
                        rows += [(doc_id, line, *f, block) for f in took or ([(None, 0.0, 0, 0, [])] if unknown else [])]
                cols = list(zip(*rows)) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.mapInArrow(find, "doc_id long, line long, license string, saving double, matched_words long, template_words long, missing array<string>, block string")
