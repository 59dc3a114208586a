"""Quality rules, license scans and language ID against plain Python."""

import re
import string
import struct
import textwrap

import numpy as np
import pytest
import xxhash

from faultline.llm import language, licenses, outliers

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


TEXTS = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "l1\nl1\n\nl2\nl1", "#*$%&|<> é ü 日本語  nbsp", "a b c d e f g\na b c d e f g\n" * 3, "q w e r t y " * 5000]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_words int, kept string")
    for r in outliers.judge(docs).collect():
        want = plain_counts(TEXTS[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_outliers_by_group(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(string.ascii_lowercase), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(600):
        text = " ".join(rng.choice(words, rng.integers(30, 300)))
        bad = i % 20 == 0
        rows.append((i, " ".join(w + "###" for w in text.split()) if bad else text, ["en", None][i % 2], ["a", "b", None][i % 3]))
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), min_rows=80).collect()}
    assert not any(got[i].kept for i in range(0, 600, 20))
    assert np.mean([got[i].kept for i in range(600) if i % 20]) > 0.99


def spark_hash(row):
    """xxhash64 of doubles, as Spark chains it."""
    seed = 42
    for v in row:
        seed = xxhash.xxh64_intdigest(struct.pack("<d", v + 0.0), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_distances(x, n, n0=1000.0, trim=0.25, steps=3, chosen=None):
    """The estimate in numpy: vectors with numbers of words. ``chosen`` gets the determinants of the starts."""
    p, ridge, c = x.shape[1], np.array(list(outliers.RIDGE.values())), outliers.consistency
    w = np.sqrt(n * n0 / (n + n0))[:, None]
    x = (x - np.quantile(x, 0.5, axis=0, method="inverted_cdf")) * np.where(np.arange(p) == 0, 1.0, w)
    spread = np.quantile(abs(x), 0.5, axis=0, method="inverted_cdf")
    scaled = x * x / ((1.4826 * spread) ** 2 + ridge)

    def estimate(near, factor):
        v = np.cov(x[near].T, bias=True) * factor + np.diag(ridge)
        y = x - x[near].mean(0)
        return np.einsum("ij,jk,ik->i", y, np.linalg.inv(v), y), np.linalg.slogdet(v)[1]

    tried = []
    for d in (scaled.sum(1), scaled.max(1), np.array([float(spark_hash(r)) for r in x.tolist()])):
        for _ in range(steps):
            d, det = estimate(d <= np.quantile(d, 1 - trim, method="inverted_cdf"), c(1 - trim, p))
        tried.append((det, len(tried), d))
    if chosen is not None:
        chosen.append([t[0] for t in tried])
    d = min(tried, key=lambda t: t[:2])[2]
    return estimate(d <= outliers.quantile(0.975, p), c(0.975, p))[0]


def test_distances_against_numpy(spark):
    """Every group, the whole language for small sources, and all rows for small languages."""
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(string.ascii_letters), rng.integers(2, 9))) for _ in range(300)]
    rows = []
    for i in range(420):
        w = list(rng.choice(words, rng.integers(20, 200)))
        if rng.random() < 0.05:
            w = [x + "#$" for x in w]
        lang, source = ("a", "big") if i < 200 else ("a", f"s{i % 9}") if i < 280 else ("b", f"s{i % 3}") if i < 400 else (None, "x")
        rows.append((i, " ".join(w), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in outliers.judge(docs, min_rows=60).collect()}
    rate = outliers.count_words(docs).select("doc_id", "n_words", *(c.alias(k) for k, c in outliers._rates().items())).collect()
    rate = {r.doc_id: (r.n_words, [r[k] for k in outliers.STATS]) for r in rate}
    good, chosen = [i for i in got if not got[i].base_failed], []
    for own, of in (("big", lambda r: r[2:] == ("a", "big")), ("a", lambda r: r[2] == "a"), ("b", lambda r: r[2] == "b"), ("all", lambda r: True)):
        base = [i for i in good if of(rows[i])]
        d = dict(zip(base, plain_distances(np.array([rate[i][1] for i in base]), np.array([float(rate[i][0]) for i in base]), chosen=chosen)))
        mine = [i for i in base if (own == "big") or (own == "a" and rows[i][3] != "big") or own == "b" or (own == "all" and rows[i][2] is None)]
        assert len(mine) > 10
        assert all(abs(got[i].distance - d[i]) < 1e-6 * (1 + d[i]) for i in mine), own
        assert all(got[i].kept == (d[i] <= outliers.quantile(1 - 1e-6, 6)) for i in mine)
    assert any(max(c) - min(c) > 1e-6 for c in chosen)  # the starts end apart, so that the choice counts


def test_chi_square():
    assert abs(outliers.quantile(0.975, 6) - 14.4494) < 1e-3 and abs(outliers.quantile(0.95, 2) - 5.9915) < 1e-3


def test_equal_rows_are_kept(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(20)), "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string")
    assert all(r.kept for r in outliers.judge(docs).collect())
    assert outliers.judge(docs.limit(0)).count() == 0


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"].replace("this software", "THIS software")
    rows = [
        (0, None), (1, ""), (2, "We sell licence plates."), (3, "x\nReleased under the MIT License.\ny"), (4, "Copyright 2020\n" + mit), (5, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under CC BY 4.0."), (7, "Licensed under CC BY 4.0."), (8, "word " * 200_000 + "\nAll rights reserved."),
    ]
    got = sorted((r.doc_id, r.line, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 1, "MIT"), (4, 0, "MIT-text"), (5, 0, "All-rights-reserved"), (5, 0, "Apache-2.0"), (6, 0, "CC-BY-NC-4.0"), (7, 0, "CC-BY-4.0"), (7, 0, "CC-BY-4.0"), (8, 1, "All-rights-reserved")]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_template_ranks_first():
    judge = licenses.Judge(licenses.TEMPLATES, 0.9)
    for k, t in licenses.TEMPLATES.items():
        assert judge.judge(t)[0][0] == k, k


def test_wrapped_templates(spark):
    prose = "A sentence that says nothing about the matter at all, and another one of the same kind. " * 9
    rows, want = [], []
    for width in range(60, 81, 4):
        for k, t in licenses.TEMPLATES.items():
            for mark in ("", " * ", "# "):
                fill = lambda x: textwrap.fill(x, width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False)  # noqa: B023, E731
                rows.append((len(rows), "\n".join([fill(prose), mark, fill("Copyright (c) 2020 Somebody"), mark, fill(t), mark, fill(prose)])))
                want.append(k)
                rows.append((len(rows), f"{fill(prose)} {t} {fill(prose)} and\n\n\n\n{fill(t)}\n{prose}"))
                want += [k, k]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license for r in sorted(got, key=lambda r: r.doc_id)] == want
    assert all(r.matched_words == r.template_words and not r.missing for r in got)


def test_whole_texts(spark):
    """Whole licenses with a title, other holders, comment marks and single words changed."""
    rng, rows, want = np.random.default_rng(5), [], []
    whole = {k: t for k, t in licenses.TEMPLATES.items() if k.endswith("-full")}
    assert {"MIT-full", "BSD-2-Clause-full", "BSD-3-Clause-full", "ISC-full", "Apache-2.0-full", "GPL-2.0-full", "GPL-3.0-full", "LGPL-2.1-full", "AGPL-3.0-full", "MPL-2.0-full"} <= set(whole)
    for k, t in whole.items():
        for share in (0, 0.03):
            w = [x if rng.random() >= share else "changed" for x in t.split()]
            text = "\n".join(" // " + x for x in ["Some License", "", "Copyright (c) 2020 Somebody", "", *textwrap.wrap(" ".join(w), 72)])
            rows.append((len(rows), f"int x;\n{text}\nint main() {{}}\n" * 2))
            want += [k, k]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.license for r in sorted(got, key=lambda r: (r.doc_id, r.line))] == want
    opening = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + whole["MIT-full"][:800]
    assert [r[0] for r in licenses.Judge(licenses.TEMPLATES, 0.9).judge(opening)] == ["MIT-text"]


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_licenses_against_all_windows(spark):
    """Every window of every text against every template, by longest common subsequence."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(60)]
    templates = {f"T{n}": " ".join(rng.choice(vocabulary, n)) for n in (3, 6, 11, 20, 30, 45)}
    rows = []
    for i in range(80):
        parts = []
        for _ in range(int(rng.integers(0, 4))):
            t = templates[str(rng.choice(list(templates)))].split()
            for _ in range(int(rng.integers(0, 2 + len(t) // 8))):
                t[int(rng.integers(len(t)))] = "other"
            parts += [*rng.choice(vocabulary, int(rng.integers(0, 40))), *t]
        rows.append((i, " ".join(parts).replace("w1 ", "W1,\n * ")))
    want = set()
    for i, text in rows:
        have = re.findall("[0-9a-z]+", text.lower())
        for k, t in templates.items():
            w = t.split()
            need = len(w) - int(len(w) * 0.1 + 1e-9)
            if any(_longest(w, have[a : a + len(w)]) >= need for a in range(len(have))):
                want.add((i, k))
    got = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert want == got and len(want) > 60


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    syllables = {"aa": "ka to mi ra ne so".split(), "bb": "sch ung ein der lich ver".split(), "cc": "é à ou eau que ment".split()}
    rows = []
    for i in range(240):
        k = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(rng.integers(4, 60))), k))
    return rows


def test_languages(spark, labelled):
    train = spark.createDataFrame([r for r in labelled if r[0] % 4 != 2] + [(900, None, "aa"), (901, "kato", None)], "doc_id long, text string, lang string")
    model = language.fit(train)
    rows = [(i, t, 5, "x") for i, t, _ in labelled] + [(1000, None, 5, "x"), (1001, "12 !? 34", 5, "x"), (1002, "", 5, "x"), (1003, "ka to " * 400_000, 5, "x"), (1003, "ka to " * 400_000, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).select("doc_id", "lang_pred", "score").collect()]
    told = {d: p for d, p, _ in got}
    assert np.mean([told[i] == k for i, _, k in labelled if i % 4 == 2]) > 0.97
    assert told[1000] == told[1001] == told[1002] == "und" and told[1003] == "aa" and len(got) == len(rows)
    assert all(0 <= s <= 1 for *_, s in got)
    kept = language.accept(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_kernel_is_the_definition(labelled):
    texts = [t.encode() for _, t, _ in labelled[:9]]
    f = language.Features.of(texts[:4], 4)
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in t)
    grams = lambda t: {(n, t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}
    space = {(int(n), int(c).to_bytes(4, "big")[4 - n :]) for n, c in zip(f.size, f.code)}
    got = f.kernel(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        for j, z in enumerate(texts[:4]):
            a, b = grams(fold(t)) & space, grams(fold(z)) & space
            assert abs(got[i, j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 1e-5


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "..", None)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert [r.doc_id for r in language.accept(docs, model).collect()] == [1]
    assert language.predict(docs.limit(0), model).count() == 0
