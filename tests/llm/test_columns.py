"""Columns that are named like the operators' own, or with dots, pass through."""

import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate, language, licenses, neardup, outliers, packing, scratch, spans

NAMES = "_k _cuts _doc _letter letter _own_spans spans _id _text node bucket row key of k cuts h g n_words start label lvl distance near hit n_hit block kind held c_x_words m_x_words a.b wi`th".split()


@pytest.fixture(scope="module")
def docs(spark):
    say = lambda k, n=30: " ".join(f"Word{k} says{i % 7} things{i}." if i % 4 == 3 else f"word{k}x{i}" for i in range(n))
    rows = [(i, say(i), ["aa", "bb"][i % 2], "s", 1) for i in range(12)] + [(20, say(3), "aa", "s", 1), (21, say(4) + " " + say(50, 20), "aa", "s", 1), (22, say(5, 8) + " " + say(50, 20), None, None, 1), (None, None, None, None, None), (30, "!", "aa", "s", 1)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(c) for c in NAMES))


def same(out, docs):
    assert out.columns == docs.columns
    rows = out.collect()
    for r in rows:
        i = -1 if r["doc_id"] is None else r["doc_id"]
        assert [r[c] for c in NAMES] == [f"{c}:{i}" for c in NAMES]
    return {r["doc_id"] for r in rows}


def test_filters_keep_columns(spark, docs):
    bench = spark.createDataFrame([(1, "word2x0 word2x1 word2x2", "z")], "item_id long, text string, spans string")
    everything = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert same(language.accept(docs, language.fit(docs)), docs) == everything - {None, 30}
    assert same(neardup.first(docs), docs) == everything - {20}
    assert same(spans.clean(docs, every=True), docs) >= everything - {20}
    assert same(decontaminate.clean(docs, bench), docs) == everything - {2}


def test_other_operators_ignore_columns(spark, docs):
    model = language.fit(docs)
    assert same(language.predict(docs, model).drop("lang_pred", "score"), docs)
    n = docs.count()
    assert outliers.judge(docs).count() == n and neardup.classes(docs).count() == n
    assert packing.sequences(docs).select("doc_id").distinct().count() == n
    assert licenses.scan(docs).count() == 0 and spans.report(docs, every=True).count() > 0
    assert decontaminate.judge(docs, spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == n


def test_tables_are_dropped(spark):
    import os

    before = set(os.listdir(scratch.shared_dir(spark).removeprefix("file:")))
    with scratch.dropping():
        with scratch.dropping():
            kept = scratch.materialise(spark.range(3), "kept", keep=True)
            scratch.materialise(spark.range(3), "gone")
        assert kept.count() == 3 and len(set(os.listdir(scratch.shared_dir(spark).removeprefix("file:"))) - before) == 1
    assert set(os.listdir(scratch.shared_dir(spark).removeprefix("file:"))) == before
