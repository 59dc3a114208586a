"""Boundaries of words beside letters of other scripts, marks and white space, against the SQL."""

import random

import duckdb
import pytest

from faultline import queries as Q


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Words, names, secrets and hosts right beside letters that are no ASCII word characters."""
    rng = random.Random(5)
    words = ["fooBar", "FooBar", "a.b.c", "$x.y$", "snake_case_name", "@a-b/c.d", "` quoted name　`", "` tab\tname `", "10.20.30.40", "a" * 8 + "0" * 34, "sk-" + "a1B2" * 6, "Bearer " + "x" * 20, "removed", "breaking", "docs", "readme.md", "new endpoint"]
    marks = ["", " ", "\n", "é", "ß", "и", "中", "́", " ", "_", "$", ".", "-", "٣", "ﬁ", "\U0001d400"]
    texts = ["".join(rng.choice(marks) + rng.choice(words) for _ in range(rng.randint(1, 5))) + rng.choice(marks) for _ in range(1500)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    root = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return root


@pytest.mark.parametrize("name", ["symbols_named", "line_scan", "redact", "classify_documents"])
def test_words_end_where_ascii_does(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    result = con.execute(Q.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    want = sorted(repr(r) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in Q.QUERIES[name](spark, odd).select(*columns).collect()) == want
