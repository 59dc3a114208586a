"""Functions for SQL against the column functions they stand for."""

from pyspark.sql import functions as F

from faultline.functions import sql
from faultline.functions import text as T
from faultline.operators import bindings


def test_scalar_functions(spark):
    sql.register(spark)
    rows = [("GET /v1/a/{id}: gone", "breaking", "changelog:x"), ("see (DELETE /x/{y}/{z}) now", "deprecation", "spec-diff:y"), ("nothing", "unknown", None), (None, "fix", "r")]
    d = spark.createDataFrame(rows, "title string, change_type string, source string")
    none = F.lit(None).cast("string")
    want = d.select(T.anchor_path("title", none), T.severity("change_type"), T.endpoint_level("source")).collect()
    got = d.select(F.expr("anchor_path(title)"), F.expr("change_severity(change_type)"), F.expr("endpoint_level(source)")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert spark.sql("SELECT path_slots('/a/{x}/{y}z')").first()[0] == "/a/{param}/{param}z"


def test_code_facts(spark):
    sql.register(spark)
    files = spark.createDataFrame([("a.js", "import S from 'stripe';\nconst a = new S(k);\nf((a) => a.b.c());\n"), ("a.txt", "import"), (None, "x"), ("b.js", None)], "path string, text string")
    got = spark.sql("SELECT f.* FROM {files} t, LATERAL code_facts(t.path, t.text) f", files=files)
    assert sorted(map(str, got.collect())) == sorted(map(str, bindings.code_facts(files).collect())) and got.count() > 3
