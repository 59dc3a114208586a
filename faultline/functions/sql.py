"""The engine for those who write SQL only: table functions over files and feeds, and scalar functions of titles.

    register(spark)
    SELECT f.* FROM files, LATERAL code_facts(files.path, files.text) f

Table functions run where their rows are, a file at a time; scalar ones are SQL expressions that Catalyst sees through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.bindings import _SCHEMA, File
from ..sources.files import language
from . import vocabulary as V


@udtf(returnType=_SCHEMA)
class CodeFacts:
    """Modules, clients, aliases, exports, imports, scopes and calls of one file (path, text)."""

    def eval(self, path: str, text: str) -> Iterator[tuple]:
        lang = language(path or "")
        if lang and text:
            yield from File(path, text, lang).facts()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scalar_functions() -> dict[str, str]:
    """CREATE statements: severity and endpoint_level of a change, anchor_path of a title, path_slots of an endpoint."""
    severities = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SEVERITY.items())
    verbs = "|".join(V.VERBS)
    return {
        "change_severity": f"CREATE OR REPLACE TEMPORARY FUNCTION change_severity(change_type STRING) RETURNS STRING RETURN CASE change_type {severities} ELSE 'low' END",
        "endpoint_level": "CREATE OR REPLACE TEMPORARY FUNCTION endpoint_level(source STRING) RETURNS BOOLEAN RETURN startswith(coalesce(source, ''), 'changelog:') OR startswith(coalesce(source, ''), 'spec-diff:')",
        "anchor_path": f"CREATE OR REPLACE TEMPORARY FUNCTION anchor_path(title STRING) RETURNS STRING RETURN nullif(regexp_extract(coalesce(title, ''), {_quoted(rf'\b(?:{verbs})\s+(/[^\s:)]+)')}, 1), '')",
        "path_slots": f"CREATE OR REPLACE TEMPORARY FUNCTION path_slots(path STRING) RETURNS STRING RETURN regexp_replace(path, {_quoted(r'\{[^}]*\}')}, '{{param}}')",
    }


def register(spark: SparkSession) -> None:
    spark.udtf.register("code_facts", CodeFacts)
    for statement in scalar_functions().values():
        spark.sql(statement)
