"""Source trees as tables, and usage found in them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexer
from ..functions import vocabulary as V


def tree(spark: SparkSession, root: str, extensions: list[str] = V.SCANNED, skipped: list[str] = V.SKIPPED_DIRS, most_bytes: int = V.FILE_BYTES) -> DataFrame:
    """path (relative), size, text of the files under ``root`` with a known extension and below the size limit; directories
    in ``skipped``, and names that begin with a dot, are left out. Sizes and names are tested before texts are read."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    files = files.select("value", F.col("_metadata.file_path").alias("full"), F.col("_metadata.file_size").alias("size"))
    at = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.regexp_replace("full", "^[a-z]+:/+", "/"), "^" + re.escape(at) + "/", "")
    rows = files.where(F.col("size") < most_bytes).select(path.alias("path"), "size", F.col("value").alias("text"))
    steps = F.split("path", "/")
    hidden = F.exists(steps, lambda s: s.isin(skipped) | s.startswith("."))
    return rows.where(~hidden & F.regexp_extract("path", r"(\.[^./]+)\z", 1).isin(extensions))


def language(path: str) -> str | None:
    m = re.search(r"\.[^./]+\Z", path)
    return lexer.LANGUAGE.get(m.group()) if m else None


def matchers(signatures: dict[str, dict] = V.SIGNATURES) -> list[tuple[str, str, str, str | None, re.Pattern]]:
    """provider, kind, detail, language it is bound to, pattern. A detail stands in whatever its pattern hits, but for a host's case. Import forms stand at line starts or in calls; an environment
    name counts where it is read or set, a host wherever it stands."""
    out = []
    add = lambda p, kind, detail, lang, pattern, flags=re.M: out.append((p, kind, detail, lang, re.compile(pattern, flags)))
    for p, s in signatures.items():
        for m in s.get("modules", ()):
            e = re.escape(m)
            add(p, "import", m, None, rf"require\s*\(\s*['\"]{e}['\"/]|\bfrom\s+['\"]{e}['\"/]|\bimport\s+['\"]{e}['\"/]|^\s*(?:import|from)\s+{e}\b")
        for m in s.get("python", ()):
            add(p, "import", m, "py", rf"^\s*(?:import|from)\s+{re.escape(m)}\b")
        for m in s.get("ruby", ()):
            add(p, "import", m, "rb", rf"^\s*require\s+['\"]{re.escape(m)}['\"]")
        for m in s.get("go", ()):
            add(p, "import", m, "go", rf"^\s*(?:import\s+)?(?:[A-Za-z_]\w*\s+|[._]\s+)?\"{re.escape(m)}[\"/]")
        for m in s.get("php", ()):
            e = re.escape(m)
            add(p, "import", m, "php", rf"^\s*use\s+{e}\\|(?<!\w)\\{e}\\[A-Z]")
            add(p, "import", m, "php-global", rf"(?<![\w\\$]){e}(?:\\[A-Za-z_]\w*)+::[A-Za-z_]\w*\s*\(|\bnew\s+{e}(?:\\[A-Za-z_]\w*)+\s*\(")
        for h in s.get("hosts", ()):
            add(p, "api-host", h, None, re.escape(h), re.I)
        for v in s.get("env", ()):
            e = re.escape(v)
            add(p, "env-var", v, None, rf"process\.env(?:\.|\[['\"`]){e}|os\.environ(?:\[|\.get\(\s*)['\"]{e}|getenv\(\s*['\"]{e}|ENV\[['\"]{e}|\$\{{?{e}|^\s*(?:export\s+)?{e}[A-Z0-9_]*=")
    return out


def usage(files: DataFrame, signatures: dict[str, dict] = V.SIGNATURES, whole: bool = False) -> DataFrame:
    """provider, kind, detail, file, line, snippet for each line of masked text that a matcher hits. With ``whole`` also raw: the whole
    line where a host is hit, of which the snippet is the beginning; null for other kinds."""
    fields = ["provider", "kind", "detail", "file", "line", "snippet", *(["raw"] if whole else [])]
    schema = ", ".join(f"{n} {'long' if n == 'line' else 'string'}" for n in fields)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matchers(signatures)
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                lang = language(path or "")
                if not lang or not text:
                    continue
                masked = lexer.mask_prose(text, lang)
                global_ns = lang == "php" and not re.search(r"^\s*(?:<\?php\s+)?namespace\s+\w", masked, re.M)
                plain, lower = masked.isascii(), masked.lower()
                said = lambda m: m[2] in masked or m[1] == "api-host" and (not plain or m[2].lower() in lower)
                near = [m for m in known if (m[3] in (None, lang) or m[3] == "php-global" and global_ns) and said(m) and m[4].search(masked)]
                raw = text.split("\n")
                for i, line in enumerate(masked.split("\n") if near else ()):
                    rows += [(p, kind, detail, path, i + 1, raw[i].strip()[: V.SNIPPET], raw[i] if kind == "api-host" else None) for p, kind, detail, _, pattern in near if pattern.search(line)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64() if n == "line" else pa.string()) for n, c in zip(fields, cols)], fields)

    return files.select("path", "text").mapInArrow(find, schema)
