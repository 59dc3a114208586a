"""Scopes: which binding a name means at a place.

A scope is an interval of a file in which a head (parameters, catch, loop) binds a name. Scopes nest, so of those around a
place the one that begins last is the innermost. Facts and scopes meet by file, name and bucket of 4,096 characters, so a file with
very many scopes of one name compares near ones only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rewrite import closing
from .relational import dealt

_N = r"[A-Za-z_$][\w$]*"
_BUCKET = 12
_NOT_HEADS = {"if", "while", "switch", "for", "catch", "with", "return", "function", "foreach", "elseif", "match", "declare"}
_HEADS = {
    "js": rf"(?P<catch>\b(?:catch|for(?:\s+await)?))\s*\(|(?<![\w$])(?P<one>{_N})\s*=>|=>|(?<![\w$.])(?P<named>{_N})\s*\(|\bfunction\s*\*?\s*\(",
    "php": r"(?P<catch>\b(?:catch|foreach))\s*\(|\b(?P<named>\w+)\s*\(",
    "go": r"\bfunc\s*(?:\([^()]*\)\s*)?\w*\s*\(",
}


def _top(text: str, marks: str = ",") -> list[str]:
    """Parts between marks that no bracket holds."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c in marks and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def parameters(text: str, lang: str) -> Iterator[str]:
    """Names that a parameter list binds; what stands in defaults and types is not bound."""
    for part in _top(text):
        part = _top(part, "=")[0].strip()
        if lang == "js" and part[:1] in ("{", "["):
            inner = part[1:].rstrip(" )")
            inner = inner[: inner.rfind("}" if part[0] == "{" else "]")]
            for p in _top(inner):
                yield from parameters(_top(p, ":")[-1], lang)
            continue
        head = _top(part, ":")[0] if lang in ("js", "py", "rb") else part
        found = re.findall(r"\$\w+", head) if lang == "php" else re.findall(_N, head)
        if found:
            yield found[0 if lang == "go" else -1]


def _opening(code: str, at: int) -> int | None:
    """The bracket that the one at ``at`` closes."""
    depth = 0
    for i in range(at, -1, -1):
        depth += (code[i] in ")]}") - (code[i] in "([{")
        if not depth:
            return i
    return None


def _expression(code: str, at: int) -> int:
    """Where an expression that begins at ``at`` ends: at a comma, a semicolon or a bracket that it did not open."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        depth += c in "([{"
        depth -= c in ")]}"
        if depth < 0 or not depth and c in ",;":
            return i
    return len(code)


def _body(code: str, at: int) -> int:
    """The end of a block in braces at ``at``, or of the one statement there."""
    at = re.compile(r"\s*").match(code, at).end()
    if code[at : at + 1] == "{":
        end = closing(code, at)
        return len(code) if end is None else end + 1
    return _expression(code, at)


def _braced(code: str, lang: str) -> Iterator[tuple[str, int, int]]:
    for m in re.finditer(_HEADS[lang], code):
        g = m.groupdict()
        if lang == "js" and m.group().endswith("=>"):
            start, close = m.start(), None
            names = [g["one"]] if g["one"] else []
            if not names:
                close = len(code[: m.start()].rstrip()) - 1
                typed = re.search(r"\)\s*:[^()=;{}]*$", code[max(0, m.start() - 120) : m.start()])
                close = max(0, m.start() - 120) + typed.start() if typed else close
                start = _opening(code, close) if code[close : close + 1] == ")" else None
                if start is None:
                    continue
                names = list(parameters(code[start + 1 : close], lang))
            end = _body(code, m.end())
        else:
            open_ = m.end() - 1
            close = closing(code, open_)
            if close is None or g.get("named") in _NOT_HEADS and lang == "js":
                continue
            start, names = open_, list(parameters(code[open_ + 1 : close], lang))
            if g.get("catch"):
                head = code[open_ + 1 : close]
                if lang == "js" and "for" in g["catch"]:
                    loop = re.match(rf"\s*(?:const|let|var)\s+(\{{[^}}]*\}}|\[[^\]]*\]|{_N})", head)
                    names = list(parameters(loop.group(1), lang)) if loop else []
                elif lang == "php" and "foreach" in g["catch"]:
                    names = re.findall(r"\$\w+", head.split(" as ")[-1]) if " as " in head else []
                end = _body(code, close + 1)
            else:
                after = re.compile(r"\s*(?::\s*[\w$.<>\[\]|?\\, ]+)?\s*(?:use\s*\([^)]*\)\s*)?(?=\{)" if lang != "go" else r"[^{}\n]*(?=\{)").match(code, close + 1)
                if not after or lang == "php" and not re.search(r"\b(?:function|fn)\s*&?\s*\w*\s*$", code[max(0, m.start() - 40) : open_]):
                    continue
                end = _body(code, after.end())
        for name in names:
            yield name, start, end


def _indented(code: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """Heads of languages whose blocks are told by indentation (Ruby's ``end`` stands where its head does)."""
    heads = {
        "py": rf"(?m)^(?P<in>[ \t]*)(?:(?:async\s+)?def\s+\w+\s*(?P<open>\()|(?:async\s+)?for\s+(?P<loop>[\w, ()]+?)\s+in\b|except\b[^\n:]*\bas\s+(?P<as>{_N}))|\blambda\s+(?P<lambda>[^:\n]*):",
        "rb": r"(?m)^(?P<in>[ \t]*)(?:def\s+[\w.?!]+(?P<open>\()|[^\n#]*?\bdo\s*\|(?P<block>[^|\n]*)\|)|\{\s*\|(?P<braces>[^|\n]*)\|",
    }[lang]
    for m in re.finditer(heads, code):
        g = m.groupdict()
        at = m.start()
        if g.get("lambda") is not None or g.get("braces") is not None:
            names = parameters(g.get("lambda") or g.get("braces") or "", lang)
            end = code.find("\n", at) if g.get("braces") is None else (closing(code, at) or len(code))
        else:
            if g.get("open"):
                at = m.start("open")
                close = closing(code, at)
                if close is None:
                    continue
                names, at_body = parameters(code[at + 1 : close], lang), close
            else:
                names, at_body = re.findall(_N, g.get("loop") or g.get("as") or g.get("block") or ""), m.end()
            line = code.find("\n", at_body)
            stop = re.compile(rf"(?m)^[ \t]{{0,{len(g['in'])}}}(?=\S)").search(code, len(code) if line < 0 else line + 1)
            end = stop.start() if stop and line >= 0 else len(code)
        for name in names:
            yield name, at, len(code) if end < 0 else end


def scopes(code: str, lang: str) -> Iterator[tuple[str, int, int]]:
    """(name, from, to) for each name that a head binds, in masked code."""
    if lang in _HEADS:
        yield from _braced(code, lang)
    elif lang in ("py", "rb"):
        yield from _indented(code, lang)


def root(name: Column) -> Column:
    """The first name of a path."""
    return F.regexp_extract(name, r"^[^.\-]+", 0)


def resolved(facts: DataFrame) -> DataFrame:
    """``facts`` (file, seq, fact, name, target, at, upto) without scopes, their names made those of their innermost scope: a name that
    a head binds carries where its scope begins. Targets are names in aliases and exports only."""
    bounds = facts.where("fact = 'scope'").select("file", F.col("name").alias("root"), F.col("at").alias("lo"), F.col("upto").alias("hi"))
    bounds = bounds.withColumn("bucket", F.explode(F.sequence(F.shiftright("lo", _BUCKET), F.shiftright("hi", _BUCKET))))
    rows = facts.where("fact <> 'scope'")
    used = F.filter(F.array(F.col("name"), F.when(F.col("fact").isin("alias", "export"), F.col("target"))), lambda n: n.isNotNull())
    uses = rows.select("file", "seq", "at", F.explode(F.array_distinct(F.transform(used, root))).alias("root")).withColumn("bucket", F.shiftright("at", _BUCKET))
    inner = uses.join(dealt(bounds), ["file", "root", "bucket"]).where("lo <= at AND at < hi").groupBy("file", "seq", "root").agg(F.max("lo").alias("lo"))
    inner = inner.groupBy("file", "seq").agg(F.map_from_entries(F.collect_list(F.struct("root", "lo"))).alias("inner"))  # two names at most
    within = lambda c: F.when(F.col("inner")[root(F.col(c))].isNotNull(), F.concat(root(F.col(c)), F.lit("@"), F.col("inner")[root(F.col(c))], F.substring(c, F.length(root(F.col(c))) + 1, F.length(c)))).otherwise(F.col(c))
    target = F.when(F.col("fact").isin("alias", "export"), within("target")).otherwise(F.col("target"))
    return rows.join(dealt(inner), ["file", "seq"], "left").withColumns({"name": within("name"), "target": target}).drop("inner")


def shown(name: Column) -> Column:
    """A name as it stands in the text."""
    return F.regexp_replace(name, r"@\d+", "")
