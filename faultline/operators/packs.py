"""Migration packs: ordered text rules that cover known changes, run over a tree as one Arrow pass.

A rule is tried where its pattern is in the text as it then is, and sees what the rules before it left. A file is reported
only if it differs in the end; the rules listed are those that were tried. Packs are refused where newer changes touch what
they cover, unless that is acknowledged.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rewrite as W
from ..functions import vocabulary as V

Apply = Callable[[str], str]
Checker = Callable[[str, str], str | None]


@dataclass(frozen=True)
class Rule:
    about: str
    detect: str
    apply: Apply


@dataclass(frozen=True)
class Pack:
    name: str
    provider: str
    rules: tuple[Rule, ...]
    covers: tuple[int, ...] = ()
    surfaces: tuple[str, ...] = ()
    chains: tuple[str, ...] = ()
    controllers: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    moves: tuple[tuple[str, str], ...] = ()
    revalidated_through: str | None = None
    meta: dict = field(default_factory=dict, compare=False)


def guarded(context: str, apply: Apply) -> Apply:
    """Only in files that show the vendor's context."""
    return lambda text: apply(text) if re.search(context, text) else text


def rename_calls(pairs: dict[str, str]) -> Rule:
    """R1."""

    def apply(text: str) -> str:
        for old, new in pairs.items():
            text = W.rename_call(text, re.escape(old), new)
        return text

    return Rule("rename calls", "|".join(re.escape(k) for k in pairs), apply)


def fold_setters(variable_ctor: str, setters: dict[str, str]) -> Rule:
    """R2: setter calls on a client as fields of its constructor's options."""

    def apply(text: str) -> str:
        m = re.search(rf"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:new\s+)?{variable_ctor}\(([^()\n]*)\);?[ \t]*\n", text)
        if not m:
            return text
        fields, rest = [], text[m.end() :]
        for setter, option in setters.items():
            found = re.search(rf"(?m)^[ \t]*{m.group(1)}\.{setter}\(([^()\n]*)\);?[ \t]*\n?", rest)
            if found:
                fields.append(f"{option}: {found.group(1)}")
                rest = rest[: found.start()] + rest[found.end() :]
        if not fields or "{" in m.group(2):
            return text
        call = text[m.start() : m.end()].replace(f"({m.group(2)})", f"({m.group(2)}, {{ {', '.join(fields)} }})")
        return text[: m.start()] + call + rest

    return Rule("fold setters into the constructor", "|".join(setters), apply)


def unwrap(receiver: str, path: str, to: str) -> Rule:
    """R3: reads of ``path`` on values a call gave, as ``to``."""

    def apply(text: str) -> str:
        for m in re.findall(rf"\b(?:const|let|var)\s+(\w+)\s*=\s*await\s+[\w.]*{receiver}\s*\(", text):
            text = re.sub(rf"\b{m}{path}", m + to, text)
        return text

    return Rule("reshape a response", receiver, apply)


def rename_names(pairs: dict[str, str]) -> Rule:
    """R4: identifiers in code."""

    def apply(text: str) -> str:
        for old, new in pairs.items():
            text = W.rename_identifier(text, old, new)
        return text

    return Rule("rename identifiers", "|".join(re.escape(k) for k in pairs), apply)


def replace_literals(pairs: dict[str, str]) -> Rule:
    """R4, R5: string values and URL paths, whole between quotes or path separators."""

    def apply(text: str) -> str:
        for old, new in pairs.items():
            text = re.sub(rf"(?<![\w-]){re.escape(old)}(?![\w-])", lambda _, n=new: n, text)
        return text

    return Rule("replace literals", "|".join(re.escape(k) for k in pairs), apply)


def drop_fields(names: list[str], anchor: str) -> Rule:
    """R6: payload entries and single-line reads of withdrawn fields, on lines that show the anchor or are entries."""
    some = "|".join(map(re.escape, names))

    def apply(text: str) -> str:
        if not re.search(anchor, text):
            return text
        text = re.sub(rf"(?m)^[ \t]*['\"]?(?:{some})['\"]?\s*:\s*(?:[^,{{}}\[\]()\n]+|\{{[^{{}}\n]*\}}|\[[^\[\]\n]*\]),[ \t]*\n", "", text)
        return W.remove_lines(text, lambda line: bool(re.search(rf"(?:{anchor})[\w.?\[\]]*\.(?:{some})\b", line)) and not line.rstrip().endswith(("{", "(", ",")))

    return Rule("drop withdrawn fields", some, apply)


def clean_patterns(names: list[str]) -> Rule:
    """R7."""

    def apply(text: str) -> str:
        for name in names:
            text = W.remove_destructured(text, name)
        return text

    return Rule("clean up destructuring", "|".join(map(re.escape, names)), apply)


def guard_null(chain: str) -> Rule:
    """R8: optional chaining at the last step of a member chain."""
    head, last = chain.rsplit(".", 1)
    return Rule("guard against null", re.escape(chain), lambda text: "\n".join(x if re.match(r"\s*(?://|\*|/\*)", x) else re.sub(rf"{re.escape(head)}\.(?={re.escape(last)}\b)", head + "?.", x) for x in text.split("\n")))


def mirror_case(known: str, new: str) -> Rule:
    """R9: a case or map entry for a new value beside the known one."""

    def apply(text: str) -> str:
        if re.search(rf"['\"]{re.escape(new)}['\"]", text):
            return text
        text = re.sub(rf"(?m)^([ \t]*)case (['\"]){re.escape(known)}\2:[ \t]*\n", lambda m: m.group() + f"{m.group(1)}case {m.group(2)}{new}{m.group(2)}:\n", text)
        return re.sub(rf"(?m)^([ \t]*)(['\"]){re.escape(known)}\2:([^\n]*),[ \t]*\n", lambda m: m.group() + f"{m.group(1)}{m.group(2)}{new}{m.group(2)}:{m.group(3)},\n", text)

    return Rule("handle a new value", re.escape(known), apply)


def name_arguments(callee: str, names: list[str]) -> Rule:
    """R10."""
    return Rule("positional to named arguments", callee, lambda text: W.named_arguments(text, callee, names))


def drop_guards(values: list[str]) -> Rule:
    """R11: single-line guards whose whole condition is withdrawn values."""
    one = rf"[\w.?]+\s*===?\s*['\"](?:{'|'.join(map(re.escape, values))})['\"]"
    pattern = re.compile(rf"(?m)^[ \t]*if\s*\(\s*{one}(?:\s*\|\|\s*{one})*\s*\)\s*(?:\{{[^{{}}\n]*\}}|[^{{}}\n]+;)[ \t]*\n?")
    return Rule("drop dead guards", "|".join(map(re.escape, values)), lambda text: pattern.sub("", text))


def compose_call(callee: str, change: Callable[[list[str]], str | None]) -> Rule:
    """R12: one call as others."""
    return Rule("compose calls", callee, lambda text: W.replace_calls(text, callee, lambda _, args: change(args)))


def type_tests(module: str, classes: dict[str, str], codes: str) -> Rule:
    """R14."""
    return Rule("error codes as types", re.escape(codes), lambda text: W.codes_to_classes(text, module, classes, codes))


def moved_paths(pairs: dict[str, str]) -> Rule:
    """R13: quoted paths of files that move."""
    return replace_literals(pairs)


def selection_removed(field_: str) -> Rule:
    """R6 in GraphQL text."""
    return Rule("drop a selection", re.escape(field_), lambda text: W.remove_selection(text, field_))


def applied(pack: Pack, text: str) -> tuple[str, list[str]]:
    """A text after all rules of a pack that detect something in it, and what those rules do."""
    tried = []
    for rule in pack.rules:
        if re.search(rule.detect, text):
            tried.append(rule.about)
            text = rule.apply(text)
    return text, tried


def rewrite(files: DataFrame, pack: Pack, check: Checker | None = None) -> DataFrame:
    """Files (path, text) that change: path, after, rules_applied, diff, syntax (pass, fail or skipped)."""
    wanted = F.regexp_extract("path", r"(\.[^./]+)\z", 1).isin(V.REWRITTEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                after, tried = applied(pack, text or "")
                if after != (text or ""):
                    verdict = check(path, after) if check else None
                    rows.append((path, after, tried, W.unified_diff(path, text or "", after), verdict or "skipped"))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["path", "after", "rules_applied", "diff", "syntax"])

    return files.where(wanted).select("path", "text").mapInArrow(run, "path string, after string, rules_applied array<string>, diff string, syntax string")


def moves(files: DataFrame, pack: Pack) -> DataFrame:
    """Moves whose source is there and whose destination is not: from_path, to_path, diff."""
    spark = files.sparkSession
    listed = spark.createDataFrame(list(pack.moves), "from_path string, to_path string")
    paths = files.select("path")
    out = listed.join(paths, F.col("from_path") == F.col("path"), "left_semi").join(paths, F.col("to_path") == F.col("path"), "left_anti")
    head = F.concat(F.lit("diff --git a/"), "from_path", F.lit(" b/"), "to_path", F.lit("\nsimilarity index 100%\nrename from "), "from_path", F.lit("\nrename to "), "to_path", F.lit("\n"))
    return out.withColumn("diff", head)


def report(changed: DataFrame) -> DataFrame:
    """One row: files changed, verdicts, and a status that is 'ran' if any check ran, else why not."""
    ran = F.col("syntax") != "skipped"
    return changed.agg(F.count("*").alias("files_changed"), F.count_if(F.col("syntax") == "pass").alias("passed"), F.count_if(F.col("syntax") == "fail").alias("failed"), F.count_if(~ran).alias("skipped"), F.when(F.bool_or(ran), "ran").otherwise(F.min_by("syntax", "path")).alias("status"))


def applicable(packs: list[Pack], providers: set[str], refused: set[str] = frozenset(), acknowledged: bool = False) -> tuple[list[Pack], list[str]]:
    """Packs of detected providers, and the names of those that are refused as stale."""
    fits = [p for p in packs if p.provider in providers]
    held = [p.name for p in fits if p.name in refused and not acknowledged]
    return [p for p in fits if p.name not in held], held


def exit_code(changed: int, held: list[str]) -> int:
    """0 where files changed, 3 where packs were refused, 1 where nothing was to be done."""
    return 3 if held else 0 if changed else 1
