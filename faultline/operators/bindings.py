"""Calls of provider packages, proven by how their roots were bound.

Files become facts (one Arrow pass): modules bound, clients built, aliases, assignments, exports and imports between
files, scopes, and call chains. What a chain's root is, is then relational. Names are first made those of their scope
(``scopes``). A name may be a path: what a field holds is known by the path of the object and the field. Aliases are loads
(the aliased path begins with a known one) or name the object that holds a known path; both are equi-joins, run until nothing
is new. Exports are paths too, followed from file to file with the path of files seen, until nothing is new. A root
counts only if it is proven; a path that is bound twice in a file, or whose object is, is dropped, since a miss is better
than a false hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import lexer
from ..functions.rewrite import closing
from ..functions.vocabulary import SNIPPET
from ..sources.files import language
from . import scopes as scoping
from .relational import dealt

_N = r"[A-Za-z_$][\w$]*"
_PATH = rf"(?:this|{_N})(?:\.#?{_N}){{0,3}}"
_INLINE = "new@"  # stands before the place of a client that is built and called at once
_FIELDS = ["file", "fact", "name", "target", "member", "chain", "line", "snippet", "at", "upto", "seq"]
_NUMBERS = {"line", "at", "upto", "seq"}
_SCHEMA = "file string, fact string, name string, target string, member string, chain string, line long, snippet string, at long, upto long, seq long"
_SUFFIXES = ["", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", "/index.js", "/index.ts"]

#: Module bindings by language: pattern on text without comments; groups name the module, and the names it is bound to.
_MODULES = {
    "js": [
        rf"(?m)^\s*import\s+(?P<default>{_N})?\s*,?\s*(?:\{{(?P<named>[^}}]*)\}}|\*\s*as\s+(?P<space>{_N}))?\s*from\s*['\"](?P<module>[^'\"]+)['\"]",
        rf"(?:const|let|var)\s+(?:(?P<default>{_N})|\{{(?P<named>[^}}]*)\}})\s*=\s*require\s*\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)(?!\s*[.(])",
    ],
    "py": [rf"(?m)^\s*import\s+(?P<module>[\w.]+)(?:\s+as\s+(?P<default>{_N}))?\s*$", r"(?m)^\s*from\s+(?P<module>[\w.]+)\s+import\s+(?:(?P<named>[\w, \t]+)$|\((?P<lines>[\w,\s]+)\))"],
    "go": [r"(?m)^\s*(?:import\s+)?(?:(?P<default>[A-Za-z]\w*)\s+)?\"(?P<module>[\w.-]+\.[\w./-]+)\"\s*$"],
    "rb": [r"(?m)^\s*require\s+['\"](?P<module>[\w-]+)['\"]"],
    "php": [r"(?m)^\s*use\s+(?P<module>[A-Z]\w*(?:\\\w+)+)(?:\s+as\s+(?P<default>\w+))?\s*;"],
}
#: Assignments: the name that is written, and what follows.
_ASSIGN = {
    "js": rf"(?<![\w$.#])(?:(?:const|let|var)\s+)?(?P<name>{_PATH})\s*(?::\s*[\w.<>]+\s*)?(?P<op>\?\?|\|\||&&)?=(?![=>])\s*(?:await\s+)?",
    "py": rf"(?m)^\s*(?P<inline>(?:if|elif|while)\b[^\n:]*:[ \t]*|(?:else|try)[ \t]*:[ \t]*|def\s[^\n]*\)[^\n:()]*:[ \t]*)?(?P<name>(?:self\.)?{_N})[ \t]*(?::[ \t]*[\w.\[\]]+[ \t]*)?=(?!=)\s*(?:await\s+)?|\bwith\s+(?P<value>[\w.]+\([^)\n]*\))\s+as\s+(?P<as>{_N})|\(\s*(?P<walrus>{_N})\s*:=\s*",
    "go": r"(?m)^\s*(?:var\s+)?(?P<name>[A-Za-z]\w*)(?:\s*,\s*\w+)*\s*(?::=|=(?!=))\s*",
    "rb": r"(?m)^\s*(?P<name>@{0,2}[a-z_]\w*|[A-Z][A-Z0-9_]+)\s*(?:\|\|)?=(?![=~>])\s*",
    "php": r"(?P<name>\$(?:this->)?\w+)\s*(?:\?\?)?=(?![=>])\s*",
}
#: What builds a client, at the start of an assigned value.
_BUILD = {
    "js": rf"(?:new\s+(?P<ctor>{_N}(?:\.{_N})*)|(?P<factory>{_N}))\s*\(",
    "py": rf"(?P<ctor>{_N}(?:\.{_N})*)\s*\(",
    "go": r"(?P<ctor>[a-z]\w*\.New\w*)\s*\(",
    "rb": r"(?P<ctor>[A-Z]\w*(?:::[A-Z]\w*)*)\.new\b\s*(?:\(|$)?",
    "php": r"new\s+\\?(?P<ctor>[A-Z]\w*(?:\\\w+)*)\s*\(",
}
_DOT = {"js": r"(?:\?\.|!?\.)", "py": r"\.", "go": r"\.", "rb": r"\.", "php": r"->"}
#: A dynamic import, or the name of a stored one; and the forms that take a module out of it.
_LOAD = rf"(?:import\s*\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)|(?P<stored>{_N}))"
_LOADED = [
    rf"(?:const|let|var)\s+(?:\{{(?P<named>[^}}]*)\}}|(?P<space>{_N}))\s*=\s*await\s+{_LOAD}\s*(?:;|$)",
    rf"(?:const|let|var)\s+(?P<one>{_N})\s*=\s*\(\s*await\s+{_LOAD}\s*\)\s*\.\s*(?P<head>{_N})\s*(?:;|$)",
    rf"(?<![\w$.]){_LOAD}\s*\.\s*then\s*\(\s*(?:async\s+)?\(?\s*(?:\{{(?P<named>[^}}]*)\}}|(?P<space>{_N}))\s*\)?\s*=>",
]
_STORED = rf"(?m)(?:const|let|var)\s+({_N})\s*=\s*import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)\s*(?:;|$)"
_ALL_LOADED = r"(?:const|let|var)\s+\[(?P<names>[^\]=]*)\]\s*=\s*await\s+Promise\s*\.\s*all\s*\(\s*\[(?P<loads>[^\]]*)\]\s*\)"
#: Fields and constructor parameters with a type, where the declaration alone says what they hold.
_TYPED = {
    "js": [
        (rf"(?:private|protected|public|readonly)\s+(?:readonly\s+)?(?P<name>{_N})\s*[!?]?:\s*(?P<ctor>[A-Z][\w$]*(?:\.{_N})*)\s*(?=[,;)\n])", "this."),
        (rf"(?<=[(,])\s*(?P<name>{_N})\s*:\s*(?P<ctor>[A-Z][\w$]*(?:\.{_N})*)\s*(?=[,)])", ""),
        (rf"(?m)^\s*(?:readonly\s+)?(?P<name>#{_N})\s*[!?]?:\s*(?P<ctor>[A-Z][\w$]*(?:\.{_N})*)\s*(?=[;\n])", "this."),
    ],
    "py": [(rf"(?<=[(,])\s*(?P<name>{_N})\s*:\s*(?P<ctor>[A-Za-z_][\w]*(?:\.{_N})*)\s*(?=[,)])", "")],
    "php": [
        (r"(?:private|protected|public)\s+(?:readonly\s+)?\??\\?(?P<ctor>[A-Z]\w*(?:\\\w+)*)\s+\$(?P<name>\w+)\s*(?=[,;)])", "$this->"),
        (r"(?<=[(,])\s*\\?(?P<ctor>[A-Z]\w*(?:\\\w+)*)\s+\$(?P<name>\w+)\s*(?=[,)])", "$"),
    ],
}


def _names(text: str) -> Iterator[tuple[str, str]]:
    for part in text.split(","):
        words = part.replace(":", " ").split()
        words = [w for w in words if w not in ("as", "type")]
        if words:
            yield words[0], words[-1]


class File:
    """Facts of one file."""

    def __init__(self, path: str, text: str, lang: str):
        self.path, self.text, self.lang = path, text, lang
        self.prose, self.code = lexer.mask_prose(text, lang), lexer.mask_code(text, lang)
        self.lines = text.split("\n")
        self.rows: list[tuple] = []
        self.guards: list[tuple[str, int, int]] | None = None
        self.stored = {m.group(1): m.group(2) for m in re.finditer(_STORED, self.prose)} if lang == "js" else {}

    def add(self, fact: str, name: str, target: str | None = None, member: str | None = None, chain: str | None = None, at: int = 0, upto: int | None = None) -> None:
        line = self.text.count("\n", 0, at) + 1
        self.rows.append((self.path, fact, name, target, member, chain, line, self.lines[line - 1].strip()[:SNIPPET], at, upto, len(self.rows)))

    def facts(self) -> list[tuple]:
        self._modules()
        self._assignments()
        if self.lang == "js":
            self._objects()
            self._loaded()
            self._exports()
        if self.lang == "rb":
            self._accessors()
        self._typed()
        self._calls()
        for name, at, upto in scoping.scopes(self.code, self.lang):
            if name not in ("self", "cls", "this", "$this"):  # fields are known throughout a file
                self.add("scope", name, at=at, upto=upto)
        return self.rows

    def _modules(self) -> None:
        for pattern in _MODULES.get(self.lang, ()):
            for m in re.finditer(pattern, self.prose):
                g = m.groupdict()
                module = g["module"]
                local = module.startswith(".")
                for exported, name in _names(g.get("named") or g.get("lines") or ""):
                    self.add("import" if local else "module", name, module, exported, at=m.start("module"))
                if g.get("space"):
                    self.add("import" if local else "module", g["space"], module, "*", at=m.start("module"))
                default = g.get("default")
                if not default and not g.get("named") and not g.get("lines") and not g.get("space"):
                    default = {"py": module.split(".")[0], "go": re.sub(r"^go-|-go$", "", re.sub(r"/v\d+$", "", module).split("/")[-1]), "rb": module, "php": module.split("\\")[-1]}.get(self.lang)
                if default:
                    whole = local and self.lang == "js" and "require" in m.group()  # what module.exports is, and all single exports
                    self.add("import" if local else "module", default, module, "@module" if whole else "@default", at=m.start("module"))
                    if whole:
                        self.add("import", default, module, "*", at=m.start("module"))

    def _loaded(self) -> None:
        """Names that hold an imported module, or a part of it, once its promise is awaited. A name that is also assigned is
        left out, since the text does not say which one a call means."""
        writes = [name for _, fact, name, *_ in self.rows if fact in ("client", "alias", "other")]
        stored = {n: module for n, module in self.stored.items() if n not in writes}
        real = lambda m: self.code.startswith(m.group()[:5], m.start())
        for pattern in _LOADED:
            for m in filter(real, re.finditer(pattern, self.prose, re.M)):
                g = m.groupdict()
                at = next(m.start(k) for k in ("named", "space", "one") if g.get(k) is not None)
                self._load(g["module"] or stored.get(g["stored"]), g.get("named"), g.get("space"), (g.get("head"), g.get("one")), at)
        for m in filter(real, re.finditer(_ALL_LOADED, self.prose)):
            names, loads = re.split(r",(?![^{]*\})", m.group("names")), m.group("loads").split(",")
            for name, load in zip(names, loads):
                source, name = re.fullmatch(_LOAD, load.strip()), name.strip()
                if source and name:
                    named = name.strip("{}") if name.startswith("{") else None
                    self._load(source["module"] or stored.get(source["stored"]), named, None if named else name, (None, None), m.start())

    def _load(self, module: str | None, named: str | None, space: str | None, head: tuple, at: int) -> None:
        if not module:
            return
        pairs = [*_names(named or ""), *([("*", space)] if space else []), *([head] if head[1] else [])]
        for member, name in pairs:
            if not any(r[1] in ("client", "alias", "other") and r[2] == name for r in self.rows):
                self.add("import" if module.startswith(".") else "module", name, module, "@default" if member == "default" else member, at=at)

    def _typed(self) -> None:
        """Fields and parameters whose type is a client's class: a field if nothing in the file writes it and one type is given, a
        parameter within its scope."""
        said: dict[str, list] = {}
        for pattern, before in _TYPED.get(self.lang, ()):
            for m in re.finditer(pattern, self.code):
                said.setdefault(before + m.group("name"), []).append(m)
        written = {name for _, fact, name, *_ in self.rows if fact in ("client", "alias", "other")}
        for name, found in said.items():
            field = "." in name or "->" in name
            if field and name not in written and len({m.group("ctor") for m in found}) == 1:
                self.add("client", name, found[0].group("ctor"), at=found[0].start("name"))
            for m in found if not field else ():
                self.add("client", name, m.group("ctor"), at=m.start("name"))

    def _accessors(self) -> None:
        """Methods that do nothing but build a field once: their name stands for the field."""
        for m in re.finditer(r"(?m)^\s*def\s+(?:self\.)?(?P<name>[a-z_]\w*)[ \t]*(?:\([ \t]*\))?[ \t]*\n\s*(?P<field>@{1,2}\w+)\s*\|\|=[^\n]*\n\s*end\b", self.code):
            if len(re.findall(rf"(?m)^\s*def\s+(?:self\.)?{m.group('name')}\b", self.code)) == 1:
                self.add("alias", m.group("name"), m.group("field"), chain="", at=m.start("name"))

    def _value(self, name: str, at: int) -> None:
        """What the value at ``at`` gives a name: a client, an alias, or something unknown."""
        line_end = self.code.find("\n", at)
        line_end = len(self.code) if line_end < 0 else line_end
        again = re.compile(rf"(?P<next>(?:this\.|self\.|\$|@)?{_N})\s*=(?![=>~])").match(self.code, at)
        if again:  # a = b = value
            self.add("alias", name, again.group("next"), chain="", at=at)
            return
        m = re.compile(_BUILD[self.lang]).match(self.code, at)
        if m and self.lang == "js" and m.group("factory") in ("require", "import"):
            close = closing(self.code, m.end() - 1)
            taken = close is not None and re.compile(rf"(?:\.{_N})*[ \t]*(?:;|,|$|\n)").match(self.code, close + 1)
            own = close is not None and self.prose[m.end() : close].strip(" '\"").startswith(".")
            if taken and (own or not taken.group().startswith(".")):
                return  # a module, or a path into one of the tree: it is named where modules are
        if m:
            g = m.groupdict()
            ctor = g.get("ctor") or g.get("factory")
            end = m.end()
            if self.code[m.end() - 1] == "(":
                close = closing(self.code, m.end() - 1)
                end = line_end if close is None else close + 1
            if self.lang == "php" and "\\" in ctor.lstrip("\\"):
                head = ctor.lstrip("\\").split("\\")[0]
                self.add("module", head, head, "@default", at=at)  # the full name is its own import
            self.add("other" if self._trailer(end) else "client", name, ctor, at=at)
            return
        m = re.compile(rf"(?P<root>(?:this\.#?|self\.|\$|@)?{_N})(?P<chain>(?:{_DOT[self.lang]}#?{_N})*)[ \t]*(?:;|,|$|\n)").match(self.code, at)
        if m and m.group("root") in self.stored:
            return  # what an awaited promise gives is named with the imports
        if m and m.group("root") not in ("new", "null", "undefined", "None", "nil", "true", "false"):
            chain = re.sub(_DOT[self.lang], ".", m.group("chain")).strip(".")
            self.add("alias", name, m.group("root"), chain=chain, at=at)
            return
        if self.lang == "js" and re.compile(r"\(\s*await\s+import\b").match(self.code, at):
            return
        empty = re.compile(r"(?:null|undefined|None|nil)\b").match(self.code, at)
        self.add("empty" if empty else "other", name, at=at)

    def _trailer(self, end: int) -> bool:
        """Whether something is taken from the value that ends there."""
        return bool(re.compile(r"\s*(?:\?\.|\.|\??->)\s*\w").match(self.code, end))

    def _objects(self) -> None:
        """Fields of object literals, frozen or not, and fields taken out of an object by name."""
        for m in re.finditer(rf"(?:const|let|var)\s+(?P<name>{_N})\s*=\s*(?P<hold>Object\.(?:freeze|seal|preventExtensions)\s*\(\s*)?\{{", self.code):
            close = closing(self.code, m.end() - 1)
            if close is None:
                continue
            at = m.end()
            for part in scoping._top(self.code[at:close]):
                field = re.match(rf"\s*(?P<key>{_N})\s*:\s*", part)
                if field:
                    self._choice(f"{m.group('name')}.{field.group('key')}", at + field.end(), at + len(part))
                at += len(part) + 1
        for m in re.finditer(rf"(?m)(?:const|let|var)\s*\{{(?P<named>[^{{}}]*)\}}\s*=\s*(?P<of>{_PATH})\s*(?:;|$)", self.code):
            for part in m.group("named").split(","):
                for member, name in _names(part.split("=")[0]):
                    if "=" in part:
                        self.add("other", name, at=m.start("named"))
                    else:
                        self.add("alias", name, m.group("of"), chain=member, at=m.start("named"))

    def _assignments(self) -> None:
        if self.lang not in _ASSIGN:
            return
        for m in re.finditer(_ASSIGN[self.lang], self.code):
            g = m.groupdict()
            if g.get("as"):
                self._value(g["as"], m.start("value"))
                continue
            name = g.get("name") or g.get("walrus")
            if self.lang == "js" and ":" in m.group() and re.search(r"(?:const|let|var)\s*\{[^{}]*$", self.code[max(0, m.start() - 200) : m.start()]):
                continue  # a default within braces, named where fields are taken out
            inline = re.fullmatch(r"(?:el)?if\s+(?:not\s+([\w.]+)|([\w.]+)\s+is\s+None)\s*:\s*", g.get("inline") or "")
            other = bool(g.get("inline")) and not g["inline"].startswith(("else", "try", "def")) and not (inline and name in inline.groups())
            if other or g.get("op") == "&&" or self._guarded_by_another(name, m.start("name")):
                self.add("other", name, at=m.start())
                continue
            self._choice(name, m.end())
            inner = re.compile(rf"(?P<name>(?:self\.|\$|@)?{_N})\s*=(?![=>~])[ \t]*").match(self.code, m.end()) if self.lang in ("py", "rb") else None
            while inner:  # patterns of these languages begin at the line
                self._choice(inner.group("name"), inner.end())
                inner = re.compile(rf"(?P<name>(?:self\.|\$|@)?{_N})\s*=(?![=>~])[ \t]*").match(self.code, inner.end())

    def _guards(self) -> list[tuple[str, int, int]]:
        """(name, from, to) of blocks that run only where the name holds nothing."""
        if self.lang == "js":
            test = rf"\bif\s*\(\s*(?:!\s*(?P<of>{_PATH})|(?P<none>{_PATH})\s*===?\s*(?:null|undefined))\s*\)"
            return [(m.group("of") or m.group("none"), m.end(), scoping._body(self.code, m.end())) for m in re.finditer(test, self.code)]
        if self.lang == "py":
            out = []
            for m in re.finditer(rf"(?m)^(?P<in>[ \t]*)if\s+(?:not\s+(?P<of>(?:self\.)?{_N})|(?P<none>(?:self\.)?{_N})\s+is\s+None)\s*:[ \t]*$", self.code):
                stop = re.compile(rf"(?m)^[ \t]{{0,{len(m.group('in'))}}}(?=\S)").search(self.code, m.end() + 1)
                out.append((m.group("of") or m.group("none"), m.end(), stop.start() if stop else len(self.code)))
            return out
        return []

    def _guarded_by_another(self, name: str, at: int) -> bool:
        """Whether an assignment stands in a block that runs only on the absence of some other name: it may not be what runs."""
        if self.guards is None:
            self.guards = self._guards()
        around = [of for of, lo, hi in self.guards if lo <= at < hi]
        return bool(around) and name not in around

    def _choice(self, name: str, at: int, upto: int | None = None) -> None:
        """The value at ``at``. Of a fallback or a ternary every operand must build a client, be the name itself or be empty."""
        line_end = self.code.find("\n", at)
        rest = self.code[at : min(len(self.code) if line_end < 0 else line_end, len(self.code) if upto is None else upto)]
        if not re.search(r"\|\||\?\?|\sor\s|\s\?\s|\selse\s", rest):
            return self._value(name, at)
        cuts = [*re.finditer(r"\|\||\?\?|\bor\b|\belse\b|(?<=\s)\?(?=\s)|(?<=\s):(?=\s)", rest)]
        starts, ends = [0, *(c.end() for c in cuts)], [*(c.start() for c in cuts), len(rest)]
        if any(c.group() == "?" for c in cuts):
            starts, ends = starts[1:], ends[1:]  # the first is a condition
        build, built, known = re.compile(_BUILD[self.lang]), [], True
        for a, b in zip(starts, ends):
            a += len(rest[a:b]) - len(rest[a:b].lstrip(" \t("))
            text = re.sub(r"\sif\s.*", "", rest[a:b]).strip(" \t;)") if self.lang == "py" else rest[a:b].strip(" \t;)")
            m = build.match(self.code, at + a)
            if m:
                built.append(at + a)
                close = closing(self.code, m.end() - 1) if self.code[m.end() - 1] == "(" else None
                known = known and not (close is not None and self._trailer(close + 1))
            else:
                known = known and text in (name, "null", "undefined", "None", "nil", "")
        if built and not known:
            self.add("other", name, at=at)
        else:
            self._value(name, built[0] if built else at)

    def _exports(self) -> None:
        find = lambda p, t=self.prose: re.finditer(p, t)
        for m in find(rf"(?m)^\s*export\s+(?:const|let|var)\s+({_N})"):
            self.add("export", m.group(1), m.group(1), at=m.start(1))
        for m in find(rf"(?m)^\s*export\s+default\s+({_N})\s*;?\s*$"):
            self.add("export", "@default", m.group(1), at=m.start(1))
        for m in find(r"(?m)^\s*export\s*\{([^}]*)\}(?:\s*from\s*['\"](\.[^'\"]*)['\"])?"):
            for name, public in _names(m.group(1)):
                public = "@default" if public == "default" else public
                if m.group(2):
                    self.add("forward", public, m.group(2), "@default" if name == "default" else name, at=m.start())
                else:
                    self.add("export", public, name, at=m.start())
        for m in find(rf"(?m)^\s*export\s*\*\s*(?:as\s+({_N})\s*)?from\s*['\"](\.[^'\"]*)['\"]"):
            self.add("forward", m.group(1) or "*", m.group(2), "*", at=m.start())
        for m in find(rf"(?m)^\s*(?:module\.)?exports\.({_N})\s*=\s*({_N})\s*;?\s*$"):
            self.add("export", m.group(1), m.group(2), at=m.start())
        for m in find(rf"(?m)^\s*module\.exports\s*=\s*(?:({_N})\s*;?\s*$|\{{([^{{}}]*)\}})"):
            if m.group(1):
                self.add("export", "@default", m.group(1), at=m.start())
                self.add("export", "@module", m.group(1), at=m.start())
            for part in (m.group(2) or "").split(","):
                for name, value in _names(part) if re.fullmatch(rf"\s*{_N}\s*(?::\s*{_N}\s*)?", part) else ():
                    self.add("export", name, value, at=m.start())
        # Slots: what one name of a module gives on is a path into another module, or all of it.
        for m in find(rf"(?m)^\s*(?:module\.)?exports(?:\.({_N}))?\s*=\s*require\s*\(\s*['\"](\.[^'\"]*)['\"]\s*\)((?:\.{_N})*)\s*;?\s*$"):
            self.add("forward", m.group(1) or "@module", m.group(2), m.group(3).lstrip(".") or "@module", at=m.start())
        for m in find(rf"(?m)^\s*(?:module\.)?exports\.({_N})\s*=\s*({_N}(?:\.{_N})+)\s*;?\s*$"):
            self.add("export", m.group(1), m.group(2), at=m.start())
        for m in find(rf"(?m)^\s*(?:const|let|var)\s+(?:({_N})|\{{([^{{}}]*)\}})\s*=\s*require\s*\(\s*['\"](\.[^'\"]*)['\"]\s*\)\.({_N}(?:\.{_N})*)\s*(?:;|$)"):
            if m.group(1):
                self.add("import", m.group(1), m.group(3), m.group(4), at=m.start())
            for part in (m.group(2) or "").split(","):
                for member, name in _names(part) if "=" not in part else ():
                    self.add("import", name, m.group(3), f"{m.group(4)}.{member}", at=m.start())

    def _calls(self) -> None:
        dot = _DOT.get(self.lang)
        if not dot:
            return
        root = {"js": rf"(?:this\.#?)?{_N}", "py": rf"(?:self\.)?{_N}", "rb": r"@{0,2}[a-z_]\w*|(?<!:)[A-Z][A-Z0-9_]+\b", "php": r"\$(?:this->)?\w+"}.get(self.lang, _N)
        tail = r"\s*(?:\(|\bdo\b|\{)" if self.lang == "rb" else r"\s*\("
        bare = r"|[ \t]+(?=[:'\"\w]+[ :'\"])" if self.lang == "rb" else ""
        for m in re.finditer(rf"(?<![\w$.@>])(?P<root>{root})(?P<chain>(?:\s*{dot}\s*{_N})+)(?:{tail}{bare})", self.code):
            chain = re.sub(rf"\s*{dot}\s*", ".", m.group("chain")).strip(".")
            self.add("call", m.group("root"), chain=chain, at=m.start("root"))
        if self.lang in ("js", "py", "php"):  # new X(k).a.b(): a client that no name holds
            for m in re.finditer(_BUILD[self.lang], self.code):
                close = closing(self.code, m.end() - 1) if m.group("ctor") else None
                after = re.compile(rf"(?P<chain>(?:\s*{dot}\s*{_N})+)\s*\(").match(self.code, close + 1) if close is not None else None
                if after and not re.search(r"[\w$.>]$", self.code[: m.start()]):
                    name = f"{_INLINE}{m.start()}"
                    self.add("client", name, m.group("ctor"), at=m.start())
                    self.add("call", name, chain=re.sub(rf"\s*{dot}\s*", ".", after.group("chain")).strip("."), at=m.start())


def code_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                lang = language(path or "")
                if lang and text:
                    rows += File(path, text, lang).facts()
            cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
            yield pa.record_batch([pa.array(c, pa.int64() if n in _NUMBERS else pa.string()) for n, c in zip(_FIELDS, cols)], _FIELDS)

    return files.select("path", "text").mapInArrow(extract, _SCHEMA)


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return rows.join(dealt(rows.groupBy(*keys).count().where("count = 1").select(*keys)), keys, "left_semi")


_DEPTH = 5  # names in a path
_ROOT = ["module", "provider", "ctor", "prefix"]


def _path(name: Column) -> Column:
    return F.replace(name, F.lit("->"), F.lit("."))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def _heads(path: Column, least: int = 0) -> Column:
    """What a path begins with, from its first name on, leaving at least so many names; at most ``_DEPTH`` names long."""
    names = F.split(path, r"\.")
    last = F.least(F.size(names) - least, F.lit(_DEPTH))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(names, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def _rest(path: str, head: str) -> Column:
    return F.substring(path, F.length(head) + 2, F.length(path))


def _closed(roots: DataFrame, aliases: DataFrame, hops: int) -> DataFrame:
    """Roots (file, name, module, provider, ctor, prefix) and what is bound to them over aliases (file, to, of); a bound path stays
    as it is. Of an alias, what it is taken from begins with a root, or it is an object that holds one. Each hop is written,
    so that the plan grows by one table a hop, and the last one is known."""
    bound = fresh = scratch.materialise(roots, "roots")
    loads = aliases.select("file", "to", "of", F.explode(_heads(F.col("of"))).alias("name"))
    for _ in range(hops):
        load = loads.join(dealt(fresh), ["file", "name"]).select("file", F.col("to").alias("name"), "module", "provider", "ctor", _joined(F.col("prefix"), _rest("of", "name")).alias("prefix"))
        held = fresh.withColumn("of", F.explode(_heads(F.col("name"), 1))).join(dealt(aliases), ["file", "of"])
        held = held.select("file", _joined(F.col("to"), _rest("name", "of")).alias("name"), *_ROOT)
        fresh = load.unionByName(held.where(F.size(F.split("name", r"\.")) <= _DEPTH)).join(dealt(bound.select("file", "name")), ["file", "name"], "left_anti")
        fresh = scratch.materialise(fresh.groupBy("file", "name").agg(F.min(F.struct(*_ROOT)).alias("r")).select("file", "name", "r.*"), "roots")
        if fresh.isEmpty():
            break
        bound = bound.unionByName(fresh)
    return bound


def _writes(facts: DataFrame) -> DataFrame:
    """Clients, aliases and other values of paths that are written once, as are the objects that hold them."""
    # To hold nothing yet is no other value, but a parameter that is emptied is no longer what was passed.
    rows = facts.where(F.col("fact").isin("client", "alias", "other") | ((F.col("fact") == "empty") & F.col("name").rlike(r"@\d"))).withColumn("name", _path(F.col("name")))
    twice = scratch.materialise(rows.groupBy("file", "name").count().where("count > 1").select("file", "name"), "twice")
    held = rows.withColumn("head", F.explode(_heads(F.col("name"))))
    spoilt = held.join(dealt(twice.select("file", F.col("name").alias("head"))), ["file", "head"]).select("file", "seq").distinct()
    return scratch.materialise(rows.join(dealt(spoilt), ["file", "seq"], "left_anti"), "writes")


def _aliases(writes: DataFrame) -> DataFrame:
    return writes.where("fact = 'alias'").select("file", F.col("name").alias("to"), _joined(_path(F.col("target")), F.col("chain")).alias("of"))


def client_roots(facts: DataFrame, packages: DataFrame, hops: int = 5) -> DataFrame:
    """file, name, module, provider, ctor, prefix: paths proven to hold a client. packages is (provider, module); facts are
    those of ``scopes.resolved``."""
    modules = facts.where("fact = 'module'").select("file", F.col("name").alias("bound"), F.col("target").alias("path"), "member").distinct()
    # A package is the path itself, or what stands before one of its separators; a dot separates only where there is no slash.
    steps = F.sequence(F.lit(1), F.length("path"))
    at = lambda i: F.substring("path", i, F.lit(1))
    ends = F.filter(steps, lambda i: at(i).isin("/", "\\") | ((at(i) == ".") & ~F.col("path").contains("/")))
    heads = F.array_append(F.transform(ends, lambda i: F.substring("path", F.lit(1), i - 1)), F.col("path"))
    modules = modules.withColumn("module", F.explode(F.array_distinct(heads))).join(packages, "module")
    writes = _writes(facts)
    built = writes.where("fact = 'client'").drop("member").withColumn("head", F.regexp_extract("target", r"^\\?(\w+)", 1))
    by_name = built.join(dealt(modules), "file").where((F.col("head") == F.col("bound")) | (F.lower("head") == F.lower(F.regexp_replace("bound", "[-_]", ""))))
    roots = by_name.select("file", "name", "module", "provider", F.when(~F.col("member").isin("@default", "*"), F.regexp_replace("target", r"^.*[.\\:]", "")).alias("ctor"), F.lit("").alias("prefix")).distinct()
    return _closed(roots, _aliases(writes), hops)


def surfaces(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """provider, kind, surface, file, line, snippet: a row for each proven call, by the longest path that is known; and one more,
    by constructor, where the client's class was imported by name."""
    calls = facts.where("fact = 'call'").select("file", "seq", "line", "snippet", _joined(_path(F.col("name")), F.col("chain")).alias("called"))
    found = calls.withColumn("name", F.explode(_heads(F.col("called"), 1))).join(dealt(roots), ["file", "name"])
    best = found.groupBy("file", "seq", "provider", "module").agg(F.max_by(F.struct("line", "snippet", "called", "name", "ctor", "prefix"), F.length("name")).alias("c"))
    calls = best.select("file", "provider", "module", "c.*").withColumn("called", _rest("called", "name"))
    chain = _joined(F.lit("client"), F.col("prefix"), F.col("called"))
    sdk = calls.select("provider", F.lit("sdk-call").alias("kind"), F.concat_ws(" ", "module", chain).alias("surface"), "file", "line", "snippet")
    named = F.concat_ws(".", scoping.shown(F.col("name")), "called")
    by_ctor = calls.where(F.col("ctor").isNotNull() & ~F.col("name").startswith(_INLINE)).select("provider", F.lit("controller-call").alias("kind"), F.concat_ws(" ", "module", "ctor", named).alias("surface"), "file", "line", "snippet")
    return sdk.unionByName(by_ctor)


def _resolved(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts with a relative target, and the file it stands for: the first candidate that exists."""
    steps = F.split(F.concat(F.regexp_replace("file", r"[^/]*\z", ""), F.col("target")), "/")
    shorter = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
    step = lambda out, x: F.when(x.isin("", "."), out).when((x == "..") & (F.coalesce(F.get(out, F.size(out) - 1), F.lit("..")) != ".."), shorter(out)).otherwise(F.array_append(out, x))
    rows = facts.withColumn("at", F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/"))
    rows = rows.withColumn("options", F.transform(F.array(*map(F.lit, _SUFFIXES)), lambda s: F.concat("at", s)))
    each = rows.select("*", F.posexplode("options").alias("rank", "source")).drop("options")
    known = each.join(dealt(files.select(F.col("path").alias("source"))), "source")
    return known.groupBy("file", "name", "target", "member").agg(F.min_by("source", "rank").alias("source"))


#: What a module gives under ``public`` (r), seen by who takes ``member`` of it as ``taken``: the new name and what is left of the
#: path. A star takes all names as they are, or as fields of what it is taken as.
_TAKEN = """CASE WHEN member = public THEN taken
  WHEN startswith(member, public || '.') OR (public = '@module' AND NOT startswith(member, '@') AND member <> '*') THEN taken
  WHEN startswith(public, member || '.') THEN CASE WHEN taken IN ('@module', '@default') THEN substring(public, length(member) + 2) ELSE taken || substring(public, length(member) + 1) END
  WHEN member = '*' AND taken = '*' AND NOT startswith(public, '@') THEN public
  WHEN member = '*' AND taken <> '*' AND public <> '@module' THEN concat_ws('.', nullif(taken, '@module'), regexp_replace(public, '^@default', 'default')) END"""
_LEFT = """concat_ws('.', nullif(prefix, ''), CASE WHEN startswith(member, public || '.') THEN substring(member, length(public) + 2) WHEN public = '@module' AND NOT startswith(member, '@') AND member <> '*' THEN member END)"""


def exported_roots(facts: DataFrame, roots: DataFrame, files: DataFrame, passes: int = 8, hops: int = 5) -> DataFrame:
    """Roots in files that import a client from another file, and what is bound to them there. Exports are followed from file to
    file, ``passes`` of them at most, and each pass is written: a recursive query ends with an error at a million rows. A path
    through a file and name that it has seen ends. A name that a file exports stays what it is, and of several ways the
    shortest counts."""
    exports = facts.where("fact = 'export'").select("file", F.col("name").alias("to"), _path(F.col("target")).alias("of")).distinct()
    own = exports.select("file", "to", "of", F.explode(_heads(F.col("of"))).alias("name")).join(dealt(roots), ["file", "name"]).select("file", F.col("to").alias("public"), "module", "provider", "ctor", _joined(F.col("prefix"), _rest("of", "name")).alias("prefix"))
    holders = roots.withColumn("of", F.explode(_heads(F.col("name"), 1))).join(dealt(exports), ["file", "of"])
    holders = holders.select("file", F.when(F.col("to").startswith("@"), _rest("name", "of")).otherwise(_joined(F.col("to"), _rest("name", "of"))).alias("public"), *_ROOT)
    own = scratch.materialise(own.unionByName(holders).distinct(), "exports")
    imports = facts.where("fact = 'import'").select("file", "name", "target", "member")
    # A name that is imported and exported goes on as a forward does.
    again = exports.withColumn("name", scoping.root(F.col("of"))).join(dealt(imports), ["file", "name"])
    again = again.select("file", F.col("to").alias("name"), "target", F.when(F.col("of") == F.col("name"), F.col("member")).when(F.col("member").isin("*", "@module"), _rest("of", "name")).otherwise(_joined(F.col("member"), _rest("of", "name"))).alias("member"))
    passed = facts.where("fact = 'forward'").select("file", "name", "target", "member")
    whole = passed.where("name = '@module' AND member <> '@module'").withColumn("name", F.lit("@default"))
    stars = passed.where("member = '@module'").select("file", F.when(F.col("name") == "@module", "*").otherwise(F.col("name")).alias("name"), "target", F.lit("*").alias("member"))
    forward = _resolved(passed.unionByName(whole).unionByName(stars).unionByName(again).distinct(), files)
    forward = scratch.materialise(forward.select("file", F.col("name").alias("taken"), "source", "member"), "forwards")
    key = F.concat("file", F.lit("\n"), "public")
    reach = fresh = scratch.materialise(own.withColumn("seen", F.array(key)), "reached")
    onward = forward.select(F.col("source").alias("from"), F.col("file").alias("to"), "taken", F.col("member"))
    for _ in range(passes):
        step = fresh.join(dealt(onward), F.col("file") == F.col("from")).select(F.col("to").alias("file"), F.expr(_TAKEN).alias("public"), "module", "provider", "ctor", F.expr(_LEFT).alias("prefix"), "seen")
        step = step.where(F.col("public").isNotNull() & ~F.array_contains("seen", key)).withColumn("seen", F.array_append("seen", key))
        fresh = scratch.materialise(step, "reached")
        if fresh.isEmpty():
            break
        reach = reach.unionByName(fresh)
    order = F.struct(F.size("seen"), *_ROOT)
    table = scratch.materialise(reach.groupBy("file", "public").agg(F.min_by(F.struct(*_ROOT), order).alias("r")).select(F.col("file").alias("source"), "public", "r.*"), "reach")
    taken = _resolved(imports, files).select("file", F.col("name").alias("taken"), "source", "member")
    found = taken.join(dealt(table), "source").select("file", F.expr(_TAKEN).alias("name"), "module", "provider", "ctor", F.expr(_LEFT).alias("prefix")).where("name IS NOT NULL")
    found = scratch.materialise(found.distinct(), "taken")
    written = facts.where(F.col("fact").isin("client", "alias", "other")).select("file", _path(F.col("name")).alias("name")).distinct()
    heads = found.withColumn("head", F.explode(_heads(F.col("name"))))
    spoilt = heads.join(dealt(written.select("file", F.col("name").alias("head"))), ["file", "head"]).select("file", "name").distinct()
    fresh = found.join(dealt(spoilt), ["file", "name"], "left_anti")
    return _closed(fresh, _aliases(_writes(facts)), hops)
