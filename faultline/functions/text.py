"""Scalar functions over change records and code text, all as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

_ANY_CASE = "(?i)"
_BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


_WORD_SET = r"(?:\[(?:[a-z]-[a-z]|[A-Z]-[A-Z]|[0-9]-[0-9]|[A-Za-z0-9_])+\]|\\[dw])"  # a set of ASCII word characters alone
_AT_LEAST_ONE = r"(?:\+|\{[1-9]\d*(?:,\d*)?\})"


def ascii_bounds(pattern: str) -> str:
    """``pattern`` with each \\b between ASCII word characters and others, as \\w has it. To Java's own \\b, letters of all scripts
    and marks are of words, so that no name would begin right behind one. Beside a set of word characters only the other side is asked."""
    unescaped = r"(?<!\\)((?:\\\\)*)"
    pattern = re.sub(rf"{unescaped}\\b(?={_WORD_SET}(?:{_AT_LEAST_ONE}|(?![?*+{{])))", lambda m: m.group(1) + r"(?<!\w)", pattern)
    pattern = re.sub(rf"{unescaped}({_WORD_SET}{_AT_LEAST_ONE}?)\\b", lambda m: m.group(1) + m.group(2) + r"(?!\w)", pattern)
    return re.sub(rf"{unescaped}\\b", lambda m: m.group(1) + _BOUND, pattern)


_PLAIN = r"[A-Za-z0-9_ @:=/-]"
_COUNT = r"(?:[?*+]|\{\d+(?:,\d*)?\})[?+]?"
_PART = rf"(?:({_PLAIN})|\(({_PLAIN}+(?:\|{_PLAIN}+)*)\)|\[[^\[\]\\&]+\]|\\[.bdsw])({_COUNT})?"


def marks(pattern: str) -> list[str]:
    """Strings of which a text must hold one for ``pattern`` to match: its longest run of plain characters, or a group of such by
    alternatives, that no count follows. None where it has no such run, or any part but plain characters, sets of them and these groups."""
    if not re.fullmatch(f"(?:{_PART})*", pattern):
        return []
    runs = [[""]]
    for plain, group, count in re.findall(_PART, pattern):
        if plain and not count:
            runs[-1] = [runs[-1][0] + plain]
        else:
            runs += [[""] if count else group.split("|"), [""]]
    best = max(runs, key=lambda run: min(map(len, run)))
    return best if all(best) else []


def somewhere(pattern: str) -> str:
    """``pattern`` for asking only whether it matches: where it begins with one or more of a set, one is enough, and a long run of the set
    is not read again from each of its characters."""
    return re.sub(r"\A(\[[^\[\]\\&]+\])\+(?![?+])", r"\1", pattern)


def strip_boilerplate(text: Column | str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, _ANY_CASE + p, " "), V.BOILERPLATE, _column(text))


def removes_contract(text: Column | str, removal: str = V.REMOVAL, tooling: str = V.TOOLING) -> Column:
    """Whether some line or sentence speaks of a removal and not of tooling."""
    return F.exists(F.split(_column(text), r"[\n.;]"), lambda s: s.rlike(_ANY_CASE + ascii_bounds(removal)) & ~s.rlike(_ANY_CASE + ascii_bounds(tooling)))


def version_class(title: Column | str) -> Column:
    """breaking, additive or fix by the release number a title ends or begins with; null for pre-releases and others."""
    t = _column(title)
    forms = [(r"(?:^|[@\sv])(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z.-]+)?\s*\z", t), (r"^v?(\d+)\.(\d+)\.(\d+)(-[0-9A-Za-z.-]+)?\s*[:\s]", t)]
    found = F.lit(None).cast("string")
    for pattern, c in reversed(forms):
        part = lambda i, p=pattern, c=c: F.regexp_extract(c, p, i)
        kind = F.when(part(4) != "", None).when((part(2) == "0") & (part(3) == "0"), "breaking").when(part(3) == "0", "additive").otherwise("fix")
        found = F.when(c.rlike(pattern), kind).otherwise(found)
    return found


def classify(text: Column | str, title: Column | str, vocabulary: dict[str, str] | None = None) -> Column:
    """First that applies: strong wording, contract removal, deprecation, addition, fix, docs, release number, unknown."""
    v = {"strong": V.STRONG_BREAK, "removal": V.REMOVAL, "tooling": V.TOOLING, "deprecation": V.DEPRECATION, "additive": V.ADDITIVE, "fix": V.FIX, "docs": V.DOCS} | (vocabulary or {})
    t = strip_boilerplate(text)
    says = lambda k: t.rlike(_ANY_CASE + ascii_bounds(v[k]))
    return (
        F.when(says("strong") | removes_contract(t, v["removal"], v["tooling"]), "breaking")
        .when(says("deprecation"), "deprecation")
        .when(says("additive"), "additive")
        .when(says("fix"), "fix")
        .when(says("docs"), "docs-only")
        .otherwise(F.coalesce(version_class(title), F.lit("unknown")))
    )


def prerelease_release(title: Column | str) -> Column:
    """The scan's test: a three-part number with a pre-release tag, or a, b, rc and digits right behind it."""
    return _column(title).rlike(ascii_bounds(r"(?i)\d+\.\d+\.\d+\s*(-[0-9A-Za-z.]*(alpha|beta|rc|canary|next|dev|preview|pre)|(a|b|rc)\d+)\b"))


def prerelease_tag(title: Column | str) -> Column:
    """The audit's test, another one: alpha, beta or rc after a separator, anywhere."""
    return _column(title).rlike(ascii_bounds(r"(?i)[-.](alpha|beta|rc)[-.]?\d*\b"))


def severity(change_type: Column | str) -> Column:
    pairs = [x for k, v in V.SEVERITY.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _column(change_type)), F.lit("low"))


def source_type(source: Column | str) -> Column:
    s = _column(source)
    return F.when(s.startswith("changelog:"), "changelog").when(s.startswith("spec-diff:"), "spec-diff").otherwise("sdk-release")


def endpoint_level(source: Column | str) -> Column:
    s = F.coalesce(_column(source), F.lit(""))
    return s.startswith("changelog:") | s.startswith("spec-diff:")


def confidence(matched: Column, extracted: Column, kinds: Column, source: Column | str, title: Column | str) -> Column:
    """high where symbols match; medium where some were named and the package is imported, or the host is called and the
    source speaks of endpoints; else low. A pre-release that no endpoint source names goes one step down."""
    has = lambda k: F.array_contains(kinds, k)
    base = F.when(matched > 0, "high").when((extracted > 0) & (has("import") | (endpoint_level(source) & has("api-host"))), "medium").otherwise("low")
    lower = prerelease_release(F.coalesce(_column(title), F.lit(""))) & ~endpoint_level(source)
    return F.when(lower, F.when(base == "high", "medium").otherwise("low")).otherwise(base)


def symbols(text: Column | str) -> Column:
    """Distinct names a change mentions: packages, camel and Pascal case, dotted, snake case, and what is in backticks. Each form is
    sought only in texts that have what all names of that form have. No pattern gives back what could only fail again."""
    t = F.coalesce(_column(text), F.lit(""))
    all_of = lambda p: F.regexp_extract_all(t, F.lit(ascii_bounds(p)), F.lit(1))
    where = lambda held, names: F.when(held, names).otherwise(F.array().cast("array<string>"))
    capital = t.rlike(r"[A-Z](?<=[a-z0-9][A-Z])")  # right behind a small letter or digit; looks for the rarer side first
    camel = F.concat(
        all_of(r"(?<!\w)([a-z]++[A-Z][A-Za-z0-9]*+)(?!\w)"),
        all_of(r"([A-Z](?<!\w[A-Z])[a-z0-9]++[A-Z][A-Za-z0-9]*+)(?!\w)"),
    )
    dotted = F.filter(all_of(r"((?:(?<!\w)[A-Za-z_]|\$(?<=\w\$))[\w$]*+(?:\.[A-Za-z_$][\w$]*)+)\b"), lambda s: ~s.rlike(r"(?i)\.(md|json|yml|yaml|txt|com|org|io)\z"))
    found = F.concat(
        where(t.contains("@"), all_of(r"(@[a-z0-9-]+/[a-z0-9._-]+)")),
        where(capital, camel),
        where(t.rlike(r"\.[A-Za-z_$]"), dotted),
        where(t.contains("_"), all_of(r"(?<!\w)([a-z][a-z0-9]*+(?:_[a-z0-9]++)+)(?!\w)")),
        where(t.contains("`"), all_of(r"`([^`\n]{2,80})`")),
    )
    stop = F.array(*map(F.lit, V.STOP_WORDS))
    trimmed = F.transform(found, lambda s: F.regexp_replace(s, r"\A\p{Zs}+|\p{Zs}+\z", ""))
    fits = lambda s: (F.length(s) >= 4) & (F.length(s) <= 80) & ~F.array_contains(stop, F.lower(s)) & ~s.rlike(r"^\d+\z")
    return F.array_distinct(F.filter(trimmed, fits))


def names_symbol(line: Column, symbol: Column) -> Column:
    """Whether a line has a symbol that is not part of a longer name."""
    quoted = F.regexp_replace(symbol, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    return line.contains(symbol) & F.regexp_like(line, F.concat(F.lit(r"(?<![\w$])"), quoted, F.lit(r"(?![\w$])")))


def sub_apis(provider: Column | str, title: Column | str, excerpt: Column | str) -> Column:
    t, x = F.coalesce(_column(title), F.lit("")), F.coalesce(_column(excerpt), F.lit(""))
    google = F.regexp_extract(t, r"(?i)^([a-z][a-z0-9_]*)\s*:\s*v?\d", 1)
    aws = F.regexp_extract_all(F.concat_ws("\n", t, x), F.lit(ascii_bounds(r"\bclient-([a-z0-9-]+)\b")), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when((_column(provider) == "google") & (google != ""), F.array(F.lower(google))).when(_column(provider) == "aws", F.array_distinct(aws)).otherwise(none)


def uses_sub_api(provider: Column | str, text: Column, sub: Column) -> Column:
    low = F.lower(text)
    return F.when(_column(provider) == "aws", low.contains(F.concat(F.lit("client-"), sub))).otherwise(names_symbol(low, sub))


def endpoints(line: Column | str, hosts: list[str]) -> Column:
    """Paths that follow a known host, slots as {param}, without trailing slashes."""
    quoted = "|".join(h.replace(".", r"\.") for h in hosts)
    found = F.regexp_extract_all(_column(line), F.lit(rf"(?:{quoted})(/[A-Za-z0-9_./${{}}\-]*)"), F.lit(1))
    tidy = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\$\{[^}]*\}", "{param}"), r"\{[^}]*\}", "{param}"), r"/+\z", "")
    return F.filter(F.transform(found, tidy), lambda p: (p != "") & (p != "/"))


_VERBS = "|".join(V.VERBS)


def _anchor(c: Column, group: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), group, 1), F.lit(""))


def anchor_path(title: Column | str, url: Column | str) -> Column:
    """The path after an HTTP verb: of the title, else of the URL."""
    p = ascii_bounds(rf"\b(?:{_VERBS})\s+(/[^\s:)]+)")
    return F.coalesce(_anchor(_column(title), p), _anchor(_column(url), p))


def anchor_surface(title: Column | str, url: Column | str) -> Column:
    """Verb and path, one space between."""

    def one(c: Column) -> Column:
        verb, path = (F.regexp_extract(F.coalesce(c, F.lit("")), ascii_bounds(rf"\b({_VERBS})\s+(/[^\s:)]+)"), i) for i in (1, 2))
        return F.when(verb != "", F.concat_ws(" ", verb, path))

    return F.coalesce(one(_column(title)), one(_column(url)))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _overlap(a: Column, b: Column, same) -> Column:
    x, y = _segments(a), _segments(b)
    n = F.least(F.size(x), F.size(y))
    fits = F.forall(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), same), lambda ok: ok)
    return (n > 0) & fits & ((n >= 2) | (n == F.greatest(F.size(x), F.size(y))))


def paths_overlap(code: Column, anchor: Column) -> Column:
    """Endpoint in code against an anchor: only {param} is a slot on the code's side, any {...} on the other."""
    return _overlap(code, anchor, lambda x, y: (x == y) | (x == "{param}") | y.rlike(r"^\{[^}]+\}\z"))


def anchors_overlap(a: Column, b: Column) -> Column:
    """Anchor against anchor: {...} is a slot on both sides."""
    return _overlap(a, b, lambda x, y: (x == y) | x.rlike(r"^\{[^}]+\}\z") | y.rlike(r"^\{[^}]+\}\z"))


def stream(source: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_column(source), F.lit("")), r"-v?\d[\w.]*-to-v?\d[\w.]*\z", "")


def chronology(effective: Column | str, fetched: Column | str) -> Column:
    return F.coalesce(F.nullif(_column(effective), F.lit("")), F.substring(F.coalesce(_column(fetched), F.lit("")), 1, 10))


def redact(text: Column | str, secrets: list[tuple[str, str]] = V.SECRETS, marks: list[list[str]] = V.SECRET_MARKS) -> Column:
    """Secrets replaced, in order. The assignment rule's value is a group, not a look-behind, which Java would not match. A
    pattern is tried only on texts with one of its marks; no pattern can make a mark, so the text as given is what is asked."""
    low = F.lower(_column(text))

    def step(t: Column, rule: tuple[tuple[str, str], list[str]]) -> Column:
        (pattern, new), wanted = rule
        pattern = ascii_bounds(pattern)
        if not wanted:
            return F.regexp_replace(t, pattern, new)
        held = reduce(lambda a, b: a | b, [low.contains(m) for m in wanted])
        once = F.transform(F.array(t), lambda x: F.when(held, F.regexp_replace(x, pattern, new)).otherwise(x))  # names x, so that t stands once
        return F.get(once, F.lit(0))

    return reduce(step, zip(secrets, marks, strict=True), _column(text))


def is_redacted(text: Column | str) -> Column:
    """Whether nothing is left to redact."""
    return F.coalesce(redact(text).eqNullSafe(_column(text)), F.lit(True))


def basename(path: Column | str) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(_column(path), F.lit("")), r"[\\/]+\z", ""), r"([^\\/]*)\z", 1)


def snippet(line: Column | str, most: int = V.SNIPPET) -> Column:
    return F.substring(F.trim(_column(line)), 1, most)


def content_address(kind: Column | str, anchor: Column | str, detail: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", _column(kind), _column(anchor), _column(detail)))


def parent_path(path: Column | str) -> Column:
    """Without the last dotted segment, and then without a trailing []."""
    p = _column(path)
    up = F.when(p.contains("."), F.regexp_replace(p, r"\.[^.]*\z", "")).otherwise("")
    return F.regexp_replace(up, r"\[\]\z", "")


def chain_suffixes(chain: Column | str) -> Column:
    """All tails of a dotted call chain, its root never among them: what a pack's chain is looked up in."""
    parts = F.filter(F.split(_column(chain), r"\."), lambda s: s != "")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))).otherwise(F.array().cast("array<string>"))


def decode_entities(text: Column | str) -> Column:
    """CDATA, then entities; the ampersand last, so that no entity is decoded twice."""
    t = F.regexp_replace(_column(text), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return t


def plain_text(html: Column | str, most: int = V.EXCERPT) -> Column:
    """Tags out, white space to single spaces, cut."""
    return F.substring(F.regexp_replace(F.regexp_replace(_column(html), r"<[^>]+>", " "), r"[ \t\n\x0B\f\r]+", " "), 1, most)
