"""Lexical spans of source text in six language families, and masks made of them.

A scan yields spans of what is not plain code: comments, strings, templates, regular expressions and prose (doc strings,
heredocs). A mask blanks some kinds and keeps length and line breaks, so that lines and columns stay true. Scanning
is one pass over the text that jumps from opener to opener with a compiled pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

COMMENT, STRING, TEMPLATE, REGEX, PROSE, CODE = "comment", "string", "template", "regex", "prose", "code"
LANGUAGE = {".js": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".jsx": "js", ".py": "py", ".rb": "rb", ".go": "go", ".php": "php", ".sh": "sh"}

_OPENERS = {
    "js": re.compile(r"//|/\*|/|['\"`]"),
    "py": re.compile(r"#|(?i:\b(?:r|b|f|u|rb|br|fr|rf))?(?:'''|\"\"\"|'|\")"),
    "rb": re.compile(r"(?m:^=begin\b)|#|<<[~-]?(?:'\w+'|\"\w+\"|[A-Z_]\w*)|%[wWiIqQrsx]?[(\[{<|!/]|/|['\"`]"),
    "go": re.compile(r"//|/\*|['\"`]"),
    "php": re.compile(r"//|#(?!\[)|/\*|<<<[ \t]*(?:'\w+'|\"\w+\"|\w+)|['\"`]"),
    "sh": re.compile(r"#|['\"]"),
}
#: A slash after one of these begins a regular expression; after a name, a number or a closing bracket it divides.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|instanceof|yield|await|if|unless|while|until|when|and|or|not|then))\s*\Z")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}

Span = tuple[int, int, str]


def _quoted(text: str, at: int, quote: str, multiline: bool) -> int:
    """End of a string whose quote is at ``at``; an unclosed one ends with its line, or with the text."""
    i, n = at + len(quote), len(text)
    while i < n:
        if text[i] == "\\":
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif text[i] == "\n" and not multiline:
            return i
        else:
            i += 1
    return n


def _regex_end(text: str, at: int) -> int | None:
    i, inside = at + 1, False
    while i < len(text) and text[i] != "\n":
        if text[i] == "\\":
            i += 1
        elif text[i] == "[":
            inside = True
        elif text[i] == "]":
            inside = False
        elif text[i] == "/" and not inside:
            i += 1
            while i < len(text) and text[i].isalpha():
                i += 1
            return i
        i += 1
    return None


def _line_end(text: str, at: int) -> int:
    i = text.find("\n", at)
    return len(text) if i < 0 else i


def _balanced(text: str, at: int, opener: str) -> int:
    """End of a literal that nests its brackets."""
    close, depth, i = _PAIRS.get(opener, opener), 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == close and (close == opener and i > at or close != opener and depth == 1):
            return i + 1
        elif text[i] == opener:
            depth += 1
        elif text[i] == close:
            depth -= 1
        i += 1
    return len(text)


def _slots(text: str, start: int, end: int, lang: str, opener: str, kind: str) -> Iterator[Span]:
    """A literal with code slots: its text between slots, and what is not code inside them."""
    i = mark = start
    while i < end:
        if text[i] == "\\":
            i += 2
        elif text.startswith(opener, i):
            yield mark, i + len(opener), kind
            i += len(opener)
            depth, body = 1, i
            inner = list(_scan(text, i, end, lang, until_brace=True))
            i = body
            k = 0
            while i < end and depth:
                if k < len(inner) and inner[k][0] <= i < inner[k][1]:
                    i = inner[k][1]
                    k += 1
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            yield from (s for s in inner if s[1] <= i)
            mark = max(i - 1, body)
            i = max(i, body)
        else:
            i += 1
    yield mark, end, kind


def _template_end(text: str, at: int) -> int:
    """End of a backtick template, over nested templates in its slots."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "`":
            return i + 1
        if text.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(text) and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                if text[i] in "'\"":
                    i = _quoted(text, i, text[i], False)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            continue
        i += 1
    return len(text)


def _scan(text: str, start: int, end: int, lang: str, until_brace: bool = False) -> Iterator[Span]:
    i, depth = start, 0
    waiting: list[str] = []  # heredocs opened on this line
    pattern = _OPENERS[lang]
    while i < end:
        m = pattern.search(text, i, end)
        stop = m.start() if m else end
        if until_brace:
            for c in text[i:stop]:
                depth += (c == "{") - (c == "}")
            if depth < 0:
                return
        if waiting:  # bodies begin on the next line
            line = text.find("\n", i, stop)
            if line >= 0:
                at = line + 1
                for word in waiting:
                    close = re.compile(rf"^[ \t]*{re.escape(word)}\b", re.M).search(text, at)
                    finish = close.start() if close else len(text)
                    if finish > at:
                        yield at, finish, PROSE
                    at = close.end() if close else len(text)
                waiting = []
                i = at
                continue
        if not m:
            return
        at, mark = m.start(), m.group()
        i = m.end()
        if lang == "sh" and mark == "#" and at and not text[at - 1].isspace():
            continue
        if mark in ("//", "#") or mark.startswith("#"):
            if lang == "rb" and text.startswith("#{", at):
                continue
            i = _line_end(text, at)
            yield at, i, COMMENT
        elif mark == "/*":
            close = text.find("*/", at + 2)
            i = len(text) if close < 0 else close + 2
            yield at, i, COMMENT
        elif mark == "=begin":
            close = re.compile(r"^=end\b.*", re.M).search(text, at)
            i = close.end() if close else len(text)
            yield at, i, COMMENT
        elif mark == "/":
            finish = _regex_end(text, at) if _BEFORE_REGEX.search(text, max(0, at - 40), at) else None
            if finish is not None and not (lang == "rb" and text[at + 1 : at + 2] == " " and text[at - 1 : at] == " "):
                i = finish
                yield at, i, REGEX
        elif mark.startswith("<<<"):
            word = mark[3:].strip().strip("'\"")
            body = _line_end(text, at) + 1
            close = re.compile(rf"^[ \t]*{re.escape(word)}\b", re.M).search(text, body)
            i = close.end() if close else len(text)
            yield body, close.start() if close else len(text), PROSE
        elif mark.startswith("<<"):
            if at and (text[at - 1].isalnum() or text[at - 1] in ")]"):
                continue  # a shift or an append
            waiting.append(mark[2:].lstrip("~-").strip("'\""))
        elif mark.startswith("%"):
            if at and (text[at - 1].isalnum() or text[at - 1] in ")]") or len(mark) == 2 and mark[1] in "/|!<" and lang == "rb" and text[at - 1 : at] == " " and text[at + 2 : at + 3] == " ":
                continue
            i = _balanced(text, m.end() - 1, mark[-1])
            yield at, i, PROSE
        elif mark == "`" and lang == "js":
            i = _template_end(text, at)
            yield from _slots(text, at, i, lang, "${", TEMPLATE)
        elif mark.endswith(("'''", '"""')):
            i = _quoted(text, m.end() - 3, mark[-3:], True)
            yield at, i, PROSE
        else:
            raw = mark == "`" and lang == "go"
            close = text.find("`", i) if raw else -1
            i = (len(text) if close < 0 else close + 1) if raw else _quoted(text, m.end() - 1, mark[-1], lang in ("rb", "php", "sh"))
            if lang == "py" and "f" in mark[:-1].lower():
                yield from _slots(text, at, i, lang, "{", STRING)
            elif lang == "rb" and mark == '"':
                yield from _slots(text, at, i, lang, "#{", STRING)
            else:
                yield at, i, STRING


def scan(text: str, lang: str) -> list[Span]:
    return sorted(s for s in _scan(text, 0, len(text), lang) if s[1] > s[0])


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join((*out, text[at:]))


def mask_prose(text: str, lang: str) -> str:
    """Without comments, prose and regular expressions; strings stay, since package and host names stand in them."""
    return _blank(text, [(a, b) for a, b, k in scan(text, lang) if k in (COMMENT, PROSE, REGEX)])


def mask_code(text: str, lang: str) -> str:
    """Code alone: what strings hold goes too, slots in them stay; quotes stay."""
    spans = []
    for a, b, k in scan(text, lang):
        if k in (STRING, TEMPLATE) and b - a > 1:
            a, b = a + (text[a] in "'\"`"), b - (text[b - 1] in "'\"`")
        spans.append((a, b))
    return _blank(text, spans)


def kinds(text: str, lang: str = "js") -> list[str]:
    """The kind of each character."""
    out = [CODE] * len(text)
    for a, b, k in scan(text, lang):
        out[a:b] = [k] * (b - a)
    return out
