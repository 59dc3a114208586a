"""Lexers and rewrites: positives, look-alikes, idempotence."""

import difflib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.functions import lexer as X
from faultline.functions import rewrite as W


@pytest.mark.parametrize(
    "lang,text,kept,gone",
    [
        ("js", 'import a from "pkg"; // pkg2\n/* pkg3 */ x = `t ${y} z`;', ["pkg", "${y}"], ["pkg2", "pkg3"]),
        ("js", "x = a / b / c; y = /re'gex/g; z = 'str'", ["a / b / c", "'str'"], ["re'gex"]),
        ("js", "return /[/'\"]/.test(s) && q", ["q"], ["'\""]),
        ("py", '"""import stripe"""\nimport real  # no\nx = "host"', ["import real", "host"], ["import stripe", "no"]),
        ("rb", "=begin\nrequire 'a'\n=end\nx = <<~EOS\nrequire 'b'\nEOS\nrequire 'c' # d\ny = %w[e f]\nz = x / 2", ["require 'c'", "z = x / 2"], ["'a'", "'b'", "# d", "e f"]),
        ("php", "$x = <<<EOT\nuse A\\B;\nEOT;\nuse C\\D; # e\n// f\n", ["use C\\D"], ["use A", "# e", "// f"]),
        ("go", 'import "github.com/x/y" // c\nvar s = `raw // kept`\n/* d */', ["github.com/x/y", "raw // kept"], ["// c", "/* d"]),
        ("sh", "export A_KEY=1 # note\necho a#b", ["A_KEY=1", "a#b"], ["note"]),
    ],
)
def test_prose_masks(lang, text, kept, gone):
    masked = X.mask_prose(text, lang)
    assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert all(k in masked for k in kept) and not any(g in masked for g in gone), masked


def test_code_masks():
    assert "inner" in X.mask_code("f(`a ${inner(`b ${deep}`)} c`)", "js") and " a " not in X.mask_code("f(` a ${inner}`)", "js")
    assert "name" in X.mask_code('f"hello {name}!"', "py") and "hello" not in X.mask_code('f"hello {name}!"', "py")
    assert "call" in X.mask_code('"x #{call(1)} y"', "rb") and "x " not in X.mask_code('"x #{call(1)} y"', "rb")


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(set(X.LANGUAGE.values()))), st.text(alphabet="ab/*'\"`$#{}<%=\n \\()[]EOS", max_size=60))
def test_masks_keep_length_and_lines(lang, text):
    for masked in (X.mask_prose(text, lang), X.mask_code(text, lang)):
        assert len(masked) == len(text) and all((a == "\n") == (b == "\n") for a, b in zip(text, masked))
    assert len(X.kinds(text, lang)) == len(text)


def test_calls():
    text = 'a.b(x, f(1, 2), "s, )"); // a.b(no)\nc = "a.b(no)"; a.b  ({k: [1, 2]}, `t${q(1)}`)'
    found = W.calls(text, r"a\.b")
    assert [W.arguments(text, c) for c in found] == [["x", "f(1, 2)", '"s, )"'], ["{k: [1, 2]}", "`t${q(1)}`"]]
    assert W.calls("xa.b(1)", r"a\.b") == [] and W.calls("a.b(1", r"a\.b") == []
    assert W.rename_call(text, r"a\.b", "z.y").count("z.y") == 2


def test_rewrites_are_idempotent():
    cases = [
        (lambda t: W.rename_identifier(t, "Old", "New"), 'Old(1); x.Old; "Old"; // Old\nOldest', 'New(1); x.Old; "Old"; // Old\nOldest'),
        (lambda t: W.remove_destructured(t, "gone"), "const { a, gone } = x;\nf(a)\n", "const { a } = x;\nf(a)\n"),
        (lambda t: W.remove_destructured(t, "gone"), "const { gone } = x.y;\nf(a)\n", "f(a)\n"),
        (lambda t: W.remove_destructured(t, "gone"), "const { gone } = x;\nf(gone)\n", "const { gone } = x;\nf(gone)\n"),
        (lambda t: W.remove_selection(t, "last"), "{\n  a\n  last(first: 1) {\n    b { c }\n  }\n  d\n}", "{\n  a\n  d\n}"),
        (lambda t: W.named_arguments(t, r"api\.get", ["id", "verbose"]), "api.get(id, null, opts); api.get({ id }); api.get(1, true)", "api.get({ id }, opts); api.get({ id }); api.get({ id: 1, verbose: true })"),
        (lambda t: W.merge_import(t, "m", "Old", "New"), "import { Old, New, Z } from 'm'", "import { New, Z } from 'm'"),
        (lambda t: W.codes_to_classes(t, "sdk", {"Rate": "RateError"}, "ErrorCode"), "import { ErrorCode } from 'sdk'\nif (e.code === ErrorCode.Rate) {}", "import { ErrorCode, RateError } from 'sdk'\nif (e instanceof RateError) {}"),
        (lambda t: W.remove_lines(t, lambda x: "p.gone" in x), "a\nlog(p.gone)\nif (p.gone) {\n}\n", "a\nif (p.gone) {\n}\n"),
    ]
    for f, text, want in cases:
        assert f(text) == want
        assert f(want) == want


def _apply(old, patch):
    lines, out, at = old.split("\n"), [], 0
    for hunk in re.split(r"(?m)^@@ ", patch)[1:]:
        head, *body = hunk.rstrip("\n").split("\n")
        start, n = map(int, re.match(r"-(\d+),(\d+)", head).groups())
        start = start - 1 if n else start
        out += lines[at:start]
        at = start
        for x in body:
            if x[0] == " ":
                assert lines[at] == x[1:]
            if x[0] in " -":
                at += 1
            if x[0] in " +":
                out.append(x[1:])
    return "\n".join(out + lines[at:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25))
def test_diff_applies_and_is_minimal(a, b):
    old, new = "\n".join(a), "\n".join(b)
    patch = W.unified_diff("f", old, new)
    assert (_apply(old, patch) if patch else old) == new
    script = W.edit_script(a, b)
    same = sum(op == " " for op, _ in script)
    assert same >= sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_deletion_comes_first():
    assert [op for op, _ in W.edit_script(["x"], ["y"])] == ["-", "+"]
