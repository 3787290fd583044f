"""Scripts, modules and pages against plain folds, and the rules on code that should and should not be hit."""

import random
import time

import pytest

from codeloom.sources import modules, pages, scripts

FILES = "project_id string, path string, text string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def files_of(spark, texts, end):
    return spark.createDataFrame([("p", f"{i:03d}{end}", t) for i, t in enumerate(texts)], FILES)


# ---- scripts


def template(rng, depth):
    """A template with others in its substitutions."""
    parts = []
    for _ in range(rng.randrange(4)):
        kind = rng.randrange(5)
        parts.append(["words ' \" // { } ", "\\` \\${ ", "$ $$ ", "\n"][kind] if kind < 4 else "${" + substitution(rng, depth) + "}")
    return "`" + "".join(parts) + "`"


def substitution(rng, depth):
    parts = ["a.b", "{ x: '}' }", '"`"', "/* ` } */", "(1)", "// }`\n"]
    return " ".join(template(rng, depth - 1) if depth and rng.random() < 0.6 else rng.choice(parts) for _ in range(rng.randrange(1, 4)))


def script(rng):
    """A text and its tokens as (shape, token)."""
    known = [("name", "i", "name"), ("$x1", "i", "$x1"), ("'it\\'s `'", '"', None), ('"//"', '"', None), ("12.5e3", "0", None), ("é1", "i", None), ("===", "===", None), ("=>", "=>", None), ("...", "...", None), (";", ";", None), ("(", "(", None), (")", ")", None)]
    text, tokens = "", []
    for _ in range(rng.randrange(30)):
        kind = rng.randrange(10)
        if kind == 0:
            text += rng.choice([" // c ' ` /\n", " /* \n ' ` */ ", "\n", "\t"])
            continue
        if kind == 1:
            t = template(rng, 5)
            text, tokens = text + " " + t + " ", [*tokens, ("`", "`")]
            continue
        if kind == 2:
            text, tokens = text + " return /[/'`]\\/x/gi ", [*tokens, ("i", "return"), ("/re/", "/")]
            continue
        if kind == 3:
            text, tokens = text + " b / c ", [*tokens, ("i", "b"), ("/", "/"), ("i", "c")]
            continue
        t, shape, token = rng.choice(known)
        text, tokens = text + " " + t + " ", [*tokens, (shape, token or t)]
    return text, tokens


def test_scanner_on_random_scripts_with_templates_in_templates():
    rng = random.Random(11)
    for _ in range(400):
        text, tokens = script(rng)
        found = list(scripts.scanned(text))
        assert [f[1:] for f in found] == tokens, text
        if found:
            marked = list(scripts.scanned(text + "\nlast"))
            assert marked[-1] == (text.count("\n") + 2, "i", "last")


def test_scanner_is_linear_in_one_line_of_a_megabyte():
    began = time.time()
    assert sum(1 for _ in scripts.scanned("a[i]+'x';" * 120_000)) == 120_000 * 7
    for odd in ("`${" * 300_000, "{" * 1_000_000, "'" * 999_999, "/* " + "x" * 1_000_000, "`" + "${'}'}" * 160_000, "/" * 3 + "\n/[" * 300_000):
        assert list(scripts.scanned(odd)) is not None
    assert time.time() - began < 30


def test_ends_that_never_come():
    assert [f[1:] for f in scripts.scanned("'abc\nx")] == [('"', "'abc"), ("i", "x")]
    assert [f[1:] for f in scripts.scanned("a /* b")] == [("i", "a")]
    assert [f[1:] for f in scripts.scanned("a `b ${c")] == [("i", "a"), ("`", "`")]
    assert list(scripts.scanned("")) == []


def test_depth_and_partner_by_a_stack(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("()[]{}ab;") + " " for _ in range(rng.randrange(12))) for _ in range(150)]
    for _ in range(40):  # balanced ones
        t = ["a"]
        for _ in range(rng.randrange(9)):
            k, (o, c) = rng.randrange(len(t) + 1), rng.choice(["()", "[]", "{}"])
            t = [*t[:k], o, *(["b"] if rng.random() < 0.5 else []), c, *t[k:]] if rng.random() < 0.5 else [o, *t, c]
        texts.append(" ".join(t))
    tokens = scripts.script_tokens(files_of(spark, texts, ".js"))
    got = {}
    for r in tokens.orderBy("path", "at").collect():
        got.setdefault(int(r["path"][:-3]), []).append((r["at"], r["depth"], r["partner"], r["around"], r["balanced"]))
    pairs = {"(": ")", "[": "]", "{": "}"}
    for i, text in enumerate(texts):
        stack, want, ok = [], {}, True
        for at, t in enumerate(text.split(), 1):
            if t in pairs:
                want[at] = [len(stack), None, stack[-1][0] if stack else None]
                stack.append((at, t))
            elif t in pairs.values():
                if not stack or pairs[stack[-1][1]] != t:
                    ok = False
                    break
                o, _ = stack.pop()
                want[at] = [len(stack), o, stack[-1][0] if stack else None]
                want[o][1] = at
            else:
                want[at] = [len(stack), None, stack[-1][0] if stack else None]
        ok = ok and not stack
        assert {g[4] for g in got.get(i, [])} <= {ok}, text
        if ok:
            assert got.get(i, []) == [(at, *w, True) for at, w in sorted(want.items())], text


SCRIPT_HITS = [
    ("for (let i = 0; i <= a.length; i++) {\n" + "f(1);\n" * 30 + "use(a[i]); }", [("JS_INDEX_PAST_END", 1, 32)]),
    ("for (let i = 0; i <= this.items.length; i += 1) use(this.items[i]);", [("JS_INDEX_PAST_END", 1, 1)]),
    ("for (i = 0; i <= a.length; ++i) { x(b[i]); } a[i];", []),
    ("for (let i = 0; i <= a.length; i++) { if (a[i] === undefined) break; }", []),
    ("for (let i = 0; i <= a.length; i++) { if (i < a.length) f(a[i]); }", []),
    ("for (let i = 0; i <= a.length; i++) { f(b.a[i], a.length2, a[i + 1]); }", []),
    ("for (let i = 0; i < a.length; i++) f(a[i]);", []),
    ("for (const i of a) f(a[i]);", []),
    ("x.for (let i = 0; i <= a.length; i++) { f(a[i]); }", []),
    ("for (let i = 0; i <= a.length; i++) { `${a[i]}` }", []),  # a template's content is no code here
    ("for (let i = 0; i <= a.length; i++) { f(a[i]); ", []),  # brackets that do not pair up
    ("if (x = 5) {} if (a.b = -1) {} if (x = null) {} if (x == 5) {} if (x = f(1)) {} if (x <= 5) {} if ((x = 5)) {} if (x += 1) {} if (x = y) {}", [("JS_ASSIGN_IN_CONDITION", 1, 1)] * 3),
    ("a === NaN; NaN != b; x.NaN == 1; Number.NaN === 2; 'NaN == 3'; // NaN == 4\n`NaN == 5`; a = NaN; isNaN(a) == NaN2", [("JS_NAN_COMPARE", 1, 1)] * 3),
    ("NaN == 1;\n" * 9, [("JS_NAN_COMPARE", k, k) for k in range(1, 6)]),
]


def test_rules_on_scripts(spark):
    got = rows(scripts.script_hits(scripts.script_tokens(files_of(spark, [t for t, _ in SCRIPT_HITS], ".js"))), "path", "rule", "line", "end")
    assert got == sorted([(f"{i:03d}.js", *h) for i, (_, hits) in enumerate(SCRIPT_HITS) for h in hits], key=repr)
    assert scripts.script_hits(scripts.script_tokens(files_of(spark, [SCRIPT_HITS[0][0]], ".jsx"))).count() == 0
    none = spark.createDataFrame([("p", "a.js", None)], FILES)
    assert scripts.script_hits(scripts.script_tokens(none)).count() == 0


def test_declarations_of_scripts(spark):
    text = """export function f(a) { function inner() {} }
async function g() {} export default class K extends B { m(a) { if (a) { n(); } } async n() { return 1 } get x() { return 2 } }
const h = (a, b) => a, i = 3; export const j = async x => { }; let k = function (a) { };
export { g, h as other }; o.function = 1; `function no() {}`; // function no() {}
import d from "./a"; import "./b"; export * from './c'; const r = require('fs'); import('./e'); x.require('no');"""
    tokens = scripts.script_tokens(files_of(spark, [text], ".js"))
    assert rows(scripts.script_functions(tokens), "name", "kind", "line", "exported") == sorted([
        ("f", "function", 1, True), ("inner", "function", 1, False), ("g", "async_function", 2, True), ("K", "class", 2, True), ("K.m", "method", 2, False), ("K.n", "async_method", 2, False),
        ("K.x", "method", 2, False), ("h", "arrow", 3, True), ("j", "async_arrow", 3, True), ("k", "function", 3, False),
    ], key=repr)
    assert rows(scripts.script_refs(tokens), "kind", "specifier", "line") == [("dynamic_import", "./e", 5), ("import", "./a", 5), ("import", "./b", 5), ("import", "./c", 5), ("require", "fs", 5)]


# ---- modules

LOOP = "def f(x, y):\n    for i in range({0}):\n        {1}\n"
MODULE_HITS = [
    (LOOP.format("len(x) + 1", "print(x[i])"), [("PY_INDEX_PAST_END", 2, 3)]),
    (LOOP.format("0, 2 + len(x)", "print(x[i])"), [("PY_INDEX_PAST_END", 2, 3)]),
    (LOOP.format("len(self.x) + 1", "print(self.x[i])"), [("PY_INDEX_PAST_END", 2, 3)]),
    (LOOP.format("len(x) + 0", "print(x[i])"), []),
    (LOOP.format("len(x) + 1", "print(y[i])"), []),
    (LOOP.format("y, len(x) + 1", "print(x[i])"), []),
    (LOOP.format("len(x) + 1", "x.append(x[i])"), []),
    (LOOP.format("len(x) + 1", "x.discard(x[i])"), []),
    (LOOP.format("len(x) + 1", "x.sort(); print(x[i])"), [("PY_INDEX_PAST_END", 2, 3)]),  # the length stays
    (LOOP.format("len(x) + 1", "del x[0]; print(x[i])"), []),
    (LOOP.format("len(x) + 1", "x = x[i]"), []),
    (LOOP.format("len(x) + 1", "print(x[i]) if i < len(x) else 0"), []),
    (LOOP.format("len(x) + 1", "g = lambda: x.pop(); print(x[i])"), [("PY_INDEX_PAST_END", 2, 3)]),  # an inner scope changes nothing here
    (LOOP.format("len(x) + 1", "g = lambda: x[i]"), []),
    ("def f(x):\n    try:\n        for i in range(len(x) + 1):\n            x[i]\n    except (ValueError, IndexError):\n        pass\n", []),
    ("def f(x):\n    try:\n        for i in range(len(x) + 1):\n            x[i]\n    except:\n        pass\n", []),
    ("def f(x):\n    try:\n        for i in range(len(x) + 1):\n            x[i]\n    except ValueError:\n        pass\n", [("PY_INDEX_PAST_END", 3, 4)]),
    ("def f(x):\n    try:\n        pass\n    except IndexError:\n        for i in range(len(x) + 1):\n            x[i]\n", [("PY_INDEX_PAST_END", 5, 6)]),
    ("len = 3\n" + LOOP.format("len(x) + 1", "print(x[i])"), []),
    (LOOP.format("1, len(x)", "print(x[i])"), [("PY_SKIPS_FIRST_ITEM", 2, 3)]),
    (LOOP.format("1, len(x)", "print(x[i], y[i - 1])"), []),
    (LOOP.format("1, len(x)", "y[i] = x[i]"), []),
    (LOOP.format("1, len(x)", "x[i] = x[i] * 2"), [("PY_SKIPS_FIRST_ITEM", 2, 3)]),
    (LOOP.format("2, len(x)", "print(x[i])"), []),
    (LOOP.format("1, len(x)", "print(x[i])") + "    print(x[0])\n", []),
    (LOOP.format("1, len(x)", "print(x[i])") + "    print(x[:2], 1)\n", []),
    (LOOP.format("1, len(x)", "print(x[i])") + "    print(x[1:])\n", [("PY_SKIPS_FIRST_ITEM", 2, 3)]),
    (LOOP.format("1, len(x)", "print(x[i])") + "    print(max(y, x))\n", []),
    (LOOP.format("1, len(x)", "print(x[i])") + "    return lambda: x[0]\n", [("PY_SKIPS_FIRST_ITEM", 2, 3)]),
    ("a is 'x'\nb is not -1\nc is None\nd is True\n1.5 is e is f\ng == 'x'\nh is b'' is 3\n", [("PY_IS_LITERAL", k, k) for k in (1, 2, 5, 7)]),
    ("x is 1\n" * 7, [("PY_IS_LITERAL", k, k) for k in range(1, 6)]),
    ("def f(a, b=[], *, c={}):\n    b.append(a)\n    c.update(a)\n", [("PY_MUTABLE_DEFAULT", 1, 2), ("PY_MUTABLE_DEFAULT", 1, 3)]),
    ("def f(a, /, b=list(), c=1):\n    b += [a]\n", [("PY_MUTABLE_DEFAULT", 1, 2)]),
    ("def f(b=[]):\n    b = b or []\n    b.append(1)\n", []),
    ("def f(b=[]):\n    if 1 in b:\n        b.append(1)\n", []),
    ("def f(b={}):\n    b.update(b.get(1))\n", []),
    ("def f(b=[]):\n    b.append(b[0])\n", []),
    ("def f(b={}):\n    b[1] = 2\n", []),
    ("def f(b=[]):\n    def g():\n        b.append(1)\n    return g\n", []),
    ("def f(b=[]):\n    def g(b):\n        b = 1\n    b.append(1)\n", [("PY_MUTABLE_DEFAULT", 1, 4)]),
    ("def f(b=list(x)):\n    b.append(1)\n", []),
    ("def list(): pass\ndef f(b=list()):\n    b.append(1)\n", []),
    ("def f(:\n", [("PY_SYNTAX_ERROR", 1, 1)]),
    ("", []),
]


def test_rules_on_modules(spark):
    nodes = modules.module_nodes(files_of(spark, [t for t, _ in MODULE_HITS], ".py"))
    got = rows(modules.module_hits(nodes), "path", "rule", "line", "end")
    want = sorted([(f"{i:03d}.py", *h) for i, (_, hits) in enumerate(MODULE_HITS) for h in hits], key=repr)
    for i, (text, hits) in enumerate(MODULE_HITS):
        assert [g[1:] for g in got if g[0] == f"{i:03d}.py"] == hits, text
    assert got == want


def test_symbols_guards_and_imports_of_modules(spark):
    text = """import a.b as c, d
from . import e
from .f import g as h, i
X = Y = 1
x, z = 1, 2
T: int
if X:
    @deco
    def one():
        def inner(): pass
        V = 1
    class A:
        W = 1
        async def two(self): pass
        class B:
            def three(self): pass
    if "__main__" == __name__:
        one()
try:
    pass
except E:
    async def four(): pass
"""
    nodes = modules.module_nodes(files_of(spark, [text, None], ".py"))
    assert rows(modules.module_symbols(nodes), "name", "kind", "start", "end") == sorted([
        ("X", "variable", 4, 4), ("Y", "variable", 4, 4), ("T", "variable", 6, 6), ("one", "function", 8, 11), ("A", "class", 12, 16), ("A.two", "async_method", 14, 14), ("A.B", "class", 15, 16),
        ("A.B.three", "method", 16, 16), ("__main__", "guard", 17, 18), ("four", "async_function", 22, 22),
    ], key=repr)
    assert rows(modules.module_refs(nodes), "specifier", "line", "names", "level") == sorted([("a.b", 1, [], 0), ("d", 1, [], 0), ("", 2, ["e"], 1), ("f", 3, ["g", "i"], 1)], key=repr)


def test_module_that_is_too_deep_says_nothing(spark):
    nodes = modules.module_nodes(files_of(spark, ["(" * 5000 + ")" * 5000, "x" + ".a" * 300 + "\n", "-" * 900 + "1\n"], ".py"))
    assert modules.module_hits(nodes).where("rule <> 'PY_SYNTAX_ERROR'").count() == 0


# ---- pages


def test_pages(spark):
    text = """<html><head><title> A  <b>page</b>
 </title><link rel="stylesheet preload" href=" a.css ">
<!-- <script src="no.js"></script> --><script src='m.js' type=module></script>
<script>if (a < b) document.write("<img src=no.png>");</script><style>a > b { }</style>
<script type="application/json">{}</script><SCRIPT TYPE=text/javascript></SCRIPT>
<link rel=modulepreload href=p.js><link rel=icon href=i.ico><link href=none><img alt="src=x.png" src=y.png id="one">
<input type=IMAGE src=b.png><input type=text src=no><div id=' two ' id=three></div><p id=""><img src=""><a href=no>
<img title='a > b'
 src="z.png"><script src=""></script><title>second</title>"""
    got = {r["path"]: r for r in pages.parse_pages(files_of(spark, [text, None, "", "no tags < here", "<script>never closed <style>"], ".html")).collect()}
    r = got["000.html"]
    assert (r["title"], r["inline_scripts"], r["inline_styles"], r["ids"]) == ("A <b>page</b>", 2, 1, ["one", "two"])
    assert [(x["kind"], x["specifier"], x["line"]) for x in r["refs"]] == [
        ("stylesheet", "a.css", 2), ("script", "m.js", 3), ("script", "p.js", 6), ("asset", "i.ico", 6), ("asset", "y.png", 6), ("asset", "b.png", 7), ("asset", "z.png", 8),
    ]
    assert [(got[f"{i:03d}.html"]["inline_scripts"], got[f"{i:03d}.html"]["title"], got[f"{i:03d}.html"]["refs"]) for i in (1, 2, 3, 4)] == [(0, None, [])] * 3 + [(1, None, [])]


def test_pages_of_great_length(spark):
    long = "<p " + "a" * 200_000 + "='" + "x" * 200_000 + "'>" + "<b>" * 50_000 + "<!--" + "-" * 300_000
    assert pages.page_tags(files_of(spark, [long], ".html")).count() == 50_001


if __name__ == "__main__":
    pytest.main([__file__])
