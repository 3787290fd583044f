"""Tiers of candidates on one small project, by hand."""

import pytest

from codeloom.operators import context


@pytest.fixture(scope="module")
def project(spark):
    text = {
        "a.py": "import b, c\nX = 1\ndef one():\n    return b.two() + c.many3\ndef other():\n    pass\nclass K:\n    def one(self):\n        pass\n",
        "b.py": "def two():\n    pass\ndef unused():\n    pass\n",
        "c.py": "".join(f"def many{i}():\n    pass\n" for i in range(20)),
        "d.py": "import a\ndef user():\n    def inner():\n        return one\n    return inner\n",
        "e.py": "import a\n",
        "f.py": "",
    }
    files = spark.createDataFrame([("p", path, t) for path, t in text.items()], "project_id string, path string, text string")
    counts = spark.createDataFrame([("p", path, t.count("\n")) for path, t in text.items()], "project_id string, path string, line_count int")
    rows = [("a.py", "X", "X", "variable", 2, 2, None), ("a.py", "one", "one", "function", 3, 4, None), ("a.py", "other", "other", "function", 5, 6, None), ("a.py", "K", "K", "class", 7, 9, None), ("a.py", "one", "K.one", "method", 8, 9, "K")]
    rows += [("b.py", "two", "two", "function", 1, 2, None), ("b.py", "unused", "unused", "function", 3, 4, None), ("d.py", "user", "user", "function", 2, 5, None), ("d.py", "inner", "inner", "function", 3, 4, None)]
    rows += [("c.py", f"many{i}", f"many{i}", "function", 2 * i + 1, 2 * i + 2, None) for i in range(20)]
    symbols = spark.createDataFrame([("p", *r) for r in rows], "project_id string, path string, name string, qualified string, kind string, start int, end int, parent string")
    edges = spark.createDataFrame([("p", s, t) for s, t in [("a.py", "b.py"), ("a.py", "c.py"), ("d.py", "a.py"), ("e.py", "a.py")]], "project_id string, source string, target string")
    entries = spark.createDataFrame([("p", "d.py", "main_guard"), ("p", "a.py", "main_guard")], "project_id string, path string, reason string")

    def ask(path, intent, symbol=None, more=()):
        requests = spark.createDataFrame([(1, "p", path, intent, symbol), *more], "request_id long, project_id string, path string, intent string, symbol string")
        found = context.focused_candidates(requests, counts, symbols, context.words_of(files), edges, entries)
        return [(r["step"], r["kind"], r["path"], r["start"], r["end"], r["tier"]) for r in found.where("request_id = 1").orderBy("step", "place", "path", "start").collect()]

    return ask


def test_a_file_to_debug(project):
    assert project("a.py", "debug") == [
        (0, "code", "a.py", 1, 9, 0), (2, "code", "b.py", 1, 2, 1), (2, "code", "c.py", 7, 8, 1), (3, "outline", "b.py", 0, 0, 3), (3, "outline", "c.py", 0, 0, 3), (4, "code", "d.py", 3, 4, 2), (4, "outline", "e.py", 0, 0, 2),
        (5, "outline", "d.py", 0, 0, 3), (8, "outline", "f.py", 0, 0, 4),
    ]


def test_a_symbol_to_debug_and_to_explain(project):
    assert project("a.py", "debug", "one")[:3] == [(0, "code", "a.py", 3, 4, 0), (1, "code", "a.py", 1, 1, 1), (2, "code", "b.py", 1, 2, 1)]  # the qualified name wins over K.one
    assert [c for c in project("a.py", "debug", "K.one") if c[0] in (0, 7)] == [(0, "code", "a.py", 8, 9, 0)]  # no sibling of its own parent
    assert [c for c in project("a.py", "debug", "other") if c[0] in (6, 7)] == [(6, "outline", "a.py", 0, 0, 3), (7, "code", "a.py", 3, 4, 4), (7, "code", "a.py", 7, 9, 4)]
    assert [c for c in project("a.py", "explain", "other") if c[0] in (2, 3, 4, 7)] == [(2, "outline", "b.py", 0, 0, 1), (2, "outline", "c.py", 0, 0, 1), (4, "outline", "d.py", 0, 0, 2), (4, "outline", "e.py", 0, 0, 2)]


def test_what_is_not_there_has_no_candidates(project):
    assert project("a.py", "debug", "gone") == [] and project("gone.py", "explain") == []
    assert project("f.py", "explain", more=[(2, "p", "a.py", "debug", None)]) == []  # an empty file has no lines
