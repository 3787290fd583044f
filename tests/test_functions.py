import posixpath
import random
import re
import unicodedata
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.functions import prose as P
from codeloom.functions import text as T


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


#: Costs by hand: two and a half letters a token up to twelve, 0.6 for each letter beyond; 1 for digits, signs and line breaks; 2 for a
#: blank with the digit behind it, else 0.15 for a run of blanks; 1.25 beyond ASCII, 2 beyond the first plane; 1 for each character of a dense run.
COSTS = {
    "": 0, "a": 1, "ab": 1, "abc": 2, "abcde": 2, "abcdef": 3, "a" * 12: 5, "a" * 13: 8, "7": 1, "77": 2, "a 7": 3, "a\t7": 3, "a  7": 3, "a b": 3, "\n\n": 2, "+-": 2, "é": 2, "éé": 3,
    "éééé": 5, "😀": 2, "😀😀": 4, "abcdefgh12345678": 16, "abcdefgh1234567": 11, "x=abcdefgh12345678": 18, "a abcdefgh12345678 b": 19, "abcdefghijklmnopqrst": 12, "1234567890123456": 16, " " * 40: 1, "f(x): return 1\n": 12,
}


def test_token_cost_by_hand(spark):
    assert dict(zip(COSTS, column(spark, list(COSTS), T.token_cost), strict=True)) == COSTS


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abZ09 .-_é漢😀", max_size=30), min_size=10, max_size=10))
def test_token_cost_adds_up_over_lines(spark, texts):
    alone, doubled = column(spark, texts, T.token_cost), column(spark, [f"{t}\n{t}\n{t}" for t in texts], T.token_cost)
    assert all(3 * a - 1 <= d <= 3 * a + 2 for a, d in zip(alone, doubled, strict=True))


def test_paths(spark):
    paths = ["a/./b/../c", "../x", "./", "a/b/../../../c", "", "a//b", "a/..", "../../a/../b"]
    assert column(spark, paths, T.normal_path) == [posixpath.normpath(p) for p in paths]
    names = ["a/b.PY", ".bashrc", "a.tar.gz", "dir.x/file", "..py", "x."]
    assert column(spark, names, T.extension) == [posixpath.splitext(p)[1].lower() for p in names]


def test_safe_path(spark):
    bad = ["", "/a", "C:x", "a:b", "a/../b", "a//b", "./a", "a /b", "a./b", "a\tb", "x" * 241, "/".join("a" * 33), "a​b"]
    assert column(spark, bad, T.safe_path) == [None] * len(bad)
    assert column(spark, ["a\\b.py", "d/"], T.safe_path) == ["a/b.py", "d"]


def test_uuid5(spark):
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    names = ["a", "p:src/é.py", "", "x" * 300]
    assert column(spark, names, lambda c: T.uuid5(str(space), c)) == [str(uuid.uuid5(space, n)) for n in names]


def test_decode_verdict(spark):
    data = [bytearray(b"ok\n"), bytearray(b"a\0b"), bytearray(b"\x01\x02\x03abc"), bytearray(b"\xff\xfe"), bytearray("é".encode())]
    assert column(spark, data, T.decode_verdict, "binary") == [None, "binary_content", "binary_content", "invalid_encoding", None]


def test_caseless_keys_are_those_of_composed_case_folding(spark):
    pairs = [("straße", "STRASSE"), ("ß", "ss"), ("İ", "i\u0307"), ("I", "ı"), ("é", "e\u0301"), ("É", "e\u0301"), ("Σ", "ς"), ("ﬁ", "fi"), ("K", "k"), ("a", "á"), ("a b", "ab"), ("a.py", "A.PY"), ("a-b", "ab"), ("ſ", "s"), ("", " ")]
    fold = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold())
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(T.caseless(F.col("a")) == T.caseless(F.col("b"))).collect()] == [fold(a) == fold(b) for a, b in pairs]
    assert spark.createDataFrame([("A",), ("a",), ("Á",), ("á",)], "p string").groupBy(T.caseless(F.col("p"))).count().count() == 2


def test_unexplained_words_by_every_place(spark):
    rng = random.Random(8)
    bits = ["index", "indexes", "Array", "list", "(", " - ", ": ", ", which", ", a ", ", b", " means", " is a", " is an", " is like", " are", " area", '"', ")", " ", "x", ". ", "\u2014"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(900)]
    marks = re.compile(r"^[\s\"'`)]*(\(|\u2014|-|:|,\s*(which|a|an|the)\b|\s*(means|is a|is an|is like|are)\b)")
    want = [sum(not marks.match(t.lower()[m.end() : m.end() + 40]) for w in P.JARGON for m in re.finditer(rf"\b{w}\b", t.lower())) for t in texts]
    assert column(spark, texts, lambda c: P.unexplained(c, P.JARGON)) == want and sum(want) > 50
