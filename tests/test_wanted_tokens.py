"""of a script's tokens only those leave the worker that a query asks for, with the results of all tokens."""

import random

import numpy as np
from pyspark.sql import functions as F
from tests.test_sources import FILES, SCRIPT_HITS, rows, script

from codeloom.plans import sources
from codeloom.sources import scripts

BITS = ["(", ")", "{", "}", ";", " a ", "\n", "// c\n", "x.length ", " => ", " = ", "const f", " return ", "[i]", ".b", " if (", " for (", " class A {", "async ", "export {", ",", " function g(", " undefined ", "this.", " m(a) {", " NaN == 1;", "let h = async (a) => {", "/x/", "/", "`${`"]


def odd_files(spark, n=250):
    rng = random.Random(6)
    texts = [t for t, _ in SCRIPT_HITS] + [None, ""] + [script(rng)[0] for _ in range(40)]
    texts += ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(n)]
    whole = ["class A { m(a) { return a[i]; } }", "export { a, f };", "for (let i = 0; i <= this.a.length; i++) { f(this.a[i]); }", "if (a = 1) { }", "const f = async (a) => { b(); };", "{ c; }", "x.length[i];"]
    texts += [" ".join(rng.choice(whole) for _ in range(rng.randrange(5))) for _ in range(60)]
    return spark.createDataFrame([("p", f"{i:03d}.js", t) for i, t in enumerate(texts)], FILES)


def test_wanted_tokens_say_what_all_tokens_say(spark):
    files = odd_files(spark)
    every = scripts.script_tokens(files)
    for wanted, asked, columns in ((scripts.of_declarations, scripts.script_functions, ("path", "name", "kind", "line", "exported")), (scripts.of_rules, scripts.script_hits, ("path", "rule", "line", "end"))):
        some = scripts.script_tokens(files, wanted)
        assert some.count() < every.count()
        found = rows(asked(every), *columns)
        assert len(found) > 40 and rows(asked(some), *columns) == found


def test_few_tokens_of_long_scripts_are_written(spark, tmp_path):
    spark.range(1, 181).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    files = sources.long_scripts(spark, str(tmp_path))
    every = scripts.token_rows(files).count()
    for wanted in (scripts.of_declarations, scripts.of_rules):
        assert scripts.token_rows(files, wanted).count() < every / 15


def test_sums_of_brackets_are_those_of_the_tokens(spark):
    files = odd_files(spark)
    t = scripts.script_tokens(files).groupBy("path").agg(F.count("*").alias("tokens"), F.max("depth").alias("deepest"), F.bool_and("balanced").alias("balanced"), F.count_if(F.col("shape") == "`").alias("templates"), F.count_if(F.col("shape") == "/re/").alias("patterns"))
    columns = ("path", "tokens", "deepest", "balanced", "templates", "patterns")
    assert rows(scripts.bracket_rows(files), *columns) == rows(t, *columns)


def test_files_are_placed_together_as_each_alone():
    rng = random.Random(2)
    texts = [""] + ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(400)] + ["", ")" * 50, "(" * 50]
    together = scripts.Placed([scripts.cut(t) for t in texts])
    for i, text in enumerate(texts):
        alone, own = scripts.Placed([scripts.cut(text)]), slice(together.begin[i], together.begin[i] + together.count[i])
        for column in ("at", "line", "depth", "around", "partner", "after"):
            assert np.array_equal(getattr(together, column)[own], getattr(alone, column)), (column, text)
        assert together.balanced[i] == alone.balanced[0]
        assert [(line, together.shapes[k], together.tokens[k]) for line, k in zip(together.line[own].tolist(), together.kind[own].tolist(), strict=True)] == list(scripts.scanned(text))
