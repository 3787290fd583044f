"""What grows with the input only as much as the input does: plans without broadcasts of made rows, few rows where many meet."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import answers, graph
from codeloom.session import ROWS_A_TASK, spread
from codeloom.sources import modules, scripts

FILES = "project_id string, path string, text string"


def sample_files(spark, end, text, n=40):
    return spark.createDataFrame([("p", f"{i:03d}{end}", text) for i in range(n)], FILES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_scanned_in_many_tasks_and_joined_without_a_broadcast(spark):
    files = sample_files(spark, ".js", "export const f = async (a) => { for (let i = 0; i <= a.length; i++) { use(a[i]); } };").coalesce(1)
    assert scripts.token_rows(files).select(F.spark_partition_id()).distinct().count() > 1
    tokens = scripts.script_tokens(files)
    for df in (scripts.script_functions(tokens), scripts.script_hits(tokens)):
        assert "Broadcast" not in plan_of(df)
        assert df.count() == 40


def test_next_semicolon_of_each_token(spark):
    tokens = scripts.script_tokens(sample_files(spark, ".js", "a; b (c; d) e", 1))
    assert [r["after"] for r in tokens.orderBy("at").collect()] == [2, 2, 6, 6, 6, 6, None, None, None]


def test_tokens_are_placed_where_they_are_scanned(spark):
    """One exchange of the files, none of their tokens; brackets that do not pair up keep their tokens' places."""
    files = sample_files(spark, ".js", "a(b; [c) d]; x", 2)
    plan = plan_of(scripts.token_rows(files))
    assert "Window" not in plan and "Sort" not in plan and plan.count("Exchange") == 1
    got = scripts.script_tokens(files.where("path = '001.js'")).orderBy("at").collect()
    assert [r["depth"] for r in got] == [0, 0, 1, 1, 1, 2, 1, 1, 0, 0, 0]
    assert [r["around"] for r in got] == [None, None, 2, 2, 2, 5, 2, 2, None, None, None]
    assert [r["partner"] for r in got] == [None, 9, None, None, 7, None, 5, None, 2, None, None]
    assert [r["after"] for r in got] == [4, 4, 4, 4, 10, 10, 10, 10, 10, 10, None]
    assert [r["p2"] for r in got] == [None, None, "i", "(", "i", ";", "[", "i", ")", "i", "]"]
    assert [r["w1"] for r in got] == ["(", "b", ";", "[", "c", ")", "d", "]", ";", "x", None]
    assert not any(r["balanced"] for r in got)


def test_nodes_are_made_in_many_tasks_and_joined_without_a_broadcast(spark):
    nodes = modules.module_nodes(sample_files(spark, ".py", "import a\nX = 1\ndef f(b=[]):\n    b.append(1)\n").coalesce(1))
    assert len({f.rsplit("/", 1)[1] for f in nodes.inputFiles()}) > 1
    for df, n in ((modules.module_symbols(nodes), 80), (modules.module_refs(nodes), 40)):
        assert "Broadcast" not in plan_of(df)
        assert df.count() == n


def test_plain_names_meet_only_their_first_symbols(spark):
    symbols = spark.range(2000).selectExpr("'f' as path", "concat('C', id, '.s') as qualified", "'s' as name", "id as start")
    wanted = spark.range(3000).selectExpr("id", "'f' as path", "'s' as name")
    found = answers.find_symbols(wanted, symbols)
    assert sorted(tuple(r) for r in found.where("id = 17").collect()) == [(17, f"C{k}.s", k, k + 1) for k in range(5)]
    assert found.count() == 15_000
    metrics = found._jdf.queryExecution().executedPlan()
    rows = [m for m in max_rows(metrics)]
    assert max(rows) <= 20_000


def test_larger_tables_are_dealt_to_more_tasks(spark):
    df = spark.range(100).withColumn("owner", F.col("id") % 7)
    assert [spread(df, n, "owner").select(F.spark_partition_id()).rdd.getNumPartitions() for n in (100, 10 * ROWS_A_TASK)] == [4, 10]


def test_hits_are_dealt_out_once(spark):
    hits = spark.createDataFrame([(1, "a", "f", "r", "problem", 3, [3, 9]), (1, "b", "f", "r", "worth", 1, [3]), (1, "b", "g", "r", "worth", 2, [3]), (1, "c", "f", "r", "worth", 4, []), (2, "a", "f", "r", "worth", 1, [5])], "request int, hit string, path string, rule string, strength string, start int, focus array<int>")
    shown = spark.createDataFrame([(1, "f", 1, 4), (1, "f", 8, 9)], "request int, path string, a int, z int")
    found = answers.checked_hits(spread(hits, 5, "request"), shown)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "P1", "a", "r", True), (1, "P2", "b", "r", False), (1, "P3", "b", "r", False), (1, "P4", "c", "r", True), (2, "P1", "a", "r", False)]
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(request") <= 3


def test_alike_references_are_resolved_once(spark, monkeypatch):
    asked, first = [], graph.first_known
    monkeypatch.setattr(graph, "first_known", lambda refs, *rest: asked.append(refs.count()) or first(refs, *rest))
    refs = spark.range(500).selectExpr("cast(id as string) as id", "'p' as project_id", "concat('d/s', id, '.js') as source", "' ./x ' as specifier")
    files = spark.createDataFrame([("p", "d/x.js", None)], "project_id string, path string, reason string")
    found = graph.resolve_scripts(refs, files)
    assert found.groupBy("specifier", "status", "target").count().collect() == [("./x", "resolved", "d/x.js", 500)]
    assert asked == [1]


def test_graph_tables_are_not_broadcast(spark):
    edges = graph.saved(spark.range(10).selectExpr("id as source", "id + 1 as target"))
    assert "Broadcast" not in plan_of(edges.join(spark.range(5).withColumnRenamed("id", "source"), "source"))


def test_declared_names_meet_only_the_tokens_behind_them(spark):
    """of 40 files with some 200 tokens each, the shuffles of the declarations have a few rows a file."""
    text = "class C { m(a) { return 1; } } const f = async (a) => a, g = b => b, h = function () { }; let k = async; " + "x(y, [z]); " * 20
    found = scripts.script_functions(scripts.script_tokens(sample_files(spark, ".js", text)))
    assert sorted({(r["name"], r["kind"]) for r in found.collect()}) == [("C", "class"), ("C.m", "method"), ("f", "async_arrow")]
    assert max(shuffled_rows(found._jdf.queryExecution().executedPlan())) <= 40 * 30


def shuffled_rows(node):
    """Rows that the exchanges of an executed plan wrote."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        node = node.plan()
    if node.nodeName() == "Exchange":
        yield node.metrics().apply("shuffleRecordsWritten").value()
    kids = node.children()
    for i in range(kids.size()):
        yield from shuffled_rows(kids.apply(i))


def max_rows(node):
    """Rows that the joins of an executed plan made."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        node = node.plan()
    if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
        yield node.metrics().apply("numOutputRows").value()
    kids = node.children()
    for i in range(kids.size()):
        yield from max_rows(kids.apply(i))


if __name__ == "__main__":
    pytest.main([__file__])
