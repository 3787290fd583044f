import io
import random
import zipfile

from pyspark.sql import functions as F

from codeloom.operators import answers, evidence, graph, packing, ranges
from codeloom.sources import archives, modules
from codeloom.streaming import sessions


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ranges(spark):
    r = spark.createDataFrame([("f", 1, 3), ("f", 4, 6), ("f", 9, 9), ("g", 2, 2)], "k string, start long, end long")
    assert rows(ranges.merged(r, "k"), "k", "start", "end") == [("f", 1, 6), ("f", 9, 9), ("g", 2, 2)]
    wanted = spark.createDataFrame([("f", 5, 12), ("h", 1, 2)], "k string, start long, end long")
    assert rows(ranges.subtracted(wanted, r, "k"), "k", "start", "end") == [("f", 7, 8), ("f", 10, 12), ("h", 1, 2)]


def test_greedy_packing_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 4), ("q", 4, 1)], "k string, ord int, cost int")
    assert rows(packing.greedy_packed(items, 9, "cost", ["ord"], "k"), "ord", "placed") == [(1, True), (2, False), (3, True), (4, False)]
    assert rows(packing.prefix_packed(items, 9, "cost", ["ord"], "k"), "ord") == [(1,)]


def test_cycles_and_distances(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "a")], "source string, target string")
    assert rows(graph.cycles(e), "component", "size") == [("a", 3), ("d", 1)]
    assert rows(graph.distances(e, "e"), "node", "hops", "via") == [("a", 1, "e"), ("b", 2, "a"), ("c", 3, "b"), ("d", 4, "c")]


def test_cycles_of_random_graphs_without_storing_paths(spark, monkeypatch):
    rng, stored, saved = random.Random(3), [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: (lambda t: stored.append(t.count()) or t)(saved(df)))
    pairs = {(12 * (i % 6) + rng.randrange(12), 12 * (i % 6) + rng.randrange(12)) for i in range(96)} | {(12 * i + rng.randrange(12), 12 * i + 12 + rng.randrange(12)) for i in range(5)} | {(100 + i, 200) for i in range(60)} | {(200, 300 + i) for i in range(60)} | {(400 + i, 400 + (i + 1) % 6) for i in range(6)}
    reach = {a: {a} for a in {x for p in pairs for x in p}}
    for _ in reach:
        for a, b in pairs:
            reach[a] |= reach[b]
    groups = {tuple(sorted(b for b in reach[a] if a in reach[b])) for a in reach}
    want = sorted((g[0], list(g), len(g)) for g in groups if len(g) > 1 or (g[0], g[0]) in pairs)
    assert len(want) > 3 and rows(graph.cycles(spark.createDataFrame(sorted(pairs), "source long, target long")), "component", "files", "size") == want
    assert max(stored) <= len(pairs)  # 60 x 60 paths lead over node 200


def test_module_resolution_order(spark):
    files = spark.createDataFrame([("p", "pkg/__init__.py", None), ("p", "pkg/sub.py", None), ("p", "src/lib.py", None), ("p", "ns/x/y.py", None)], "project_id string, path string, reason string")
    refs = [("1", "pkg.sub", [], 0), ("2", "pkg", ["sub", "f"], 0), ("3", "lib", [], 0), ("4", "ns.x", [], 0), ("5", "pkg.gone", [], 0), ("6", "", ["sub"], 1), ("7", "json", [], 0), ("8", "numpy", [], 0), ("9", "", ["z"], 5)]
    df = spark.createDataFrame([(i, "p", "pkg/app.py", s, n, lv, 1) for i, s, n, lv in refs], "id string, project_id string, source string, specifier string, names array<string>, level int, line int")
    got = rows(graph.resolve_modules(df, files, ["json"]).fillna(""), "id", "specifier", "status", "target", "external_kind")
    assert got == [
        ("1", "pkg.sub", "resolved", "pkg/sub.py", ""), ("2", "pkg", "resolved", "pkg/__init__.py", ""), ("2", "pkg.sub", "resolved", "pkg/sub.py", ""), ("3", "lib", "resolved", "src/lib.py", ""),
        ("4", "ns.x", "unresolved", "", ""), ("5", "pkg.gone", "missing", "", ""), ("6", ".", "resolved", "pkg/__init__.py", ""), ("6", ".sub", "resolved", "pkg/sub.py", ""), ("7", "json", "external", "", "stdlib"),
        ("8", "numpy", "external", "", "package"), ("9", ".....", "missing", "", ""),
    ]


def test_quotes(spark):
    df = spark.createDataFrame([("```\n 3 | total += 1\n```", "x\ntotal  +=  1\n"), ("`a`", "a"), ("other thing here", "total")], "q string, t string")
    assert [r["x"] for r in df.select(evidence.quote_found(F.col("q"), F.col("t")).alias("x")).collect()] == [False, False, False]
    df = spark.createDataFrame([("```\n 3 | total_count += 1\n```", "x\ntotal_count  +=  1\n")], "q string, t string")
    assert df.select(evidence.quote_found(F.col("q"), F.col("t")).alias("x")).first()["x"]


def test_archives(spark):
    def zipped(*names, data=b"x = 1\r\n"):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, data)
        return bytearray(out.getvalue())

    df = spark.createDataFrame([("ok", zipped("a.py", "d/b.py")), ("up", zipped("../a.py")), ("two", zipped("A.py", "a.py")), ("bomb", zipped("z", data=b"0" * 300_000)), ("no", bytearray(b"text"))], "project_id string, content binary")
    m = archives.members(df)
    assert rows(archives.verdicts(m).fillna(""), "project_id", "code") == [("bomb", "SUSPICIOUS_COMPRESSION"), ("no", "INVALID_ARCHIVE"), ("ok", ""), ("two", "DUPLICATE_PATH"), ("up", "UNSAFE_PATH")]
    keep = m.where("project_id = 'ok' and path = 'd/b.py'").select("project_id", "path")
    assert rows(archives.read_members(df, keep), "path", "text") == [("d/b.py", "x = 1\n")]


def test_rules_stay_silent_on_guarded_code(spark):
    quiet = ["def f(x):\n    for i in range(len(x) + 1):\n        if i < len(x):\n            print(x[i])\n", "def f(x):\n    try:\n        for i in range(len(x) + 1):\n            print(x[i])\n    except IndexError:\n        pass\n", "def f(a=[]):\n    a = a or []\n    a.append(1)\n", "def f(x):\n    best = x[0]\n    for i in range(1, len(x)):\n        best = max(best, x[i])\n"]
    loud = ["def f(x):\n    for i in range(1, len(x)):\n        print(x[i])\n"]
    df = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(quiet + loud)], "project_id string, path string, text string")
    assert rows(modules.module_hits(modules.module_nodes(df)), "path", "rule") == [("4", "PY_SKIPS_FIRST_ITEM")]


def test_session_stream_matches_batch(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:30:00"), (1, "2024-01-01 05:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-03 00:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = sessions.session_stream(stream).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = rows(sessions.sessions(events).where("user_id < 3"), "user_id", "uses")
    assert rows(spark.table("sessions"), "user_id", "uses") == batch == [(1, 1), (1, 2), (2, 1)]


def test_wrapped_archives_resolve_absolute_modules(spark):
    refs = spark.createDataFrame([("w/a.py", "python_import", "pkg.b"), ("w/a.py", "python_import", ".c"), ("w/a.py", "python_import", "gone")], "source string, kind string, value string")
    ids = spark.createDataFrame([], "path string, value string")
    inside = [("w/a.py", False), ("w/pkg/b.py", False), ("w/c.py", False)]
    links = lambda paths: rows(answers.host_links(refs, spark.createDataFrame(paths, "path string, skipped boolean"), ids), "target", "resolved")
    assert links(inside) == [("gone", False), ("w/c.py", True), ("w/pkg/b.py", True)]
    assert links([*inside, ("setup.py", False)]) == [("gone", False), ("pkg.b", False), ("w/c.py", True)]


def test_shortest_loops_first_by_path(spark):
    rng = random.Random(9)
    pairs = {(10 * g + rng.randrange(10), 10 * g + rng.randrange(10)) for g in range(5) for _ in range(16)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(104, 107), (200, 200)}
    after = {}
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)
    want = []
    for c in graph.cycles(spark.createDataFrame(sorted(pairs), "source long, target long")).collect():
        held, front, found = set(c["files"]), [[c["component"]]], None
        while not found:
            found = min((p for p in front if c["component"] in after.get(p[-1], [])), default=None)
            front = [] if found else [[*p, b] for p in front for b in after.get(p[-1], []) if b in held and b not in p]
        want.append((c["component"], len(found), found))
    assert rows(graph.loops(spark.createDataFrame(sorted(pairs), "source long, target long")), "component", "length", "files") == sorted(want) and len(want) > 4
    assert graph.loops(spark.createDataFrame([(1, 2)], "source long, target long")).count() == 0
