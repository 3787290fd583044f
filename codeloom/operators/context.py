"""What to show for a request about a file: candidates in tiers, each tier a join of its own.

Rows of a request are never gathered: a candidate's place in the total order is (step, place, path, start), and of equal ranges the
first one wins by a minimum. Tables: requests (request_id, project_id, path, intent, symbol or null), files (project_id, path, line_count),
symbols (project_id, path, name, qualified, kind, start, end, parent or null), words (project_id, path, line, name), edges (project_id, source, target)
and entries (project_id, path, reason), each row once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.operators.ranges import innermost
from codeloom.session import by_merge, written

#: Symbols of one file that a tier may name, names of a file that users are looked for by, lines of a header, matches of a plain name (fixed values).
SYMBOLS_PER_FILE, TARGET_NAMES, HEADER_LINES, NAME_MATCHES = 12, 30, 30, 5
#: Of a project's other files the most used ones come last; a budget is full long before.
REST = 20
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
COLUMNS = ["request_id", "step", "place", "kind", "path", "start", "end", "tier", "reason", "symbol", "primary"]


def words_of(files: DataFrame) -> DataFrame:
    """(project_id, path, line, name): the identifiers of each line of files (project_id, path, text)."""
    lines = files.select("project_id", "path", F.posexplode(F.split("text", "\n", -1)).alias("at", "line_text"))
    found = F.explode(F.array_distinct(F.regexp_extract_all("line_text", F.lit(IDENTIFIER), F.lit(0))))
    return lines.select("project_id", "path", (F.col("at") + 1).alias("line"), found.alias("name"))


def matched_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, project_id, path, intent, and the symbol's columns): the symbols with a request's qualified name, else the first few with its plain name."""
    asked = requests.where("symbol is not null").withColumnRenamed("symbol", "wanted")
    both = asked.join(symbols, ["project_id", "path"]).where("qualified = wanted or name = wanted").withColumn("exact", F.col("qualified") == F.col("wanted"))
    best = both.withColumns({"any_exact": F.max("exact").over(Window.partitionBy("request_id")), "nth": F.row_number().over(Window.partitionBy("request_id", "exact").orderBy("start", "qualified"))})
    return best.where("(any_exact and exact) or (not any_exact and nth <= " + str(NAME_MATCHES) + ")").drop("any_exact", "nth", "exact", "wanted")


def code(rows: DataFrame, step: int, tier: int, reason: str, place: Column | None = None, symbol: Column | None = None, primary: bool = False) -> DataFrame:
    return row(rows, step, "code", F.col("start"), F.col("end"), tier, F.lit(reason), place, symbol, primary)


def outline(rows: DataFrame, step: int, tier: int, reason: Column, place: Column | None = None) -> DataFrame:
    return row(rows, step, "outline", F.lit(0), F.lit(0), tier, reason, place)


def row(rows: DataFrame, step: int, kind: str, start: Column, end: Column, tier: int, reason: Column, place: Column | None = None, symbol: Column | None = None, primary: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "request_id", F.lit(step).alias("step"), (F.lit(0) if place is None else place).cast("long").alias("place"), F.lit(kind).alias("kind"), "path", start.cast("int").alias("start"), end.cast("int").alias("end"),
        F.lit(tier).alias("tier"), reason.alias("reason"), (none if symbol is None else symbol).alias("symbol"), F.lit(primary).alias("primary"),
    )


def usage_sites(targets: DataFrame, importers: DataFrame, symbols: DataFrame, words: DataFrame) -> DataFrame:
    """(request_id, project_id, path, name, qualified, start, end): the innermost symbols of importers (request_id, project_id, path) in which one of the
    request's target names (request_id, name) stands."""
    seen = importers.join(targets, "request_id").join(words, ["project_id", "path", "name"]).select("request_id", "project_id", "path", "line").distinct()
    held = symbols.where("kind <> 'variable'").select("project_id", "path", "qualified", "start", "end")
    hits = seen.join(held, ["project_id", "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).drop("line").distinct()
    return innermost(hits, "request_id", "path")


def first_symbols(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("request_id", "path").orderBy("start", "end", "qualified"))
    return rows.withColumn("nth", place).where(F.col("nth") <= SYMBOLS_PER_FILE).drop("nth")


def focused_candidates(requests: DataFrame, files: DataFrame, symbols: DataFrame, words: DataFrame, edges: DataFrame, entries: DataFrame, rest: int = REST) -> DataFrame:
    """Candidates (see COLUMNS) of requests to explain or debug a file or a symbol of it: the target, its header, what it depends on, who uses it,
    entry points, other symbols, neighbours and the project's most used files. A request whose symbol is unknown has none."""
    symbols, edges = written(symbols, "symbols"), written(edges, "edges")  # read by most tiers
    requests, files, symbols, words, edges = (by_merge(t) for t in (requests, files, symbols, words, edges))
    found = written(matched_symbols(requests, symbols), "matched")
    whole = requests.where("symbol is null").join(files, ["project_id", "path"]).select("request_id", "project_id", "path", "intent", F.lit(1).alias("start"), F.col("line_count").alias("end"))
    whole = whole.where("end >= 1")
    targets = written(whole.union(found.select(whole.columns)), "targets")
    known = targets.select("request_id", "project_id", "path", "intent").distinct()
    debug = known.where("intent = 'debug'")
    firsts = symbols.groupBy("project_id", "path").agg(F.min("start").alias("first"))
    header = found.select("request_id", "project_id", "path").distinct().join(firsts, ["project_id", "path"]).select("request_id", "path", F.lit(1).alias("start"), F.least(F.col("first") - 1, F.lit(HEADER_LINES)).alias("end")).where("end >= 1")
    parts = [code(whole, 0, 0, "selected file", primary=True), code(found, 0, 0, "selected symbol", symbol=F.col("qualified")), code(header, 1, 1, "header (imports) of the selected file")]
    # what the target depends on
    used = targets.where("intent = 'debug'").join(words, ["project_id", "path"]).where(F.col("line").between(F.col("start"), F.col("end"))).select("request_id", "name").distinct()
    on = edges.withColumnsRenamed({"source": "path", "target": "dep"})
    depends = known.join(on, ["project_id", "path"]).select("request_id", "project_id", F.col("dep").alias("path"), "intent")
    tops = symbols.where("parent is null and kind <> 'variable'").select("project_id", "path", "name", "qualified", "start", "end")
    bodies = first_symbols(depends.where("intent = 'debug'").join(tops, ["project_id", "path"]).join(used, ["request_id", "name"]))
    parts += [code(bodies, 2, 1, "implementation used by the selected code", symbol=F.col("qualified")), outline(depends.where("intent <> 'debug'"), 2, 1, F.lit("direct dependency")), outline(depends.where("intent = 'debug'"), 3, 3, F.lit("direct dependency (outline)"))]
    # who uses the target
    defined = whole.select("request_id", "project_id", "path").join(tops, ["project_id", "path"]).select("request_id", "name").distinct()
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("name"))
    names = defined.withColumn("nth", nth).where(F.col("nth") <= TARGET_NAMES).drop("nth").union(found.select("request_id", "name").distinct())
    into = edges.withColumnsRenamed({"target": "path", "source": "importer"})
    importers = written(known.join(into, ["project_id", "path"]).select("request_id", "project_id", F.col("importer").alias("path")), "importers")
    sites = written(usage_sites(names, importers, symbols, words), "sites")
    unseen = importers.join(sites.select("request_id", "path").distinct(), ["request_id", "path"], "left_anti")
    parts += [code(first_symbols(sites), 4, 2, "uses the selected code", symbol=F.col("qualified")), outline(unseen, 4, 2, F.lit("imports the selected file"))]
    # entry points, the rest of the file, its neighbours, the rest of the project
    starts = known.select("request_id", "project_id", F.col("path").alias("own")).join(entries, "project_id").where("path <> own")
    parts += [outline(starts, 5, 3, F.concat(F.lit("entry point: "), "reason")), outline(found.select("request_id", "path").distinct(), 6, 3, F.lit("other symbols in the selected file"))]
    siblings = symbols.where("kind <> 'variable'").select("project_id", "path", F.coalesce("parent", F.lit("")).alias("p"), F.col("qualified").alias("q"), F.col("start").alias("s"), F.col("end").alias("e"))
    beside = found.where("intent = 'debug'").withColumn("p", F.coalesce("parent", F.lit(""))).join(siblings, ["project_id", "path", "p"])
    before, after = F.col("e") < F.col("start"), F.col("s") > F.col("end")
    near = beside.groupBy("request_id", "path", "qualified").agg(F.max(F.when(before, F.struct("s", "e", "q"))).alias("b"), F.min(F.when(after, F.struct("s", "e", "q"))).alias("a"))
    near = near.select("request_id", "path", F.explode(F.array_compact(F.array("b", "a"))).alias("x")).select("request_id", "path", F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.q").alias("qualified")).distinct()
    near = near.join(found.select("request_id", "start", "end"), ["request_id", "start", "end"], "left_anti")
    degree = edges.groupBy("project_id", F.col("target").alias("path")).agg(F.countDistinct("source").alias("dependents"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("dependents"), "path"))
    ranked = files.select("project_id", "path").join(degree, ["project_id", "path"], "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    ranked = ranked.withColumn("nth", place).where(F.col("nth") <= rest)
    others = known.select("request_id", "project_id", F.col("path").alias("own")).join(ranked, "project_id").where("path <> own")
    parts += [code(near, 7, 4, "neighbouring symbol", symbol=F.col("qualified")), outline(others, 8, 4, F.lit("project file"), F.col("nth"))]
    every = reduce(DataFrame.unionByName, parts)
    order = F.struct("step", "place", "tier", "reason", "symbol", "primary")
    one = every.groupBy("request_id", "kind", "path", "start", "end").agg(F.min(order).alias("o"))
    return one.select("request_id", "o.step", "o.place", "kind", "path", "start", "end", "o.tier", "o.reason", "o.symbol", "o.primary")
