"""Dependency graphs: resolving references, degrees, cycles, entry points.

A project's files are rows; references are resolved with equi-joins on candidate paths, the earliest candidate that
exists wins. Graph loops run on the driver over written tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import text as T
from codeloom.operators.running import in_ranges, sum_before
from codeloom.session import by_merge, written

#: Extensions tried after a script's import path, in order, and after `index` in a folder (fixed values).
JS_ENDS = [".js", ".mjs", ".cjs", ".jsx", ".json", ".ts", ".tsx"]
JS_INDEX_ENDS = [".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"]
#: Modules that come with the script runtime (fixed values).
BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib".split()
#: Names that start a program by convention (fixed values).
ENTRY_NAMES = ["main", "app", "index", "server", "run", "manage", "wsgi", "asgi", "cli"]
#: Beginnings of web references that name no file, and of bundler aliases (fixed values).
IGNORED_SCHEMES = "^(data:|javascript:|mailto:|tel:|about:|blob:|#)"
ALIASES = "^(@/|~/|#|\\$|~)"


def first_known(refs: DataFrame, known: DataFrame, candidates: Column) -> DataFrame:
    """refs (with id, project_id) with path and kept of their first candidate among known (project_id, path, kept)."""
    tried = refs.select("id", "project_id", F.posexplode(candidates).alias("pos", "path"))
    found = tried.join(known, ["project_id", "path"]).groupBy("id").agg(F.min_by(F.struct("path", "kept"), "pos").alias("hit"))
    return refs.join(found, "id", "left").select(*refs.columns, F.col("hit.path").alias("path"), F.col("hit.kept").alias("kept"))


def known_paths(files: DataFrame) -> DataFrame:
    """(project_id, path, kept): kept is false for files that were left out."""
    return files.select("project_id", "path", F.col("reason").isNull().alias("kept")).distinct()


def ended(status: Column) -> list[Column]:
    target = F.when(status == "resolved", F.col("path"))
    return [status.alias("status"), target.alias("target")]


def resolve_scripts(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (id, project_id, source, specifier) of scripts with status, target and external kind. What files of one folder ask for alike is
    resolved once."""
    question = ["project_id", "folder", "specifier"]
    rows = refs.withColumn("folder", T.dir_name(F.col("source")))
    asked = written(rows.select(*question).distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    told = written(resolved_script_questions(asked, files), "told")
    same = [rows[c].eqNullSafe(F.col(f"_{c}")) for c in question]
    out = rows.drop("status", "target", "external_kind").join(told.withColumnsRenamed({c: f"_{c}" for c in question}), same)
    return out.select(*[F.trim(c).alias(c) if c == "specifier" else c for c in refs.columns], "status", "target", "external_kind")


def resolved_script_questions(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Different questions (id, project_id, folder, specifier) with status, target and external kind."""
    known = known_paths(files)
    tops = known.select("project_id", F.regexp_replace(F.split("path", "/")[0], r"(.)\.[^.]*$", "$1").alias("top")).distinct().withColumn("is_top", F.lit(True))
    spec = F.trim("specifier")
    head = F.split(spec, "/")[0]
    rooted, relative = F.startswith(spec, F.lit("/")), spec.isin(".", "..") | spec.rlike(r"^\.\.?/")
    base = T.normal_path(F.when(rooted, F.regexp_replace(spec, "^/+", "")).otherwise(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), spec)))
    rows = refs.where(spec != "").withColumns({"asked": F.col("specifier"), "specifier": spec, "top": head}).join(tops, ["project_id", "top"], "left")
    rows = rows.withColumn("base", F.when(rooted | relative, base))
    local = F.col("base").isNotNull() & ~F.lower("specifier").rlike("^(https?:)?//") & ~F.col("base").rlike(r"^\.\.(/|$)")
    plain = F.when(F.col("base") == ".", F.array([F.lit("index" + e) for e in JS_INDEX_ENDS])).otherwise(F.array(F.col("base"), *[F.concat("base", F.lit(e)) for e in JS_ENDS], *[F.concat("base", F.lit("/index" + e)) for e in JS_INDEX_ENDS]))
    found = first_known(rows, known, F.when(local, plain).otherwise(F.array().cast("array<string>")))
    low = F.lower("specifier")
    kind = F.when(low.rlike("^(https?:)?//"), "url").when(F.startswith(low, F.lit("node:")) | F.col("specifier").isin(BUILTINS) | F.col("top").isin(BUILTINS), "builtin")
    alias = F.col("base").isNull() & (F.col("specifier").rlike(ALIASES) | F.coalesce("is_top", F.lit(False)))
    status = (
        F.when(kind.isNotNull(), "external").when(alias, "unresolved").when(F.col("base").isNull(), "external").when(F.col("base").rlike(r"^\.\.(/|$)"), "unresolved")
        .when(F.col("kept"), "resolved").when(F.col("path").isNotNull(), "excluded").when(F.startswith("specifier", F.lit("/")), "unresolved").otherwise("missing")
    )
    return found.select("project_id", "folder", F.col("asked").alias("specifier"), *ended(status), F.when(status == "external", F.coalesce(kind, F.lit("package"))).alias("external_kind"))


def resolve_web(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs of pages and style sheets with status and target; references that name no file are left out."""
    spec = F.trim("specifier")
    rows = refs.where((spec != "") & ~F.lower(spec).rlike(IGNORED_SCHEMES)).withColumn("specifier", spec)
    clean = F.url_decode(F.replace(F.regexp_replace("specifier", r"[?#].*$", ""), F.lit("+"), F.lit("%2B")))
    outside = F.lower("specifier").rlike("^(https?:)?//") | F.startswith("specifier", F.lit("~"))
    rows = rows.withColumn("clean", F.when(~outside, clean)).where(F.col("clean").isNull() | (F.col("clean") != ""))
    base = T.normal_path(F.when(F.startswith("clean", F.lit("/")), F.regexp_replace("clean", "^/+", "")).otherwise(F.concat_ws("/", F.when(T.dir_name(F.col("source")) != "", T.dir_name(F.col("source"))), "clean")))
    rows = rows.withColumn("base", F.when(F.col("clean").isNotNull(), base))
    tries = F.when(F.col("base").isNull() | F.col("base").rlike(r"^\.\.(/|$)"), F.array().cast("array<string>")).when(F.endswith("clean", F.lit("/")) & ~F.startswith("clean", F.lit("/")), F.array(F.concat("base", F.lit("/index.html")), F.col("base"))).otherwise(F.array("base"))
    found = first_known(rows, known_paths(files), tries)
    status = (
        F.when(F.lower("specifier").rlike("^(https?:)?//"), "external").when(F.col("clean").isNull() | F.col("base").rlike(r"^\.\.(/|$)"), "unresolved")
        .when(F.col("kept"), "resolved").when(F.col("path").isNotNull(), "excluded").when(F.startswith("clean", F.lit("/")), "unresolved").otherwise("missing")
    )
    return found.select(*refs.columns, *ended(status), F.when(status == "external", "url").alias("external_kind"))


def resolve_modules(refs: DataFrame, files: DataFrame, stdlib: list[str]) -> DataFrame:
    """refs (id, project_id, source, specifier, names, level) of modules: one row for each file that they reach.

    Roots are tried in order: for absolute names the importing file's folder, its ancestors, then `src`; relative names
    have one. The first root with the module or a submodule of it that is imported by name decides. What files of one folder ask for alike is
    resolved once.
    """
    question = ["project_id", "folder", "specifier", "names", "level"]
    refs = refs.withColumn("folder", T.dir_name(F.col("source")))
    asked = written(refs.select(*question).distinct().withColumn("id", F.monotonically_increasing_id()), "asked")
    told = written(resolved_questions(asked, files, stdlib), "told")
    same = [refs[c].eqNullSafe(F.col(f"_{c}")) for c in question]
    out = refs.join(told.withColumnsRenamed({c: f"_{c}" for c in question}), same)
    return out.select("id", "project_id", "source", F.col("dotted").alias("specifier"), "line", "status", "target", "external_kind")


def resolved_questions(refs: DataFrame, files: DataFrame, stdlib: list[str]) -> DataFrame:
    """Different questions (id, project_id, folder, specifier, names, level) with dotted, status, target and external kind, as `resolve_modules` says."""
    known = known_paths(files)
    tree = known.withColumn("parts", F.split("path", "/")).where(F.size("parts") > 1)
    folders = tree.select("project_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.array_join(F.slice("parts", F.lit(1), k), "/"))).alias("path")).distinct()
    here = F.filter(F.split("folder", "/"), lambda p: p != "")
    up = F.transform(F.sequence(F.size(here), F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(here, F.lit(1), k), "/"))
    above = F.size(here) - F.col("level") + 1
    roots = F.when(F.col("level") == 0, F.concat(up, F.array(F.lit("src")))).when(above < 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(F.slice(here, F.lit(1), F.greatest(above, F.lit(0))), "/")))
    parts = F.filter(F.split("specifier", r"\."), lambda p: p != "")
    rows = refs.withColumn("parts", parts)
    tried = rows.select("id", "project_id", "level", "parts", "names", F.posexplode(roots).alias("root_at", "root"))
    join = lambda *p: F.array_join(F.filter(F.concat(*p), lambda x: x != ""), "/")
    module = join(F.array("root"), F.col("parts"))
    wanted = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n != "*")
    options = F.concat(
        F.when((F.size("parts") > 0) | (F.col("level") > 0), F.array(F.struct(module.alias("stem"), F.lit("").alias("sub")))).otherwise(F.array().cast("array<struct<stem:string,sub:string>>")),
        F.transform(wanted, lambda n: F.struct(join(F.array("root"), F.col("parts"), F.array(n)).alias("stem"), n.alias("sub"))),
    )
    stems = tried.select("id", "project_id", "root_at", F.size("parts").alias("n_parts"), F.explode(options).alias("o"))
    paths = stems.select("id", "project_id", "root_at", "o.sub", F.posexplode(F.array(F.when((F.col("n_parts") > 0) | (F.col("o.sub") != ""), F.concat("o.stem", F.lit(".py"))), F.when(F.col("o.stem") == "", "__init__.py").otherwise(F.concat("o.stem", F.lit("/__init__.py"))))).alias("form", "path"))
    hits = paths.where("path is not null").join(known, ["project_id", "path"])
    hits = hits.groupBy("id", "root_at", "sub").agg(F.min_by(F.struct("path", "kept"), "form").alias("hit"))
    spaces = tried.where(F.size("parts") > 0).select("id", "project_id", "root_at", module.alias("path")).join(folders, ["project_id", "path"]).select("id", "root_at").distinct()
    decided = hits.select("id", "root_at").union(spaces).groupBy("id").agg(F.min("root_at").alias("first"))
    chosen = hits.join(decided, "id").where("root_at = first").select("id", "sub", "hit")
    main = chosen.where("sub = ''").select("id", F.col("hit.path").alias("main"))
    chosen = chosen.join(main, "id", "left").where("sub = '' or main is null or hit.path <> main").select("id", "sub", "hit")
    heads = tried.where(F.size("parts") > 0).select("id", "project_id", F.explode(F.array(join(F.array("root"), F.slice("parts", 1, 1)), F.concat(join(F.array("root"), F.slice("parts", 1, 1)), F.lit(".py")))).alias("path"))
    partial = heads.join(known.select("project_id", "path").union(folders), ["project_id", "path"]).select("id").distinct().withColumn("partial", F.lit(True))
    out = rows.join(chosen, "id", "left").join(decided, "id", "left").join(partial, "id", "left")
    lib = F.element_at("parts", 1).isin(stdlib) if stdlib else F.lit(False)
    status = (
        F.when(F.col("hit.kept"), "resolved").when(F.col("hit").isNotNull(), "excluded").when(F.col("first").isNotNull(), "unresolved").when(F.col("level") > 0, "missing")
        .when(F.col("partial"), "missing").otherwise("external")
    )
    shown = F.concat(F.repeat(F.lit("."), F.col("level")), F.col("specifier"))
    dotted = F.when(F.coalesce("sub", F.lit("")) == "", shown).otherwise(F.concat(shown, F.when(F.endswith(shown, F.lit(".")), "").otherwise("."), F.col("sub")))
    kind = F.when(status == "external", F.when((F.size("parts") > 0) & lib, "stdlib").otherwise("package"))
    return out.select("project_id", "folder", "specifier", "names", "level", dotted.alias("dotted"), status.alias("status"), F.when(status == "resolved", F.col("hit.path")).alias("target"), kind.alias("external_kind"))


def external_label(specifier: Column, kind: Column, source: Column) -> Column:
    script = F.lower(source).rlike(r"\.(js|jsx|mjs|cjs)$")
    parts = F.split(F.regexp_replace(specifier, "^node:", ""), "/")
    packaged = F.when(F.startswith(specifier, F.lit("@")), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    return F.when(kind == "url", specifier).when(kind.isin("package", "builtin") & script, packaged).otherwise(F.split(F.regexp_replace(specifier, r"^\.+", ""), r"\.")[0])


def externals(edges: DataFrame) -> DataFrame:
    label = external_label(F.col("specifier"), F.col("external_kind"), F.col("source"))
    return edges.where("status = 'external'").groupBy(F.col("external_kind").alias("kind"), label.alias("name")).agg(F.array_sort(F.collect_set("source")).alias("files"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, dependencies, dependents): distinct targets and sources of each node; nodes without edges have 0."""
    e = edges.select("source", "target").where("target is not null").distinct()
    out, into = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("o")), e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("i"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return nodes.join(out, "node", "left").join(into, "node", "left").select("node", zero("o").alias("dependencies"), zero("i").alias("dependents"))


def entry_points(files: DataFrame, edges: DataFrame, guards: DataFrame) -> DataFrame:
    """(project_id, path, reason) of analysed files that start a program. guards: files with a main guard."""
    used = edges.where("status = 'resolved'").select("project_id", F.col("target").alias("path")).distinct().withColumn("used", F.lit(True))
    rows = files.join(used, ["project_id", "path"], "left").join(guards.select("project_id", "path").distinct().withColumn("guard", F.lit(True)), ["project_id", "path"], "left")
    name, free = F.lower(T.base_name(F.col("path"))), F.col("used").isNull()
    stem = F.regexp_replace(name, r"(.)\.[^.]*$", "$1")
    reason = (
        F.when((F.col("language") == "python") & F.col("guard"), "main_guard").when((F.col("language") == "python") & (name == "__main__.py"), "package_main")
        .when(F.col("language").isin("python", "javascript") & stem.isin(ENTRY_NAMES) & free, "conventional_name")
        .when((F.col("language") == "html") & (stem == "index"), "index_page").when((F.col("language") == "html") & free, "unreferenced_page")
    )
    return rows.select("project_id", "path", reason.alias("reason")).where("reason is not null")


def ranked_entries(entries: DataFrame) -> DataFrame:
    """entry points with place: those in outer folders first, then by path, counted for each project over ranges of that order."""
    depth = F.size(F.split("path", "/"))
    rows = in_ranges(entries.withColumns({"_depth": depth, "_one": F.lit(1)}), ["project_id"], ["_depth", "path"])
    return sum_before(rows, ["project_id"], ["_depth", "path"], "_one", "_n").withColumn("place", (F.col("_n") + 1).cast("long")).drop("_depth", "_one", "_n", "bucket")


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all executors share. It meets others by sorting: a broadcast in each round would pass the driver."""
    return by_merge(written(df, "graph"))


def trimmed(edges: DataFrame) -> DataFrame:
    """edges without those that are on no cycle because nothing leads to their source or from their target, repeatedly."""
    size = edges.count()
    while True:
        sources, targets = edges.select(F.col("source").alias("target")).distinct(), edges.select(F.col("target").alias("source")).distinct()
        edges = saved(edges.join(targets, "source", "left_semi").join(sources, "target", "left_semi").select("source", "target"))
        now = edges.count()
        if now == size:
            return edges
        size = now


def least_label(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that leads to each source of an edge, itself among them; one row for each node throughout."""
    labels = saved(edges.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node")))
    front = labels
    while True:
        step = front.select(F.col("node").alias("source"), "label").join(edges, "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("new"))
        front = saved(step.join(labels, "node").where(F.col("new") < F.col("label")).select("node", F.col("new").alias("label")))
        if front.isEmpty():
            return labels
        labels = saved(labels.join(front.select("node", F.col("label").alias("new")), "node", "left").select("node", F.coalesce("new", "label").alias("label")))


def leading_back(inner: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): nodes from which edges between nodes of one label lead to the node that gave the label."""
    found = front = saved(labels.where(F.col("node") == F.col("label")))
    while True:
        step = front.select(F.col("node").alias("target"), "label").join(inner, "target").select(F.col("source").alias("node"), "label").distinct()
        front = saved(step.join(found, "node", "left_anti"))
        if front.isEmpty():
            return found
        found = saved(found.union(front))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, files, size): strongly connected components of two or more nodes, and nodes with an edge to themselves.

    A node that leads to the smallest node that leads to it is in that node's component. What has other labels at its two ends
    or touches a found component goes, and the rest is labelled again; tables hold a row for each edge or node, never for paths.
    """
    e = saved(edges.select("source", "target").where("source is not null and target is not null").distinct())
    left, parts = trimmed(e.where("source <> target")), []
    while not left.isEmpty():
        labels = least_label(left)
        ends = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"__{c}"))  # noqa: B023, E731
        inner = saved(left.join(ends("source"), "source").join(ends("target"), "target").where("__source = __target").select("source", "target"))
        parts.append(leading_back(inner, labels))
        done = [parts[-1].select(F.col("node").alias(c)) for c in ("source", "target")]
        left = trimmed(inner.join(done[0], "source", "left_anti").join(done[1], "target", "left_anti").select("source", "target"))
    members = e.select(F.col("source").alias("node"), F.col("source").alias("label")).where("source = target")
    for part in parts:
        large = part.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        part = saved(part.join(large, "label", "left_semi").select("node", "label"))
        members = members.join(part.select("node"), "node", "left_anti").union(part)
    out = members.groupBy(F.col("label").alias("component")).agg(F.array_sort(F.collect_set("node")).alias("files"))
    return out.withColumn("size", F.size("files").cast("long"))


def loops(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(component, length, files): for each component of `cycles` a shortest loop through its first member, of equally short ones the first by
    its path; files begin with that member.

    Breadth-first search runs backwards from all first members at once, inside their components, until each is met again: so every node knows how
    many steps lead back. From there each node's next one is its first neighbour that is a step nearer, and the path is written by
    doubling: what is 2^k places on is known for every node before the places themselves are filled in as many rounds."""
    e = saved(edges.select("source", "target").where("source is not null and target is not null").distinct())
    found = cycles(e)
    member = saved(found.select("component", F.explode("files").alias("node")))
    ends = lambda c: member.select(F.col("component").alias(f"_{c}"), F.col("node").alias(c))
    inner = saved(e.join(ends("source"), "source").join(ends("target"), "target").where("_source = _target").select(F.col("_source").alias("component"), "source", "target"))
    back = front = saved(inner.where("target = component").select("component", F.col("source").alias("node"), F.lit(1).alias("steps")))
    for steps in range(2, rounds):
        closed = back.where("node = component").select("component")
        step = front.join(closed, "component", "left_anti").select("component", F.col("node").alias("target")).join(inner, ["component", "target"]).select("component", F.col("source").alias("node")).distinct()
        front = saved(step.join(back, ["component", "node"], "left_anti").withColumn("steps", F.lit(steps)))
        if front.isEmpty():
            break
        back = saved(back.unionByName(front))
    else:
        raise RuntimeError("a loop is longer than rounds")
    lengths = saved(back.where("node = component").select("component", F.col("steps").alias("length")))
    near = back.select("component", F.col("node").alias("target"), (F.col("steps") + 1).alias("steps")).unionByName(lengths.select("component", F.col("component").alias("target"), F.lit(1).alias("steps")))
    jump = back.withColumnRenamed("node", "source").join(inner, ["component", "source"]).join(near, ["component", "target", "steps"])
    jump = saved(jump.groupBy("component", F.col("source").alias("node")).agg(F.min("target").alias("to")))
    path, jumps, far = lengths.select("component", "length", F.lit(0).alias("pos"), F.col("component").alias("node")), [jump], 1
    longest = lengths.agg(F.max("length")).first()[0] or 0
    while 2**far < longest:
        last = jumps[-1]
        jumps.append(saved(last.withColumnRenamed("to", "via").join(last.select("component", F.col("node").alias("via"), "to"), ["component", "via"]).select("component", "node", "to")))
        far += 1
    for k in reversed(range(len(jumps))):
        on = path.join(jumps[k], ["component", "node"]).where(F.col("pos") + 2**k < F.col("length"))
        path = saved(path.unionByName(on.select("component", "length", (F.col("pos") + 2**k).alias("pos"), F.col("to").alias("node"))))
    rows = path.groupBy("component", "length").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("p"))
    return rows.select("component", F.col("length").cast("long").alias("length"), F.transform("p", lambda p: p["node"]).alias("files"))


def distances(edges: DataFrame, start: str, rounds: int = 1000) -> DataFrame:
    """(node, hops, via): breadth-first from start; via is the smallest node that leads there in as few hops."""
    e = edges.select("source", "target").where("target is not null").distinct()
    found = saved(e.where(F.col("source") == start).select(F.col("target").alias("node"), F.lit(1).alias("hops"), F.col("source").alias("via")).distinct())
    front = found
    for hop in range(2, rounds):
        step = front.select(F.col("node").alias("source")).join(e, "source").groupBy(F.col("target").alias("node")).agg(F.min("source").alias("via"))
        front = saved(step.join(found, "node", "left_anti").select("node", F.lit(hop).alias("hops"), "via"))
        if front.isEmpty():
            return found
        found = saved(found.union(front))
    raise RuntimeError("more hops than rounds")


def relationships(edges: DataFrame, most: int = 20) -> DataFrame:
    """Each project's edges for an overview: missing ones first, then those to the most used targets."""
    one = saved(edges.select("project_id", "source", "specifier", "status", "target").distinct())
    used = one.where("status = 'resolved'").groupBy("project_id", "target").agg(F.countDistinct("source").alias("dependents"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("status") != "missing", F.desc(F.coalesce("dependents", F.lit(0))), "source", "specifier"))
    return one.join(used, ["project_id", "target"], "left").withColumn("place", place).where(F.col("place") <= most)
