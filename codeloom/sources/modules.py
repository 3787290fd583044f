"""Modules as tables of syntax nodes, and symbols, imports and rules as joins of them.

A small helper turns each text into one row for each node, in the order of the text, inside `mapInArrow`. A node knows its parent, its last
descendant (so "inside" is a range of numbers), the scope it stands in, and its name if it is one (`items`, `self.items`). What a file declares
and what the rules say follow from joins on the file and these numbers; nothing but the nodes themselves comes from the parser.

Edge cases: a null text is an empty module; a text that does not parse has one node `Error` with its line, which is a hit; one that is too deep
for the parser has one node `Unreadable` and no hits.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import by_merge, dealt, written

FILE = ["project_id", "path"]
NODES = pa.schema(
    [("project_id", pa.string()), ("path", pa.string())]
    + [(c, pa.int32()) for c in ("node", "parent", "pos", "scope", "home", "line", "end", "last")]
    + [(c, pa.string()) for c in ("field", "kind", "name", "value", "ctx", "within")]
)
KINDS = {pa.int32(): "int", pa.string(): "string"}
#: Nodes of one batch on their way back.
BATCH = 50_000
#: Hits of a rule in a file, hits of both loop rules together, loops of a file that they look at (fixed values).
MOST_HITS, MOST_LOOP_HITS, MOST_LOOPS = 5, 10, 300
#: Methods that change a container (fixed values).
MUTATORS = ["append", "extend", "insert", "add", "update", "setdefault", "pop", "popitem", "remove", "discard", "clear", "sort", "reverse"]
#: Methods that change a container's length (fixed values).
LENGTH_CHANGERS = ["append", "extend", "insert", "pop", "remove", "clear", "popitem", "add", "discard", "update", "setdefault"]
#: Exceptions whose handlers catch a read past the end (fixed values).
GUARDS = ["IndexError", "LookupError", "Exception", "BaseException"]
#: Functions that take the first item of what they are given (fixed values).
FIRST_TAKERS = ["iter", "next", "enumerate", "zip", "sum", "min", "max", "sorted"]
LITERALS = ["str", "bytes", "int", "float", "complex"]
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Attribute):
        owner = dotted(node.value)
        return owner and f"{owner}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else None


def told(node: ast.AST) -> tuple[str | None, str | None]:
    """(name, value) of a node: what it is called, and the plain values that it holds."""
    if isinstance(node, (ast.Name, ast.Attribute)):
        return dotted(node), None
    if isinstance(node, ast.Constant):
        short = type(node.value) is int and abs(node.value) < 2**31 or isinstance(node.value, str) and len(node.value) <= 40
        return str(node.value) if short else None, type(node.value).__name__
    if isinstance(node, (ast.Global, ast.Nonlocal)):
        return ",".join(node.names), None
    if isinstance(node, ast.Compare):
        return None, ",".join(type(o).__name__ for o in node.ops)
    if isinstance(node, ast.ImportFrom):
        return node.module or "", str(node.level)
    name = getattr(node, "name", None) or getattr(node, "arg", None)
    op = getattr(node, "op", None)
    return name if isinstance(name, str) else None, type(op).__name__ if op is not None else getattr(node, "asname", None)


def node_rows(text: str) -> list[list]:
    """Rows from `node` on, as in NODES, of one module."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except SyntaxError as e:
        return [[0, -1, 0, 0, 0, e.lineno or 1, e.lineno or 1, 0, "", "Error", None, None, None, ""]]
    except (RecursionError, MemoryError, ValueError, OverflowError):
        return [[0, -1, 0, 0, 0, 1, 1, 0, "", "Unreadable", None, None, None, ""]]
    rows, todo = [], [(tree, -1, "", 0, 0, 0, "")]
    while todo:
        node, parent, field, pos, scope, home, within = todo.pop()
        me = len(rows)
        line = getattr(node, "lineno", None)
        first = min([line, *(d.lineno for d in getattr(node, "decorator_list", []))]) if line else None
        ctx = type(node.ctx).__name__ if hasattr(node, "ctx") else None
        rows.append([me, parent, pos, scope, home, first, getattr(node, "end_lineno", None), me, field, type(node).__name__, *told(node), ctx, within])
        if isinstance(node, SCOPES):
            scope = me
            home = home if isinstance(node, (ast.ClassDef, ast.Lambda)) else me
            within = f"{within}{node.name}." if isinstance(node, ast.ClassDef) and within is not None else None
        children = []
        for key, value in ast.iter_fields(node):
            for k, child in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(child, ast.AST) and not isinstance(child, (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)):
                    children.append((child, me, key, k, scope, home, within))
        todo += reversed(children)
    for row in reversed(rows):
        if row[1] >= 0:
            rows[row[1]][7] = max(rows[row[1]][7], row[7])
    return rows


def module_nodes(files: DataFrame) -> DataFrame:
    """A row for each syntax node of the modules in files (project_id, path, text). A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for project, path, text in zip(*(batch.column(c) for c in range(3)), strict=True):
                own = (project.as_py(), path.as_py())
                out += [(*own, *row) for row in node_rows(text.as_py() or "")]
                if len(out) >= BATCH:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    rows = dealt(files.select("project_id", "path", "text"), FILE).mapInArrow(run, ", ".join(f"{f.name} {KINDS[f.type]}" for f in NODES))
    return by_merge(written(rows, "nodes"))


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODES, strict=True)], schema=NODES)


def module_symbols(nodes: DataFrame) -> DataFrame:
    """(project_id, path, name, kind, start, end): functions, methods and classes outside functions, module variables, main guards."""
    method = F.when(F.col("within") == "", "function").otherwise("method")
    kind = F.when(F.col("kind") == "ClassDef", "class").when(F.col("kind") == "AsyncFunctionDef", F.concat(F.lit("async_"), method)).otherwise(method)
    defs = nodes.where("kind in ('FunctionDef', 'AsyncFunctionDef', 'ClassDef') and within is not null")
    defs = defs.select(*FILE, F.concat("within", "name").alias("name"), kind.alias("kind"), F.col("line").alias("start"), "end")
    sets = nodes.where("kind in ('Assign', 'AnnAssign') and within = ''").select(*FILE, F.col("node").alias("parent"), F.col("line").alias("start"), "end")
    names = nodes.where("kind = 'Name' and field in ('targets', 'target')").select(*FILE, "parent", "name")
    variables = names.join(sets, [*FILE, "parent"]).select(*FILE, "name", F.lit("variable").alias("kind"), "start", "end")
    return defs.union(variables).union(main_guards(nodes))


def main_guards(nodes: DataFrame) -> DataFrame:
    """Statements `if __name__ == "__main__":` (either way round) of a module."""
    sides = nodes.where("(kind = 'Name' and name = '__name__') or (kind = 'Constant' and value = 'str' and name = '__main__')")
    sides = sides.groupBy(*FILE, "parent").agg(F.countDistinct("kind").alias("n")).where("n = 2").select(*FILE, F.col("parent").alias("node"))
    tests = nodes.where("kind = 'Compare' and value = 'Eq' and field = 'test'").join(sides, [*FILE, "node"], "left_semi").select(*FILE, F.col("parent").alias("node"))
    found = nodes.where("kind = 'If' and within = ''").join(tests, [*FILE, "node"], "left_semi")
    return found.select(*FILE, F.lit("__main__").alias("name"), F.lit("guard").alias("kind"), F.col("line").alias("start"), "end")


def module_refs(nodes: DataFrame) -> DataFrame:
    """(project_id, path, specifier, line, end, names, level): a row for each imported module, and for each `from` with what it takes."""
    said = nodes.where("kind in ('Import', 'ImportFrom')").select(*FILE, F.col("node").alias("parent"), "kind", F.col("name").alias("module"), F.col("value").cast("int").alias("level"), "line", "end")
    both = said.join(nodes.where("kind = 'alias'").select(*FILE, "parent", "pos", "name"), [*FILE, "parent"])
    none = F.array().cast("array<string>")
    plain = both.where("kind = 'Import'").select(*FILE, F.col("name").alias("specifier"), "line", "end", none.alias("names"), F.lit(0).alias("level"))
    taken = both.where("kind = 'ImportFrom'").groupBy(*FILE, "parent", "module", "level", "line", "end").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return plain.union(taken.select(*FILE, F.col("module").alias("specifier"), "line", "end", F.transform("x", lambda x: x["name"]).alias("names"), "level"))


class Facts:
    """What the rules ask of the nodes. All tables have the file's columns; ranges of nodes are closed."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        child = nodes.select(*FILE, "parent", "field", "pos", F.col("kind").alias("c_kind"), F.col("name").alias("c_name"), F.col("value").alias("c_value"), F.col("node").alias("c_node"), F.col("last").alias("c_last"))
        self.child = child
        at = lambda field, *more: F.max(F.when((F.col("field") == field) & (F.col("pos") == 0), F.struct(*more)))
        some = nodes.where("kind in ('Call', 'Subscript')").select(*FILE, "node", "kind", "scope", "line", "ctx", "field", "parent").withColumnsRenamed({"field": "role", "parent": "holder"})
        parts = some.join(child.withColumnRenamed("parent", "node"), [*FILE, "node"]).groupBy(*FILE, "node", "kind", "scope", "line", "ctx", "role", "holder")
        parts = parts.agg(
            at("func", "c_kind", "c_name").alias("func"), F.count_if(F.col("field") == "args").alias("n_args"), F.count_if(F.col("field") == "keywords").alias("n_keys"),
            F.array_sort(F.collect_list(F.when(F.col("field") == "args", F.col("c_name")))).alias("given"), at("args", "c_name").alias("arg"),
            at("value", "c_name").alias("of"), at("slice", "c_kind", "c_name", "c_value", "c_node", "c_last").alias("by"),
        )
        parts = by_merge(written(parts, "parts"))
        #: (node, scope, line, owner, method, fn, given): calls; fn if a plain name is called, owner and method if `owner.method` is
        calls = parts.where("kind = 'Call'")
        named = F.col("func.c_kind") == "Attribute"
        method = F.element_at(F.split("func.c_name", r"\."), -1)
        owner = F.when(named, F.expr("left(func.c_name, char_length(func.c_name) - char_length(element_at(split(func.c_name, '\\\\.'), -1)) - 1)"))
        self.calls = calls.select(*FILE, "node", "scope", "line", owner.alias("owner"), F.when(named, method).alias("method"), F.when(F.col("func.c_kind") == "Name", F.col("func.c_name")).alias("fn"), "n_args", "n_keys", "given", F.col("arg.c_name").alias("arg"))
        #: (node, seq): `len(seq)`
        self.lengths = self.calls.where("fn = 'len' and n_args = 1 and n_keys = 0 and arg is not null").select(*FILE, "node", F.col("arg").alias("seq"))
        #: (node, scope, line, ctx, seq, i_kind, i, ...): `seq[i]`
        self.items = parts.where("kind = 'Subscript'").select(*FILE, "node", "scope", "line", "ctx", "role", "holder", F.col("of.c_name").alias("seq"), F.col("by.c_kind").alias("i_kind"), F.col("by.c_name").alias("i"), F.col("by.c_value").alias("i_value"), F.col("by.c_node").alias("i_node"), F.col("by.c_last").alias("i_last"))
        self.names = nodes.where("kind = 'Name'").select(*FILE, F.col("name").alias("i"), F.col("node").alias("n"))
        self.bound = self.bindings()

    def bindings(self) -> DataFrame:
        """(name): all names that a file binds anywhere."""
        name = F.when(F.col("kind") == "alias", F.split(F.coalesce("value", "name"), r"\.")[0]).otherwise(F.col("name"))
        held = F.col("kind").isin("FunctionDef", "AsyncFunctionDef", "ClassDef", "arg", "alias", "ExceptHandler") | ((F.col("kind") == "Name") & F.col("ctx").isin("Store", "Del"))
        return self.nodes.where(held & name.isNotNull()).select(*FILE, name.alias("name")).distinct()

    def range_loops(self) -> DataFrame:
        """(loop, i, scope, home, line, from, to, n_args, start, stop): `for i in range(...)`; start is null unless it is a whole number, stop
        is the node of the last argument. Files that bind `range` or `len` have none."""
        loops = self.nodes.where("kind = 'For'").select(*FILE, F.col("node").alias("loop"), "scope", "home", "line")
        at = lambda field, *more: F.max(F.when(F.col("field") == field, F.struct(*more)))
        body = F.when(F.col("field") == "body", F.col("c_node")), F.when(F.col("field") == "body", F.col("c_last"))
        parts = loops.join(self.child.withColumnRenamed("parent", "loop"), [*FILE, "loop"]).groupBy(*FILE, "loop", "scope", "home", "line")
        parts = parts.agg(at("target", "c_kind", "c_name").alias("target"), at("iter", "c_node").alias("iter"), F.min(body[0]).alias("from"), F.max(body[1]).alias("to"))
        parts = parts.where("target.c_kind = 'Name'").select(*FILE, "loop", F.col("target.c_name").alias("i"), "scope", "home", "line", "from", "to", F.col("iter.c_node").alias("node"))
        ranges = self.calls.where("fn = 'range' and n_keys = 0 and n_args between 1 and 2").select(*FILE, "node", F.col("n_args"))
        args = self.child.where("field = 'args'").withColumnRenamed("parent", "node")
        start = F.max(F.when((F.col("pos") == 0) & (F.col("n_args") == 2) & (F.col("c_kind") == "Constant") & (F.col("c_value") == "int"), F.col("c_name").cast("long")))
        ranges = ranges.join(args, [*FILE, "node"]).groupBy(*FILE, "node", "n_args").agg(start.alias("start"), F.max_by("c_node", "pos").alias("stop"))
        shadowed = self.bound.where("name in ('range', 'len')").select(*FILE).distinct()
        found = parts.join(ranges, [*FILE, "node"]).join(shadowed, FILE, "left_anti").drop("node")
        place = F.row_number().over(Window.partitionBy(*FILE).orderBy("loop"))
        return found.withColumn("place", place).where(F.col("place") <= MOST_LOOPS).drop("place")

    def without(self, rows: DataFrame, other: DataFrame, keys: list[str], inside: str, lo: str = "from", hi: str = "to") -> DataFrame:
        """rows that have no row of other with the same keys (null-safe keys are not needed) whose `inside` lies from lo to hi."""
        held = by_merge(other.select(*[F.col(k).alias(f"_{k}") for k in [*FILE, *keys]], F.col(inside).alias("_in")))
        same = [F.col(k) == F.col(f"_{k}") for k in [*FILE, *keys]]
        return rows.join(held, [*same, F.col("_in").between(F.col(lo), F.col(hi))], "left_anti")


def with_reads(facts: Facts, loops: DataFrame) -> DataFrame:
    """loops (with seq and i) that read `seq[i]` in their body, with the first line that does."""
    reads = facts.items.where("i_kind = 'Name'").select(*FILE, "scope", "seq", "i", F.col("node").alias("n"), F.col("line").alias("read"))
    both = loops.join(reads, [*FILE, "scope", "seq", "i"]).where(F.col("n").between(F.col("from"), F.col("to")))
    return both.groupBy(*loops.columns).agg(F.min("read").alias("read"))


def past_end(facts: Facts) -> DataFrame:
    """Loops over `range(len(x) + k)` that read x[i]: x keeps its length, nothing catches the error, no comparison of i with len(x)."""
    sides = facts.nodes.where("kind = 'BinOp' and value = 'Add'").select(*FILE, F.col("node").alias("parent")).join(facts.child, [*FILE, "parent"])
    sides = sides.join(facts.lengths.withColumnRenamed("node", "c_node"), [*FILE, "c_node"], "left").groupBy(*FILE, "parent")
    whole = F.max(F.when((F.col("c_kind") == "Constant") & (F.col("c_value") == "int"), F.col("c_name").cast("long")))
    plus = sides.agg(F.max("seq").alias("seq"), whole.alias("k")).where("seq is not null and k >= 1").select(*FILE, F.col("parent").alias("stop"), "seq")
    loops = with_reads(facts, facts.range_loops().join(plus, [*FILE, "stop"]).where("n_args = 1 or start is not null"))
    changed = facts.calls.where(F.col("method").isin(LENGTH_CHANGERS)).select(*FILE, "scope", F.col("owner").alias("seq"), "node")
    holders = facts.nodes.where("kind in ('Assign', 'AugAssign', 'AnnAssign', 'Delete')").select(*FILE, F.col("node").alias("parent"), F.col("kind").alias("holder"))
    targets = facts.nodes.where("field in ('target', 'targets') and kind in ('Name', 'Attribute') and name is not null").join(holders, [*FILE, "parent"], "left_semi").select(*FILE, "scope", F.col("name").alias("seq"), "node")
    dropped = facts.items.where("role = 'targets' and ctx = 'Del'").select(*FILE, "scope", "seq", "node")
    loops = facts.without(loops, changed.union(targets).union(dropped), ["scope", "seq"], "node")
    # the bodies of try statements whose handlers would catch it
    handlers = facts.nodes.where("kind = 'ExceptHandler'").select(*FILE, F.col("node").alias("handler"), F.col("parent").alias("try"), F.col("last").alias("h_last"))
    types = facts.child.where("field = 'type'").select(*FILE, F.col("parent").alias("handler"), "c_node", "c_kind", "c_name", F.lit(True).alias("typed"))
    elements = facts.child.where("field = 'elts' and c_kind = 'Name'").where(F.col("c_name").isin(GUARDS)).select(*FILE, F.col("parent").alias("c_node"), F.lit(True).alias("element")).distinct()
    caught = handlers.join(types, [*FILE, "handler"], "left").join(elements, [*FILE, "c_node"], "left")
    caught = caught.where(F.col("typed").isNull() | ((F.col("c_kind") == "Name") & F.col("c_name").isin(GUARDS)) | ((F.col("c_kind") == "Tuple") & F.col("element"))).select(*FILE, "try").distinct()
    bodies = facts.child.where("field = 'body'").withColumnRenamed("parent", "try").join(caught, [*FILE, "try"], "left_semi").select(*[F.col(c).alias(f"_{c}") for c in FILE], "c_node", "c_last")
    same, bodies = [F.col(c) == F.col(f"_{c}") for c in FILE], by_merge(bodies)
    loops = loops.join(bodies, [*same, F.col("loop").between(F.col("c_node"), F.col("c_last"))], "left_anti")
    # comparisons in the body that have both i and len(x)
    tests = facts.nodes.where("kind = 'Compare'").select(*FILE, "scope", F.col("node").alias("c"), F.col("last").alias("z"))
    tests = loops.select(*FILE, "loop", "scope", "i", "seq", "from", "to").join(tests, [*FILE, "scope"]).where(F.col("c").between(F.col("from"), F.col("to")))
    tests = tests.join(facts.names, [*FILE, "i"]).where(F.col("n").between(F.col("c"), F.col("z"))).select(*FILE, "loop", "seq", "c", "z").distinct()
    tests = tests.join(facts.lengths, [*FILE, "seq"]).where(F.col("node").between(F.col("c"), F.col("z"))).select(*FILE, "loop").distinct()
    return loops.join(tests, [*FILE, "loop"], "left_anti").select(*FILE, F.col("loop").alias("at"), "line", F.col("read").alias("end"))


def skips_first(facts: Facts) -> DataFrame:
    """Loops over `range(1, len(x))` that read x[i], while no neighbour is read, no other table filled, and nothing takes the first item."""
    loops = facts.range_loops().where("n_args = 2 and start = 1").join(facts.lengths.withColumnRenamed("node", "stop"), [*FILE, "stop"])
    loops = with_reads(facts, loops)
    sums = facts.items.where("i_kind = 'BinOp'").select(*FILE, "scope", "node", "i_node", "i_last")
    counters = facts.names.join(loops.select(*FILE, "i").distinct(), [*FILE, "i"], "left_semi")
    sums = sums.join(by_merge(counters), FILE).where(F.col("n").between(F.col("i_node"), F.col("i_last")))
    loops = facts.without(loops, sums.select(*FILE, "scope", "i", "node").distinct(), ["scope", "i"], "node")
    fills = facts.items.where("ctx = 'Store' and i_kind = 'Name'").select(*[F.col(c).alias(f"_{c}") for c in (*FILE, "scope", "i", "seq", "node")])
    same = [F.col(c) == F.col(f"_{c}") for c in (*FILE, "scope", "i")]
    loops = loops.join(fills, [*same, F.col("_node").between(F.col("from"), F.col("to")), ~F.col("_seq").eqNullSafe(F.col("seq"))], "left_anti")
    lower = facts.child.where("field = 'lower'").select(*FILE, F.col("parent").alias("i_node"), F.concat_ws(":", "c_value", "c_name").alias("lower"))
    firsts = facts.items.join(lower, [*FILE, "i_node"], "left")
    firsts = firsts.where("(i_kind = 'Constant' and i_value = 'int' and i = '0') or (i_kind = 'Slice' and (lower is null or lower = 'int:0'))").select(*FILE, F.col("scope").alias("home"), "seq")
    popped = facts.calls.where("method = 'pop'").select(*FILE, F.col("scope").alias("home"), F.col("owner").alias("seq"))
    given = facts.calls.where(F.col("fn").isin(FIRST_TAKERS)).select(*FILE, F.col("scope").alias("home"), F.explode("given").alias("seq"))
    handled = by_merge(firsts.union(popped).union(given).distinct())
    return loops.join(handled, [*FILE, "home", "seq"], "left_anti").select(*FILE, F.col("loop").alias("at"), "line", F.col("read").alias("end"))


def is_literal(facts: Facts) -> DataFrame:
    """Comparisons with `is` or `is not` of which one side is a text, bytes or a number."""
    tests = facts.nodes.where("kind = 'Compare'").select(*FILE, "node", "line", F.posexplode(F.split("value", ",")).alias("at", "op")).where("op in ('Is', 'IsNot')")
    signed = facts.nodes.where("kind = 'UnaryOp' and value in ('USub', 'UAdd')").select(*FILE, F.col("node").alias("c_node"))
    inner = facts.child.where("field = 'operand' and c_kind = 'Constant'").select(*FILE, F.col("parent").alias("c_node"), F.col("c_value").alias("inner"))
    signed = signed.join(inner, [*FILE, "c_node"])
    sides = facts.child.where("field in ('left', 'comparators')").join(signed, [*FILE, "c_node"], "left")
    literal = F.coalesce("inner", F.when(F.col("c_kind") == "Constant", F.col("c_value"))).isin(LITERALS)
    sides = sides.where(literal).select(*FILE, F.col("parent").alias("node"), F.when(F.col("field") == "left", 0).otherwise(F.col("pos") + 1).alias("side"))
    found = tests.join(sides, [*FILE, "node"]).where("side = at or side = at + 1").select(*FILE, F.col("node").alias("at"), "line", F.col("line").alias("end"))
    return found.distinct()


def mutable_default(facts: Facts) -> DataFrame:
    """Containers made once as a default and then grown by the body, which neither rebinds the name nor reads it as a state."""
    n = facts.nodes
    fns = n.where("kind in ('FunctionDef', 'AsyncFunctionDef')").select(*FILE, F.col("node").alias("fn"))
    held = fns.join(facts.child.withColumnRenamed("parent", "fn"), [*FILE, "fn"]).groupBy(*FILE, "fn")
    body = F.when(F.col("field") == "body", F.col("c_node")), F.when(F.col("field") == "body", F.col("c_last"))
    fns = held.agg(F.max(F.when(F.col("field") == "args", F.col("c_node"))).alias("parent"), F.min(body[0]).alias("from"), F.max(body[1]).alias("to"))
    args = facts.child.where("field in ('posonlyargs', 'args', 'kwonlyargs') and c_kind = 'arg'")
    counts = facts.child.where("field in ('posonlyargs', 'args', 'defaults')").groupBy(*FILE, "parent").agg(F.count_if((F.col("field") != "defaults") & (F.col("c_kind") == "arg")).alias("n_pos"), F.count_if(F.col("field") == "posonlyargs").alias("n_only"), F.count_if(F.col("field") == "defaults").alias("n_def"))
    args = args.join(counts, [*FILE, "parent"], "left").select(*FILE, "parent", (F.col("field") == "kwonlyargs").alias("kw"), F.when(F.col("field") == "args", F.col("pos") + F.col("n_only")).otherwise(F.col("pos")).alias("place"), F.col("c_name").alias("name"))
    made = n.where("field in ('defaults', 'kw_defaults')").select(*FILE, "parent", "field", "pos", "kind", "node", "line")
    empty = facts.calls.where("fn in ('list', 'dict', 'set') and n_args = 0 and n_keys = 0").join(facts.bound.withColumnRenamed("name", "fn"), [*FILE, "fn"], "left_anti").select(*FILE, "node", F.lit(True).alias("empty"))
    made = made.join(empty, [*FILE, "node"], "left").where(F.col("kind").isin("List", "Dict", "Set", "ListComp", "DictComp", "SetComp") | F.col("empty")).join(counts, [*FILE, "parent"], "left")
    made = made.select(*FILE, "parent", (F.col("field") == "kw_defaults").alias("kw"), F.when(F.col("field") == "defaults", F.col("n_pos") - F.col("n_def") + F.col("pos")).otherwise(F.col("pos")).alias("place"), F.col("node").alias("at"), "line")
    rows = made.join(args, [*FILE, "parent", "kw", "place"]).join(fns, [*FILE, "parent"]).select(*FILE, F.col("fn").alias("scope"), "name", "at", "line", "from", "to")
    added = n.where("kind = 'AugAssign'").select(*FILE, F.col("node").alias("parent"), F.lit(True).alias("added"))
    stores = n.where("kind = 'Name' and ctx = 'Store'").join(added, [*FILE, "parent"], "left").select(*FILE, "scope", "name", "node", "line", (F.coalesce("added", F.lit(False)) & (F.col("field") == "target")).alias("added"))
    rebound = stores.where("not added").select(*FILE, "scope", "name", "node")
    outer = n.where("kind in ('Global', 'Nonlocal')").select(*FILE, "scope", F.explode(F.split("name", ",")).alias("name"), "node")
    asked = n.where("kind = 'Compare'").where(F.exists(F.split("value", ","), lambda o: o.isin("In", "NotIn"))).select(*FILE, "scope", "node")
    members = facts.child.where("field = 'comparators' and c_kind = 'Name'").select(*FILE, F.col("parent").alias("node"), F.col("c_name").alias("name"))
    state = asked.join(members, [*FILE, "node"]).select(*FILE, "scope", "name", "node")
    state = state.union(facts.items.where("ctx = 'Load'").select(*FILE, "scope", F.col("seq").alias("name"), "node")).union(facts.calls.where("method = 'get'").select(*FILE, "scope", F.col("owner").alias("name"), "node"))
    rows = facts.without(rows, rebound.union(outer).union(state), ["scope", "name"], "node")
    grown = facts.calls.where(F.col("method").isin(MUTATORS)).select(*FILE, "scope", F.col("owner").alias("name"), "node", F.col("line").alias("grown"))
    grown = by_merge(grown.union(stores.where("added").select(*FILE, "scope", "name", "node", "line")))
    both = rows.join(grown, [*FILE, "scope", "name"]).where(F.col("node").between(F.col("from"), F.col("to")))
    return both.groupBy(*FILE, "at", "line").agg(F.min("grown").alias("end"))


def syntax_error(facts: Facts) -> DataFrame:
    return facts.nodes.where("kind = 'Error'").select(*FILE, F.col("node").alias("at"), "line", F.col("line").alias("end"))


#: Rules on modules by name: functions of the facts to (project_id, path, at, line, end).
RULES = {"PY_INDEX_PAST_END": past_end, "PY_SKIPS_FIRST_ITEM": skips_first, "PY_IS_LITERAL": is_literal, "PY_MUTABLE_DEFAULT": mutable_default, "PY_SYNTAX_ERROR": syntax_error}
LOOP_RULES = ["PY_INDEX_PAST_END", "PY_SKIPS_FIRST_ITEM"]


def module_hits(nodes: DataFrame, rules: dict | None = None) -> DataFrame:
    """(project_id, path, rule, line, end): the first hits of the rules in each file; line and end are the lines to look at."""
    facts = Facts(nodes)
    found = [rule(facts).select(*FILE, F.lit(name).alias("rule"), "at", F.least("line", "end").alias("line"), F.greatest("line", "end").alias("end")) for name, rule in (rules or RULES).items()]
    hits = reduce(DataFrame.unionByName, found)
    group = F.when(F.col("rule").isin(LOOP_RULES), "loops").otherwise(F.col("rule"))
    place = F.row_number().over(Window.partitionBy(*FILE, group).orderBy("at", "rule"))
    return hits.withColumn("place", place).where(F.col("place") <= F.when(group == "loops", MOST_LOOP_HITS).otherwise(MOST_HITS)).select(*FILE, "rule", "line", "end")


def strength(rule: Column) -> Column:
    return F.when(rule == "PY_SKIPS_FIRST_ITEM", "worth_checking").otherwise("problem")
