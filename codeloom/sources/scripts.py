"""Scripts as tables of tokens, and what joins and windows over these tokens say about a file.

A small scanner turns each text into token rows inside `mapInArrow`; it follows templates with substitutions in them to any depth and tells
a pattern from a division by the token before it, and notes each bracket's depth and partner, the bracket around each token and the tokens
beside it. Rules, declarations and dotted names are joins and windows of these rows. A file is one row of the sources and at most
`too_large` bytes long, so it is never an unbounded group.

Edge cases: a null text has no tokens; an unclosed string ends with its line, an unclosed comment or template with the file; files
whose brackets do not pair up keep their tokens, but have no hits (`balanced` is false).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.session import by_merge, dealt, written

FILE = ["project_id", "path"]
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Columns of the tokens beside one: whose column, and how far away.
BESIDE = {"p1": ("shape", -1), "p2": ("shape", -2), "t1": ("shape", 1), "t2": ("shape", 2), "t3": ("shape", 3), "v1": ("token", -1), "v2": ("token", -2), "w1": ("token", 1), "w2": ("token", 2)}
TOKENS = pa.schema(
    [("project_id", pa.string()), ("path", pa.string()), ("at", pa.int32()), ("line", pa.int32()), ("shape", pa.string()), ("token", pa.string())]
    + [(c, pa.int32()) for c in ("depth", "around", "partner", "after")] + [(c, pa.string()) for c in BESIDE] + [("balanced", pa.bool_())]
)
#: Words after which a slash begins a pattern (fixed values).
BEFORE_PATTERN = frozenset(["return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await"])
#: Candidate loops of a file that a rule looks at, hits of a rule in a file, and names of constants (fixed values).
MOST_CANDIDATES, MOST_HITS = 300, 5
CONSTANTS = ["true", "false", "null", "undefined"]
#: Words that stand before a bracket and are no method (fixed values).
NO_METHOD = ["if", "for", "while", "switch", "catch", "function", "return", "with", "super"]
STRING = r"\"(?:\\[\s\S]|[^\"\\\n])*\"?|'(?:\\[\s\S]|[^'\\\n])*'?"
COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
LEX = re.compile(
    rf"(?P<blank>(?:[\s﻿]|{COMMENT})+)|(?P<string>{STRING})|(?P<name>(?:[^\W\d]|\$)[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<tick>`)|(?P<slash>/)"
    r"|(?P<mark>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*%&|^]=|[\s\S])"
)
PATTERN = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[^\W\d_]*")
WORDS = re.compile(r"(?:[^`\\$]+|\\[\s\S]|\$(?!\{))*")
#: What has neither templates nor slashes of its own, and the parts of it.
PLAIN = re.compile(rf"(?:[^`/'\"]+|{STRING}|{COMMENT})*+")
FIND = re.compile(rf"{COMMENT}|{STRING}|(?:[^\W\d]|\$)[\w$]*|\.?\d[\w.]*|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|[-+*%&|^]=|\n|[^\s﻿]")
INSIDE = re.compile(rf"{STRING}|{COMMENT}|[^{{}}`'\"/]+|[\s\S]")
SHAPES = {"string": '"', "name": "i", "number": "0"}
#: Parts of scripts, comments and line breaks with them, that are placed together, and tokens of one batch on their way back.
BATCH = 50_000
#: Parts whose kind a process remembers.
FEW_KINDS = 50_000


def template_end(text: str, at: int) -> int:
    """Where the template that opens before `at` ends. modes: 0 in a template's words, in a substitution the number of its open braces."""
    modes = [0]
    while at < len(text):
        if not modes[-1]:
            at = WORDS.match(text, at).end()
            if text.startswith("${", at):
                modes.append(1)
                at += 2
                continue
            at += 1
            modes.pop()
            if not modes:
                return min(at, len(text))
            continue
        part = INSIDE.match(text, at)
        at = part.end()
        if part.group() == "`":
            modes.append(0)
        modes[-1] += (part.group() == "{") - (part.group() == "}")
        if part.group() == "}" and not modes[-1]:
            modes.pop()
    return len(text)


def cut(text: str) -> list[str]:
    """What a script is made of, but for blanks: tokens, templates and patterns whole, comments, line breaks. Between templates and slashes, which
    need the token before them, one call of `FIND` finds all."""
    at, parts = 0, []
    while at < len(text):
        end = PLAIN.match(text, at).end()
        parts += FIND.findall(text, at, end)
        if end == len(text):
            break
        at = end + 1
        if text[end] == "`":
            at = template_end(text, at)
        else:
            back = len(parts) - 1
            while back >= 0 and KINDS[parts[back]][0]:
                back -= 1
            _, _, shape, token = KINDS[parts[back]] if back >= 0 else (False, 0, "", "")
            free = shape not in (")", "]", "}", '"', "`", "/re/", "0") and (shape != "i" or token in BEFORE_PATTERN)
            if free and (p := PATTERN.match(text, end)):
                at = p.end()
        parts.append(text[end:at])
    return parts


class Kinds(dict):
    """Of a part of a script: whether it is left out, its line breaks, shape and token. Short parts are remembered."""

    def __missing__(self, part: str) -> tuple[bool, int, str, str]:
        kind = LEX.match(part).lastgroup
        shape = SHAPES.get(kind, "`" if kind == "tick" else "/re/" if kind == "slash" and len(part) > 1 else part)
        found = kind == "blank", part.count("\n"), shape, part[0] if kind in ("tick", "slash") else part
        if len(part) <= 8 and len(self) < FEW_KINDS:
            self[part] = found
        return found


KINDS = Kinds()


def scanned(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, shape, token) of a script. The shape is the token itself for marks, else a letter or sign for its kind; templates and
    patterns come without their content."""
    line = 1
    for out, breaks, shape, token in map(KINDS.__getitem__, cut(text)):
        if not out:
            yield line, shape, token
        line += breaks


class Placed:
    """Tokens of several files, one after the other, as columns: whose (the file's number), at (from 1 on in each file), line, depth, around, partner,
    after (see `script_tokens`; 0 for none), and which kind of token each is, an index of shapes and tokens."""

    def __init__(self, files: list[list[str]]):
        parts = pa.array([part for file in files for part in file], pa.string()).dictionary_encode()
        kinds = [KINDS[part] for part in parts.dictionary.to_pylist()]
        out, breaks = np.array([k[0] for k in kinds], bool), np.array([k[1] for k in kinds], np.int64)
        self.shapes, self.tokens = [k[2] for k in kinds], [k[3] for k in kinds]
        kind = parts.indices.to_numpy()
        whose = np.repeat(np.arange(len(files)), [len(file) for file in files])
        lines = np.cumsum(breaks[kind]) - breaks[kind]
        lines += 1 - lines[np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]])[np.cumsum(np.r_[False, whose[1:] != whose[:-1]])]] if len(whose) else 0
        stay = ~out[kind]
        self.kind, self.whose, self.line, n = kind[stay], whose[stay], lines[stay], int(stay.sum())
        self.count = np.bincount(self.whose, minlength=len(files))
        self.begin = np.cumsum(self.count) - self.count
        self.place = np.arange(n)
        self.at = self.place - self.begin[self.whose] + 1
        opens, closes = self.shape(*PAIRS), self.shape(*PAIRS.values())
        level = np.cumsum(opens.astype(np.int64) - closes)
        level -= np.r_[0, level][self.begin[self.whose]]
        self.depth = level - opens
        low = int(self.depth.min(initial=0))
        span = int(self.depth.max(initial=0)) - low + 2
        key = lambda depth, place: ((self.whose[place] * span + depth - low) * (n + 1)) + place
        # around: the last bracket that opened one level further out
        opened = np.flatnonzero(opens)
        inner = np.sort(key(self.depth[opened] + 1, opened))
        own = key(self.depth, self.place)
        found = np.r_[0, inner][np.searchsorted(inner, own)]  # in the file's level, or before all of it
        self.around = np.where((found > 0) & (found // (n + 1) == own // (n + 1)), np.r_[self.at, 0][found % (n + 1)], 0)
        # partner: the bracket before it at the same depth, if that one opens
        marks = np.flatnonzero(opens | closes)
        marks = marks[np.argsort(key(self.depth[marks], marks))]
        first, second = marks[:-1], marks[1:]
        pair = opens[first] & closes[second] & (self.depth[first] == self.depth[second]) & (self.whose[first] == self.whose[second])
        first, second = first[pair], second[pair]
        self.partner = np.zeros(n, np.int64)
        self.partner[first], self.partner[second] = self.at[second], self.at[first]
        match = np.zeros(n, bool)
        for o, c in PAIRS.items():
            match[second] |= self.shape(o)[first] & self.shape(c)[second]
        wrong = np.bincount(self.whose[closes & ~(match & (self.depth >= 0))], minlength=len(files))
        ends = np.bincount(self.whose, opens.astype(np.int64) - closes, minlength=len(files))
        self.balanced = (wrong == 0) & (ends == 0)
        semicolons = np.flatnonzero(self.shape(";"))
        next_ = np.r_[semicolons, n][np.searchsorted(semicolons, self.place)]
        same = np.r_[self.whose, -1][next_] == self.whose
        self.after = np.where(same, np.r_[self.at, 0][next_], 0)

    def shape(self, *names: str) -> np.ndarray:
        return np.array([s in names for s in self.shapes], bool)[self.kind]

    def token(self, *words: str) -> np.ndarray:
        """Names that are one of the words."""
        return np.array([s == "i" and t in words for s, t in zip(self.shapes, self.tokens, strict=True)], bool)[self.kind]

    def beside(self, told: np.ndarray, step: int) -> np.ndarray:
        """What is told of the token so many places on; false beyond the file."""
        to = np.clip(self.place + step, 0, max(0, len(told) - 1))
        return told[to] & (to == self.place + step) & (self.whose[to] == self.whose)

    def at_place(self, told: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What is told of the file's token number `at`; false for 0."""
        return told[np.where(at > 0, self.begin[self.whose] + at - 1, 0)] & (at > 0) if len(told) else told

    def rows(self, owners: list[tuple], keep: np.ndarray) -> pa.RecordBatch:
        """Rows of `TOKENS`. owners: each file's (project_id, path)."""
        whose, kind, place = self.whose[keep], self.kind[keep], self.place[keep]
        named = {"shape": pa.array(self.shapes, pa.string()), "token": pa.array(self.tokens, pa.string())}
        number = lambda x: pa.array(x[keep].astype(np.int32), mask=x[keep] == 0)
        project, path = (pa.array(c, pa.string()).take(pa.array(whose)) for c in zip(*owners, strict=True))

        def beside(column: str, step: int) -> pa.Array:
            to = np.clip(place + step, 0, max(0, len(self.kind) - 1))
            return named[column].take(pa.array(self.kind[to], mask=(to != place + step) | (self.whose[to] != whose)))

        plain = [pa.array(self.at[keep].astype(np.int32)), pa.array(self.line[keep].astype(np.int32)), *(named[c].take(pa.array(kind)) for c in ("shape", "token")), pa.array(self.depth[keep].astype(np.int32))]
        return pa.RecordBatch.from_arrays([project, path, *plain, *map(number, (self.around, self.partner, self.after)), *(beside(*x) for x in BESIDE.values()), pa.array(self.balanced[whose])], schema=TOKENS)


def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], Placed]]:
    """(project_id, path) of files, and their tokens: about `BATCH` parts at a time."""
    owners, files, held = [], [], 0
    for batch in batches:
        for project, path, text in zip(*(batch.column(c) for c in range(3)), strict=True):
            owners.append((project.as_py(), path.as_py()))
            files.append(cut(text.as_py() or ""))
            held += len(files[-1])
            if held >= BATCH:
                yield owners, Placed(files)
                owners, files, held = [], [], 0
    if owners:
        yield owners, Placed(files)


def token_rows(files: DataFrame, wanted: Callable[[Placed], np.ndarray] | None = None) -> DataFrame:
    """The columns of `script_tokens`, at counting from 1; comments and blanks left out, and tokens that are not `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, p in placed(batches):
            keep = np.flatnonzero(wanted(p)) if wanted else p.place
            for lo in range(0, len(keep), BATCH):
                yield p.rows(owners, keep[lo : lo + BATCH])

    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'int'}" for f in TOKENS)
    return dealt(files.select("project_id", "path", "text"), FILE).mapInArrow(run, schema)


def bracket_rows(files: DataFrame) -> DataFrame:
    """(project_id, path, tokens, deepest, balanced, templates, patterns) of each script that has tokens: of a file's tokens only these sums leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, p in placed(batches):
            some = np.flatnonzero(p.count)
            project, path = (pa.array(c, pa.string()).take(pa.array(some)) for c in zip(*owners, strict=True))
            deepest = np.maximum.reduceat(p.depth, p.begin[some]) if len(some) else some
            templates, patterns = (np.bincount(p.whose[p.shape(s)], minlength=len(owners))[some] for s in ("`", "/re/"))
            yield pa.RecordBatch.from_arrays([project, path, *(pa.array(x.astype(np.int64)) for x in (p.count[some], deepest)), pa.array(p.balanced[some]), pa.array(templates), pa.array(patterns)], names=["project_id", "path", "tokens", "deepest", "balanced", "templates", "patterns"])

    return dealt(files.select("project_id", "path", "text"), FILE).mapInArrow(run, "project_id string, path string, tokens long, deepest long, balanced boolean, templates long, patterns long")


def of_declarations(p: Placed) -> np.ndarray:
    """The tokens that `script_functions` asks for."""
    name, opens = p.shape("i"), p.shape("(")
    free = name & ~p.beside(p.shape("."), -1)
    body = p.beside(p.shape("{"), 1)  # before a body
    classes = free & p.token("class") & p.beside(name, 1)
    said = classes | free & p.token("function") & p.beside(name, 1)
    let = free & p.beside(p.token("const", "let", "var"), -1) & p.beside(p.shape("="), 1)
    given = p.beside(p.shape("="), -1) | p.beside(p.token("async"), -1) & p.beside(p.shape("="), -2)
    closed = p.shape(")") & (p.beside(p.shape("=>"), 1) | body)
    method = opens & p.at_place(p.shape(")") & body, p.partner)
    levels = np.unique(p.whose[classes] << 32 | p.depth[classes] + 2**31)
    braces = p.shape("{") & np.isin(p.whose << 32 | p.depth + 2**31, levels)
    lists = free & p.token("export") & p.beside(p.shape("{"), 1)
    listed = name & p.beside(p.shape("{", ","), -1) & p.at_place(p.beside(lists, -1), p.around)
    return said | let | given | closed & (p.partner > 0) | method | free & p.beside(method, 1) | braces | lists | listed


def of_rules(p: Placed) -> np.ndarray:
    """The tokens that `script_hits` asks for: heads of `for` and `if` and what is directly in them, what follows them, dotted names that are read
    by a name in brackets or name a length, whole, and the words of rules."""
    name, opens, dot, balanced = p.shape("i"), p.shape("("), p.shape("."), p.balanced[p.whose] if len(p.whose) else np.zeros(0, bool)
    words = p.token("for", "if") & ~p.beside(dot, -1) & p.beside(opens, 1) & balanced
    heads = opens & p.beside(words, -1)
    behind = p.beside(p.shape(")"), -1) & p.beside(p.at_place(heads, p.partner), -1)
    read = (name | dot) & p.beside(p.shape("["), 1) & p.beside(name, 2) & p.beside(p.shape("]"), 3)
    starts = np.array([s == "i" and t.startswith("length") for s, t in zip(p.shapes, p.tokens, strict=True)], bool)[p.kind]
    goes_on = dot & p.beside(name, -1) | name & p.beside(dot, -1)
    run = np.cumsum(~goes_on)
    told = read | starts & p.beside(dot, -1)
    asked = np.zeros(len(run) + 1, bool)
    asked[run[told & balanced]] = True
    spoken = p.token("undefined", "NaN")
    return (words | heads | p.at_place(heads, p.around) | behind | (name | dot) & asked[run] | spoken) & balanced


def script_tokens(files: DataFrame, wanted: Callable[[Placed], np.ndarray] | None = None) -> DataFrame:
    """Tokens, or those of them that are `wanted` (`of_declarations`, `of_rules`), with depth (brackets around them), partner (of a bracket: where the other one is), around (where the bracket around them opens),
    p1, p2, t1, t2, t3 (shapes before and after), v1, v2, w1, w2 (words there), after (where the next semicolon is) and balanced (of the file).
    A written table: texts are scanned once, whatever is asked of their tokens; all of this is known where a file is scanned, so tokens
    are neither shuffled nor sorted for it."""
    return by_merge(written(token_rows(files, wanted), "tokens"))


def runs(tokens: DataFrame) -> DataFrame:
    """(project_id, path, name, head, a, z, read): dotted names (`this.items`) from token a to z, and the name in a pair of square brackets behind."""
    goes_on = ((F.col("shape") == ".") & (F.col("p1") == "i")) | ((F.col("shape") == "i") & (F.col("p1") == "."))
    by = Window.partitionBy(*FILE).orderBy("at")
    rows = tokens.withColumn("run", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(by)).where(F.col("shape").isin("i", "."))
    read = F.when((F.col("t1") == "[") & (F.col("t2") == "i") & (F.col("t3") == "]"), F.col("w2"))
    parts = rows.groupBy(*FILE, "run").agg(F.array_sort(F.collect_list(F.struct("at", "token", "line"))).alias("x"), F.max(F.struct("at", read.alias("read"))).alias("z"))
    return parts.select(*FILE, F.array_join(F.transform("x", lambda x: x["token"]), "").alias("name"), F.col("x")[0]["token"].alias("head"), F.col("x")[0]["at"].alias("a"), F.col("x")[0]["line"].alias("line"), F.col("z.at").alias("z"), F.col("z.read").alias("read"))


def heads(tokens: DataFrame, word: str) -> DataFrame:
    """(project_id, path, at, line, close, x): the brackets behind a keyword, with the tokens that stand in them outside further brackets."""
    words = tokens.where((F.col("token") == word) & (F.col("shape") == "i") & (F.coalesce("p1", F.lit("")) != ".") & (F.col("t1") == "(") & F.col("balanced"))
    words = words.select(*FILE, "at", "line", (F.col("at") + 1).alias("around"))
    opened = tokens.where("shape = '('").select(*FILE, F.col("at").alias("around"), F.col("partner").alias("close"))
    inside = tokens.select(*FILE, "around", F.struct(F.col("at").alias("k"), "shape", "token", F.col("line").alias("l")).alias("t"))
    grouped = words.join(opened, [*FILE, "around"]).join(inside, [*FILE, "around"]).groupBy(*FILE, "at", "line", "close")
    return grouped.agg(F.array_sort(F.collect_list("t")).alias("x"))


def shown(x: Column, field: str = "shape") -> Column:
    return F.array_join(F.transform(x, lambda t: t[field]), "")


def first_hits(hits: DataFrame, rule: str, most: int = MOST_HITS) -> DataFrame:
    """(project_id, path, rule, line, end): a file's first hits; line and end are the lines to look at."""
    place = F.row_number().over(Window.partitionBy(*FILE).orderBy("at"))
    return hits.withColumn("place", place).where(F.col("place") <= most).select(*FILE, F.lit(rule).alias("rule"), F.least("line", "end").alias("line"), F.greatest("line", "end").alias("end"))


def past_end(tokens: DataFrame) -> DataFrame:
    """Loops `for (i = ...; i <= x.length; i++)` that read x[i] in a body which mentions neither undefined nor x.length."""
    marks = lambda x: F.filter(x, lambda t: t["shape"] == ";")
    h = heads(tokens, "for").where(F.size(marks(F.col("x"))) == 2).withColumn("m", F.transform(marks(F.col("x")), lambda t: t["k"]))
    part = lambda lo, hi: F.filter("x", lambda t: (t["k"] > lo) & (t["k"] < hi))
    mark = lambda k: F.get("m", F.lit(k))
    h = h.withColumns({"init": part(F.lit(0), mark(0)), "test": part(mark(0), mark(1)), "step": part(mark(1), F.lit(2**31 - 1))})
    h = h.withColumn("init", F.when(F.get("init", F.lit(0))["token"].isin("let", "var", "const"), F.slice("init", F.lit(2), F.size("init"))).otherwise(F.col("init")))
    i = F.get("init", F.lit(0))["token"]
    n = F.size("test")
    fits = (F.size("init") >= 3) & F.startswith(shown(F.col("init")), F.lit("i=")) & (F.get("test", F.lit(0))["token"] == i) & shown(F.col("test")).rlike(r"^i<=i(\.i)*\.i$") & (F.get("test", n - 1)["token"] == "length")
    stepped = (shown(F.col("step"), "token") == F.concat(i, F.lit("++"))) | (shown(F.col("step"), "token") == F.concat(F.lit("++"), i)) | (shown(F.col("step"), "token") == F.concat(i, F.lit("+=1")))
    h = h.where(fits & stepped & (F.size("step") > 0)).select(*FILE, "at", "line", "close", i.alias("i"), shown(F.slice("test", F.lit(3), n - 4), "token").alias("seq"))
    place = F.row_number().over(Window.partitionBy(*FILE).orderBy("at"))
    h = h.withColumn("place", place).where(F.col("place") <= MOST_CANDIDATES)
    body = tokens.select(*FILE, (F.col("at") - 1).alias("close"), F.when(F.col("shape") == "{", F.col("partner")).otherwise(F.coalesce("after", F.lit(2**31 - 1))).alias("to"))
    h = h.join(body, [*FILE, "close"]).withColumn("head", F.substring_index("seq", ".", 1))
    inside = lambda at: (F.col(at) > F.col("close")) & (F.col(at) < F.col("to"))
    named = runs(tokens)
    reads = named.where("read is not null").select(*FILE, F.col("name").alias("seq"), F.col("read").alias("i"), "a", F.col("line").alias("end"))
    hits = h.join(reads, [*FILE, "seq", "i"]).where(inside("a")).groupBy(*FILE, "at", "line", "close", "to", "seq", "head").agg(F.min(F.struct("a", "end")).alias("r"))
    hits = hits.select(*FILE, "at", "line", "close", "to", "seq", "head", F.col("r.end").alias("end"))
    nothing = tokens.where("token = 'undefined' and shape = 'i'").select(*[F.col(c).alias(f"_{c}") for c in FILE], F.col("at").alias("a"))
    same = [F.col(c) == F.col(f"_{c}") for c in FILE]
    hits = hits.join(nothing, [*same, inside("a")], "left_anti")
    lengths = named.where(F.contains("name", F.lit(".length"))).select(*[F.col(c).alias(f"_{c}") for c in FILE], F.col("head").alias("_head"), F.concat("name", F.lit(".")).alias("whole"), "a")
    return hits.join(lengths, [*same, F.col("head") == F.col("_head"), inside("a"), F.startswith("whole", F.concat("seq", F.lit(".length.")))], "left_anti")


def assigned(tokens: DataFrame) -> DataFrame:
    """Conditions `if (name = constant)`."""
    h = heads(tokens, "if").withColumns({"s": shown(F.col("x")), "last": F.element_at("x", -1)})
    constant = F.col("last.shape").isin("0", '"') | F.col("last.token").isin(CONSTANTS)
    h = h.where(F.col("s").rlike(r'^i(\.i)*=-?[i0"]$') & constant)
    return h.select(*FILE, "at", F.get(F.filter("x", lambda t: t["shape"] == "="), F.lit(0))["l"].alias("line")).withColumn("end", F.col("line"))


def compared(tokens: DataFrame) -> DataFrame:
    """NaN, or Number.NaN, next to an equality."""
    equal = ["==", "===", "!=", "!=="]
    whose = (F.coalesce("p1", F.lit("")) != ".") | ((F.coalesce("p2", F.lit("")) == "i") & (F.col("v2") == "Number"))
    hit = (F.col("shape") == "i") & (F.col("token") == "NaN") & whose & F.col("balanced") & (F.coalesce(F.col("p1").isin(equal), F.lit(False)) | F.coalesce(F.col("t1").isin(equal), F.lit(False)))
    return tokens.where(hit).select(*FILE, "at", "line", F.col("line").alias("end"))


#: Rules on scripts by name: functions of the tokens to (project_id, path, at, line, end).
RULES = {"JS_INDEX_PAST_END": past_end, "JS_ASSIGN_IN_CONDITION": assigned, "JS_NAN_COMPARE": compared}


def script_hits(tokens: DataFrame) -> DataFrame:
    """(project_id, path, rule, line, end): the first hits of each rule in each file."""
    tokens = tokens.where(~F.lower("path").rlike(r"\.[jt]sx$"))
    found = [first_hits(rule(tokens), name) for name, rule in RULES.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def unquoted(token: Column) -> Column:
    return F.substring(token, 2, F.char_length(token) - 2)


def script_refs(tokens: DataFrame) -> DataFrame:
    """(project_id, path, kind, specifier, line): import, re-export, dynamic import and require."""
    t = tokens.where((F.col("shape") == "i") & (F.coalesce("p1", F.lit("")) != "."))
    ref = lambda rows, kind, word: rows.select(*FILE, kind.alias("kind"), unquoted(F.col(word)).alias("specifier"), "line")
    static = ref(t.where(F.col("token").isin("from", "import") & (F.col("t1") == '"')), F.lit("import"), "w1")
    called = t.where(F.col("token").isin("require", "import") & (F.col("t1") == "(") & (F.col("t2") == '"'))
    return static.union(ref(called, F.when(F.col("token") == "require", "require").otherwise("dynamic_import"), "w2"))


def script_functions(tokens: DataFrame) -> DataFrame:
    """(project_id, path, name, kind, line, exported): functions and classes by name, functions and arrows that a name is declared with, and
    the methods of classes (`Class.method`). A name of `export { ... }` is exported too."""
    none = F.lit("")
    t = tokens.where((F.col("shape") == "i") & (F.coalesce("p1", none) != "."))
    said = t.where(F.col("token").isin("function", "class") & (F.col("t1") == "i"))
    shown_out = (F.col("v1") == "export") | (F.col("v1").isin("async", "default") & (F.col("v2") == "export"))
    kind = F.when(F.col("v1") == "async", "async_function").otherwise(F.col("token"))
    named = said.select(*FILE, F.col("w1").alias("name"), kind.alias("kind"), "line", F.coalesce(shown_out, F.lit(False)).alias("exported"))
    # const name = (a, b) => ..., = a => ..., = async ..., = function ...
    let = t.where(F.col("v1").isin("const", "let", "var") & (F.col("t1") == "="))
    let = let.select(*FILE, F.col("token").alias("name"), "line", F.coalesce(F.col("v2") == "export", F.lit(False)).alias("exported"), (F.col("at") + 2).alias("at"))
    # only what follows `=`, or `= async`, is asked for, so no other token is shuffled
    given = (F.col("p1") == "=") | ((F.col("v1") == "async") & (F.col("p2") == "="))
    first = tokens.where(given).select(*FILE, "at", "shape", "token", "t1", "partner")
    let = let.join(first, [*FILE, "at"])
    late = (F.col("shape") == "i") & (F.col("token") == "async")
    moved = let.where(late).select(*FILE, "name", "line", "exported", (F.col("at") + 1).alias("at"), F.lit("async_").alias("mode")).join(first, [*FILE, "at"])
    let = let.where(~late).withColumn("mode", none).select(*moved.columns).union(moved)
    closed = tokens.where("shape = ')' and t1 = '=>'").select(*FILE, F.col("at").alias("partner"), F.lit(True).alias("arrow"))
    let = let.join(closed, [*FILE, "partner"], "left")
    what = F.when((F.col("shape") == "i") & (F.col("token") == "function"), "function").when((F.col("t1") == "=>") & (F.col("shape") == "i") | F.coalesce("arrow", F.lit(False)), "arrow")
    arrows = let.withColumn("what", what).where("what is not null").select(*FILE, "name", F.concat("mode", "what").alias("kind"), "line", "exported")
    # methods: names before brackets and a body, directly in a class's braces
    classes = said.where("token = 'class'").select(*FILE, "at", "depth", F.col("w1").alias("class"))
    braces = tokens.where("shape = '{'").select(*FILE, F.col("depth"), F.col("at").alias("around"))
    after = classes.join(braces, [*FILE, "depth"]).where("around > at").groupBy(*FILE, "class", "at").agg(F.min("around").alias("around"))
    ends = tokens.where("shape = ')' and t1 = '{'").select(*FILE, F.col("at").alias("partner"))
    opens = tokens.where("shape = '('").select(*FILE, (F.col("at") - 1).alias("at"), "partner").join(ends, [*FILE, "partner"]).select(*FILE, "at")
    members = t.where((F.col("t1") == "(") & ~F.col("token").isin(NO_METHOD)).select(*FILE, "at", "around", "line", "token", "v1").join(opens, [*FILE, "at"])
    methods = members.join(by_merge(after.select(*FILE, "around", "class")), [*FILE, "around"]).select(*FILE, F.concat_ws(".", "class", "token").alias("name"), F.when(F.col("v1") == "async", "async_method").otherwise("method").alias("kind"), "line", F.lit(False).alias("exported"))
    lists = t.where((F.col("token") == "export") & (F.col("t1") == "{")).select(*FILE, (F.col("at") + 1).alias("around"))
    listed = tokens.where("shape = 'i' and (p1 = '{' or p1 = ',')").join(lists, [*FILE, "around"], "left_semi").select(*FILE, F.col("token").alias("name")).distinct().withColumn("listed", F.lit(True))
    listed = by_merge(listed)
    rows = named.union(arrows).union(methods).join(listed, [*FILE, "name"], "left")
    return rows.select(*FILE, "name", "kind", "line", (F.col("exported") | F.coalesce("listed", F.lit(False))).alias("exported"))
