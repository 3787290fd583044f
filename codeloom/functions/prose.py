"""Column expressions over untrusted prose and pasted code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by the last part of a file name, as the upload form knows them (fixed values).
NAMED = {"py": "python", "js": "javascript", "html": "html", "htm": "html", "css": "css"}
#: Words that are evidence for one language, each use for one point.
PYTHON_WORDS = "False None True def elif except import lambda pass print raise range self".split()
SCRIPT_WORDS = "const console document export function let new null this typeof undefined var window".split()
#: Signs that are evidence too: a line that ends in a colon; an arrow, a statement's end, a triple comparison; a property in braces.
PYTHON_SIGN, SCRIPT_SIGN, STYLE_SIGN = r":[ \t]*(?:\n|$)", r"=>|;[ \t]*(?:\n|$)|===", r"[a-z-]+[ \t]*:[^{}:;\n]*[;}]"
#: What asks a model to do something, and what it is asked about.
ORDER_VERBS = "bypass disregard forget ignore override reveal".split()
ORDER_NOUNS = "guidelines instructions prompt prompts rules".split()


def uses_of(words: Column, known: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(known)))


def evidence(code: Column) -> dict[str, Column]:
    """Points for each language. A text that begins as markup has no other evidence than its tags."""
    words, count = F.regexp_extract_all(code, F.lit("[A-Za-z]+"), F.lit(0)), lambda p: F.regexp_count(code, F.lit(p))
    braces = F.contains(code, F.lit("{"))
    return {
        "python": uses_of(words, PYTHON_WORDS) + count(PYTHON_SIGN),
        "javascript": uses_of(words, SCRIPT_WORDS) + count(SCRIPT_SIGN),
        "css": F.when(braces, count(STYLE_SIGN) + 2 * count(r"@[a-z]+")).otherwise(0),
    }


def sniffed_language(code: Column, name: Column) -> Column:
    """A file name with a dot decides; else a first sign of markup, or the language with the most evidence; null if two have as much."""
    n, text = F.trim(F.coalesce(name, F.lit(""))), F.trim(code)
    table = F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv])
    points = F.array_sort(F.array(*[F.struct((-p).alias("p"), F.lit(lang).alias("lang")) for lang, p in evidence(text).items()]))
    best = F.transform(F.array(points), lambda p: F.when(p[0]["p"] < p[1]["p"], p[0]["lang"]))[0]
    return F.when(F.contains(n, F.lit(".")), F.element_at(table, F.lower(F.element_at(F.split(n, r"\."), -1)))).when(text.rlike("^<[A-Za-z!/]"), "html").otherwise(best)


def defused(text: Column) -> Column:
    """Control sequences of chat templates, broken by a blank."""
    return F.regexp_replace(F.regexp_replace(text, r"<(?=\||/?tool_call>)", "< "), r"(?<=\|)>", " >")


def defused_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"<(?=\||/?tool_call>)")) + F.regexp_count(text, F.lit(r"(?<=\|)>"))).cast("long")


def gives_orders(text: Column, reach: int = 5) -> Column:
    """Whether a verb that orders a model is followed, within a few words, by what models are told to leave."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.transform(F.array(words), lambda w: F.exists(F.transform(w, lambda x, i: x.isin(ORDER_VERBS) & F.exists(F.slice(w, i + 2, F.lit(reach)), lambda y: y.isin(ORDER_NOUNS))), lambda hit: hit))[0]


#: Words that have no everyday meaning to guess them by, and ordinary words that also have a technical one (fixed values).
JARGON = """iterate iterates iterated iterating iteration initialize initializes initialized initializing initialise initialised initialises
initialising initialization parameter parameters argument arguments boolean booleans syntax instantiate instantiates instantiated operator operators
modulo index indexes indices conditional conditionals callback callbacks integer integers array arrays module modules attribute attributes recursion
recursive concatenate concatenation dereference iterable iterator polymorphism closure runtime variable variables function functions method methods
class classes object objects string strings exception exceptions parse parses parsed parsing compile scope dictionary""".split()
EVERYDAY = "list lists loop loops return returns returned returning condition conditions".split()
#: What explains the word before it (fixed values): a bracket, a dash, a colon, or how a definition goes on; blanks and quotes may stand between.
EXPLAINS = r"[\s\"'`)]*(?:\(|\u2014|-|:|,\s*(?:which|a|an|the)\b|\s*(?:means|is a|is an|is like|are)\b)"


def unexplained(text: Column, words: list[str]) -> Column:
    """How often one of words stands in text and nothing right behind it explains it."""
    return F.regexp_count(F.lower(text), F.lit(rf"\b(?:{'|'.join(words)})\b(?!{EXPLAINS})")).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z']+")).cast("long")


def per_hundred(hits: Column, words: Column) -> Column:
    return F.when(words > 0, F.bround(100 * hits / words, 2)).otherwise(0.0)
