"""Personal data by weak supervision, with DataFrame functions only.

Base spans (fixed patterns) and looser candidate shapes are found in every whole text. Labelers vote on each
candidate: a strict-shape regex, a gazetteer, words of context before it, and its neighbourhood. Expectation-
maximisation over the counts of vote patterns (a table of a few hundred rows, whatever the corpus) estimates how
reliable each labeler is and how likely each candidate is personal data. These posteriors train the final span
classifier, a naive Bayes model over features of the span. Candidates it accepts are added; base spans always stay.

Edge cases: null text is empty; a text without spans has the hash of the empty string; candidates that overlap base
spans are not added; repeated rows are scored row by row; extra columns, whatever their names, are left out; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import read, written
from codeloom.llm.spans import SPAN, Kind, all_spans, apart, count_of, digits, has, joined, like

#: A run of these characters is tried at its first one, or where the last match ended: a later start can only fail as the first did.
FIRST = r"(?:(?<![{0}])|\G)"
OCTET = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
BASE = [
    Kind("email", FIRST.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", has("@")),
    Kind("ip", FIRST.format("0-9") + r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)", like(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(OCTET))),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", like(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda m: F.char_length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m))),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", has("+"), lambda m: F.char_length(digits(m)).between(9, 15)),
]

#: Titles before a name, in the four languages of the gazetteer.
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora"]
#: Given names of the gazetteer.
NAMES = ["Ana", "Anna", "Carlos", "Claire", "David", "Elena", "Hans", "James", "Jean", "John", "José", "Julia", "Karl", "Laura", "Luis", "Marie", "Maria", "María", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sophie", "Thomas"]
#: Mail domains' last parts of the gazetteer.
DOMAINS = ["com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "net", "org", "uk"]
#: Countries that issue account numbers of this shape.
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "ES", "FR", "GB", "IE", "IT", "LU", "NL", "PL", "PT", "SE"]
#: Words that announce personal data.
CONTEXT = ["account", "address", "appel", "call", "card", "carte", "contact", "correo", "dear", "email", "iban", "kontakt", "mail", "mobile", "name", "nombre", "nom", "phone", "ssn", "tarjeta", "tel", "teléfono", "telefon"]
#: Words before numbers that are not personal data.
NEGATIVE = ["page", "version", "isbn", "figure", "section", "chapter", "line", "order", "ref", "id"]

SURNAME = r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}"
MORE = [
    Kind("masked_email", FIRST.format("A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]{2,}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]++)++", like(r"\(at\)|\[at\]|\{at\}")),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])", like(r"[0-9]{3}\)?[-.\x20][0-9]{3}[-.\x20][0-9]{4}")),
    Kind("id_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", like(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", like(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")),
    Kind("person", r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.?\x20" + SURNAME, like(r"(?<!\p{L})(?:" + "|".join(TITLES) + r")\.?\x20\p{Lu}")),
]
#: The final classifier adds a candidate from this posterior on.
ACCEPT = 0.5
EM_ROUNDS = 8
VOTES = ["shape", "gazetteer", "context", "around"]
FEATURES = ["f_kind", "f_length", "f_digits", "f_distinct", "f_before"]
#: Code points before and after a candidate that the labelers see.
AROUND = (40, 8)


@dataclass(frozen=True)
class Labels:
    """What EM has found: share of personal data, and for each labeler P(vote | personal) and P(vote | not)."""

    prior: float
    yes: dict[str, tuple[float, float, float]]
    no: dict[str, tuple[float, float, float]]


def found(docs: DataFrame, *keep: Column) -> DataFrame:
    """(*keep, all) of each row of docs: the base spans and the candidates that touch none, with what stands around them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*keep, all_spans(text, BASE, 0, AROUND).alias("base"), all_spans(text, MORE, len(BASE), AROUND).alias("more"))
    return rows.select(*[c for c in rows.columns if c not in ("base", "more")], F.concat("base", apart(F.col("more"), F.col("base"))).alias("all"))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def any_of(words: list[str]) -> str:
    return r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{Ll})"


def votes(s: Column) -> dict[str, Column]:
    """1: personal data, -1: not, 0: no opinion."""
    value, n = s["value"], F.char_length(digits(s["value"]))
    kind = s["kind"]
    good_shape = (
        (kind.isin("email", "masked_email") & value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+ (\[{}\])@-]*[A-Za-z]{2,}$"))
        | (kind == "ip") | (kind == "card") | (kind.isin("phone", "local_phone") & n.between(9, 15)) | (kind == "iban") & (F.char_length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34)) | (kind == "person")
        | ((kind == "id_number") & ~value.rlike("^(000|666|9)"))
    )
    bad_shape = value.rlike(r"^(?:0|1234|9{4})") | ((n > 0) & (distinct_digits(value) <= 2))
    listed = (
        value.rlike(r"(?:\.|dot[)\]}]\x20?)(?:" + "|".join(DOMAINS) + ")$") | (kind.isin("person") & value.rlike(any_of(NAMES))) | (kind.isin("iban") & F.substring(value, 1, 2).isin(IBAN_COUNTRIES))
        | (kind.isin("phone") & value.rlike(r"^\+(?:1|33|34|44|49)(?![0-9])")) | (kind.isin("card") & value.rlike("^(?:3[47]|4|5[1-5]|6)"))
    )
    unlisted = kind.isin("iban") & ~F.substring(value, 1, 2).isin(IBAN_COUNTRIES)
    around_bad = s["after"].rlike(r"^[A-Za-z0-9]") | s["before"].rlike(r"[A-Za-z0-9]$")
    return {
        "shape": vote(good_shape & ~bad_shape, bad_shape),
        "gazetteer": vote(listed, unlisted),
        "context": vote(s["before"].rlike(any_of(CONTEXT)), s["before"].rlike(any_of(NEGATIVE) + r"\W*$")),
        "around": vote(s["after"].rlike(r"^(?:[\s.,;:!?)]|$)") & s["before"].rlike(r"(?:[\s(:=]|^)$"), around_bad),
    }


def distinct_digits(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(digits(value), "")))


def sort_of(character: Column) -> Column:
    """One of a few sorts of characters."""
    return (
        F.when(character == "", "none").when(character.isin(":", "=", "("), "opens").when(character.isin(".", "!", "?", ";", ","), "ends").when(character.rlike(r"\p{N}"), "digit").when(character.rlike(r"\p{L}"), "letter").otherwise("other")
    )


def features(s: Column) -> dict[str, Column]:
    n = F.char_length(s["value"])
    return {
        "f_kind": s["kind"],
        "f_length": F.least(F.floor(n / 4), F.lit(12)).cast("string"),
        "f_digits": F.floor(F.char_length(digits(s["value"])) * 4 / F.greatest(n, F.lit(1))).cast("string"),
        "f_distinct": F.least(distinct_digits(s["value"]), F.lit(9)).cast("string"),
        "f_before": sort_of(F.regexp_extract(s["before"], r"(\S?)\s*$", 1)),
    }


def product(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, parts)


def posterior(labels: Labels) -> Column:
    """P(personal data | votes)."""
    by = lambda table, v: F.when(F.col(v) == 1, table[v][2]).when(F.col(v) == -1, table[v][0]).otherwise(table[v][1])
    yes = product([F.lit(labels.prior), *[by(labels.yes, v) for v in VOTES]])
    no = product([F.lit(1 - labels.prior), *[by(labels.no, v) for v in VOTES]])
    return yes / (yes + no)


def estimate(patterns: DataFrame, rounds: int = EM_ROUNDS) -> Labels:
    """EM over rows (votes, n). It starts from labelers that are right in most cases."""
    labels = Labels(0.7, {v: (0.1, 0.3, 0.6) for v in VOTES}, {v: (0.5, 0.3, 0.2) for v in VOTES})
    for _ in range(rounds):
        p = posterior(labels)
        sums = [F.sum(F.col("n") * p).alias("t"), F.sum(F.col("n")).alias("all")]
        sums += [F.sum(F.when(F.col(v) == x, F.col("n") * w).otherwise(0.0)).alias(f"{v}_{x + 1}_{side}") for v in VOTES for x in (-1, 0, 1) for side, w in (("y", p), ("n", 1 - p))]
        r = patterns.agg(*sums).first()
        if not r["all"]:
            return labels
        yes = {v: tuple((r[f"{v}_{x}_y"] + 1) / (r["t"] + 3) for x in range(3)) for v in VOTES}
        no = {v: tuple((r[f"{v}_{x}_n"] + 1) / (r["all"] - r["t"] + 3) for x in range(3)) for v in VOTES}
        labels = Labels((r["t"] + 1) / (r["all"] + 2), yes, no)
    return labels


def classifier(patterns: DataFrame, labels: Labels) -> Column:
    """Log-odds of a row with FEATURES, from naive Bayes with the posteriors of rows (votes, features, n) as soft labels."""
    soft = patterns.withColumn("p", posterior(labels))
    rows = soft.select("n", "p", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
    sums = rows.groupBy("x.f", "x.v").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()  # five features of at most 13 values each
    total = {f: (sum(r["yes"] for r in sums if r["f"] == f), sum(r["no"] for r in sums if r["f"] == f), sum(r["f"] == f for r in sums)) for f in FEATURES}
    odds = {f: {} for f in FEATURES}
    for r in sums:
        y, n, k = total[r["f"]]
        odds[r["f"]][r["v"]] = math.log((r["yes"] + 1) / (y + k)) - math.log((r["no"] + 1) / (n + k))
    parts = [F.lit(math.log(labels.prior / (1 - labels.prior)))]
    for f in FEATURES:
        if odds[f]:
            table = F.create_map(*[F.lit(x) for kv in sorted(odds[f].items()) for x in kv])
            parts.append(F.coalesce(F.element_at(table, F.col(f)), F.lit(0.0)))
    return reduce(lambda a, b: a + b, parts)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts and base_sha256 of the base spans, spans (base and added), n_added, for each row."""
    rows = written(found(docs, F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id")), "pii")
    one = rows.where(F.size("all") > 0).select("uid", F.explode("all").alias("s"))
    one = one.select("uid", "s", *[c.alias(k) for k, c in {**votes(F.col("s")), **features(F.col("s"))}.items()])
    # EM and the classifier read counts of vote and feature patterns, which are few whatever the corpus
    patterns = written(one.groupBy(*VOTES, *FEATURES).agg(F.count("*").alias("n")), "votes")
    labels = estimate(patterns.groupBy(*VOTES).agg(F.sum("n").alias("n")))
    odds = classifier(patterns, labels)
    plain = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "end", "kind", "value")])
    added = one.where((F.col("s.rank") >= len(BASE)) & (odds >= math.log(ACCEPT / (1 - ACCEPT)))).groupBy("uid").agg(F.collect_list(plain(F.col("s"))).alias("added"))
    base = F.transform(F.filter("all", lambda s: s["rank"] < len(BASE)), plain)
    told = rows.join(added, "uid", "left").select("doc_id", base.alias("base"), "added")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return told.select(
        "doc_id", *[count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
