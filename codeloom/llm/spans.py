"""Positions of all matches of a pattern, as column expressions.

A span is a struct (start, rank, end, kind, value): code points, end exclusive; rank orders kinds at one start.
The text is split at marks put around each match, so positions are running sums of lengths. A mark that occurs
in a text is first replaced by another noncharacter, which keeps all positions. A text with many matches is worked on
in stretches of `STRETCH` parts, so that no array grows by one element at a time over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\uffff", "\ufffe"
#: Parts of a text (every other one is a match) that one fold works on; even.
STRETCH = 512
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
SPAN_AROUND = SPAN[:-1] + ",before:string,after:string>"


@dataclass(frozen=True)
class Kind:
    """gate: cheap test of the whole text that every match implies. valid: test of a match. value: part of a match."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None = None
    value: Callable[[Column], Column] | None = None


def has(part: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(text, F.lit(part))


def like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def none(around: bool = False) -> Column:
    return F.array().cast(f"array<{SPAN_AROUND if around else SPAN}>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def spans_of(text: Column, kind: Kind, rank: int, around: tuple[int, int] | None = None) -> Column:
    """All spans of one kind, in order. around: with up to so many code points before (back to the match before) and after each."""
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), kind.pattern, f"{MARK}$0{MARK}")
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.char_length(x["part"]))
    kept = none(around is not None)

    def take(acc: Column, x: Column) -> Column:
        part = x["part"]
        end = acc["at"] + F.char_length(part)
        more = [F.lower(F.right(x["before"], F.lit(around[0]))).alias("before"), F.left(x["after"], F.lit(around[1])).alias("after")] if around else []
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), (kind.value(part) if kind.value else part).alias("value"), *more)
        ok = acc["hit"] & (F.coalesce(kind.valid(part), F.lit(False)) if kind.valid else F.lit(True))
        return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), F.when(ok, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def fold(parts: Column, at: Column) -> Column:
        return F.aggregate(parts, F.struct(at.alias("at"), F.lit(False).alias("hit"), kept.alias("found")), take, lambda acc: acc["found"])

    def stretches(parts: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(STRETCH)), lambda i: F.slice(parts, i, F.lit(STRETCH)))
        first = F.array(F.lit(0))
        ends = lambda c: F.aggregate(F.transform(c, length), first, lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return let(cut, lambda c: let(ends(c), lambda e: F.flatten(F.transform(c, lambda x, i: fold(x, F.get(e, i))))))

    def with_sides(parts: Column) -> Column:
        near = lambda i: [F.when(i % 2 == 1, F.get(parts, i - 1)).alias("before"), F.when(i % 2 == 1, F.get(parts, i + 1)).alias("after")] if around else []
        return F.transform(parts, lambda x, i: F.struct(x.alias("part"), *near(i)))

    found = let(F.split(marked, MARK, -1), lambda parts: let(with_sides(parts), lambda x: F.when(F.size(x) <= STRETCH, fold(x, F.lit(0))).otherwise(stretches(x))))
    return F.when(kind.gate(text), found).otherwise(kept)


def all_spans(text: Column, kinds: list[Kind], first_rank: int = 0, around: tuple[int, int] | None = None) -> Column:
    """Spans of all kinds, by start, then in the order of the kinds."""
    return F.array_sort(F.concat(*[spans_of(text, k, first_rank + i, around) for i, k in enumerate(kinds)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: Column, base: Column) -> Column:
    """Spans that touch none of base."""
    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(F.filter(spans, lambda s: ~F.exists(base, lambda b: overlaps(s, b))))


def replaced(by: str) -> Callable[[Column, Column], Column]:
    """A column function of (text, spans sorted by start): text with the spans replaced; spans that overlap are replaced as one.
    A null text is null, and what needs no change is best given as null, so that it does not travel."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, places in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for s in places or []:
                if s["start"] >= at:
                    parts += [text[at : s["start"]], by]
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return cut
