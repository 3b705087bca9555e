"""Places of regular-expression matches as DataFrame expressions (code points, end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "array<struct<place:int,value:string>>"
#: Long arrays are folded in blocks: a fold that grows an array copies it at every step.
BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where lambdas inside ``body`` use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def running(values: Column, op) -> Column:
    """The fold of each prefix of an int array by ``op`` (associative, 0 neutral), in blocks."""

    def within(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(op(acc["at"], v))).alias("out"))
        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    def folded(parts: Column) -> Column:
        ends = within(F.transform(parts, lambda part: F.aggregate(part, F.lit(0), op)), F.lit(0))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda part, b: within(part, F.coalesce(F.get(e, b - 1), F.lit(0))))))

    cut = lambda vs: F.transform(_blocks(F.size(vs)), lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))
    return let(values, lambda vs: F.when(F.size(vs) > 0, let(cut(vs), folded)).otherwise(F.array().cast("array<int>")))


def below(items: Column, holds) -> Column:
    """How many items of a sorted array ``holds`` accepts (the first ones, and no later), by halving."""

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        return let(middle, lambda m: F.when(holds(F.get(items, m)), F.struct((m + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), m.alias("hi"))))

    begin = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(F.bin(F.size(items)))), begin, step, lambda acc: acc["lo"])


def matches(text: Column, pattern: str) -> Column:
    """array<struct<place, value>> of the leftmost non-overlapping matches; the text is cut a second time only if any match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        ends = running(F.zip_with(gaps, values, lambda g, v: F.char_length(g) + F.char_length(v)), lambda a, b: a + b)
        pairs = F.zip_with(ends, values, lambda end, v: F.struct((end - F.char_length(v)).alias("place"), v.alias("value")))
        return F.when(F.size(values) > 0, pairs).otherwise(F.array().cast(NONE))

    return let(found, placed)


def replaced(text: Column, spans: Column, word) -> Column:
    """The text with ``word(span)`` for each span; overlapping spans are one, named by the first. ``spans`` are sorted by start, not empty."""

    def piece(cut: Column, begin: Column, before: Column, span: Column) -> Column:
        return F.when(span["start"] >= before, F.concat(F.substring(cut, before - begin + 1, span["start"] - before), word(span))).otherwise(F.lit(""))

    def block(s: Column, reach: Column, b: Column) -> Column:
        begin = F.coalesce(F.get(reach, b * BLOCK - 1), F.lit(0))
        size = F.get(reach, F.least((b + 1) * BLOCK, F.size(s)) - 1) - begin
        return let(F.struct(begin.alias("begin"), F.substring(text, begin + 1, size).alias("cut")), lambda c: F.transform(
            F.slice(s, b * BLOCK + 1, F.lit(BLOCK)), lambda span, i: piece(c["cut"], c["begin"], F.coalesce(F.get(reach, b * BLOCK + i - 1), F.lit(0)), span)))

    def joined(s: Column, reach: Column) -> Column:
        parts = F.flatten(F.transform(_blocks(F.size(s)), lambda b: block(s, reach, b)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(reach, -1) + 1, F.lit(2**31 - 1)))

    return let(spans, lambda s: let(running(F.transform(s, lambda x: x["end"]), larger), lambda reach: joined(s, reach)))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
