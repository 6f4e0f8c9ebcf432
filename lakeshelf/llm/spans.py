"""Pattern matches with code-point spans, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaps_and_matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """The n + 1 pieces between the n leftmost non-overlapping matches, and the matches; their order alternates."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def bound(value: Column, use: "callable") -> Column:
    """use(value) with the value computed once for each row, however often its lambdas name it."""
    return F.transform(F.array(value), use)[0]


def blocks(items: Column) -> Column:
    """A non-empty array as an array of its runs, about as many as their length; items should be bound."""
    width = F.ceil(F.sqrt(F.size(items))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int")), lambda k: F.slice(items, k * width + 1, width))


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start long, end long, value string, part string>> of a pattern's matches; part is the given group.

    Positions are code points, end exclusive. Matches are placed within blocks, and the blocks by their sizes, as an array
    that grows by one match a step would be copied each time.
    """
    gaps, found = gaps_and_matches(text, pattern)
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,part:string>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = (state["at"] + F.char_length(pair["gap"])).cast("long")
        end = (begin + F.char_length(pair["value"])).cast("long")
        new = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"), pair["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(new)).alias("found"))

    def moved(m: Column, by: Column) -> Column:
        return F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"), m["part"].alias("part"))

    def joined(placed: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
        offsets = F.aggregate(placed, zero, lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])
        return F.flatten(F.zip_with(placed, offsets, lambda p, by: F.transform(p["found"], lambda m: moved(m, by))))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value"), parts.alias("part")), lambda p: p["value"].isNotNull())
    placed = bound(pairs, lambda p: bound(F.transform(blocks(p), lambda b: F.aggregate(b, start, step)), joined))
    return F.when(F.size(found) > 0, placed).otherwise(empty)


def replaced(text: Column, pattern: str, new: "callable") -> Column:
    """text with every match m of the pattern as new(m)."""
    gaps, found = gaps_and_matches(text, pattern)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(found, new).alias("value"))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["value"], F.lit("")))), "")
