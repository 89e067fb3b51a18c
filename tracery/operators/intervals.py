"""Points in intervals without comparing all of both: intervals stand under the blocks that make them up, points under the blocks they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block has 2^BITS blocks of the level below.
BITS = 3


def blocks(lo: Column, hi: Column, levels: int) -> Column:
    """The fewest blocks (level, node), of levels from 0 up to `levels`, that make up the whole numbers from lo to hi; none if hi < lo."""
    one = lambda k: lambda x: F.struct(k.alias("level"), x.alias("node"))
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def step(s: Column, k: Column) -> Column:
        first, last = F.shiftright(s["lo"] + (1 << BITS) - 1, BITS), F.shiftright(s["hi"] + 1, BITS) - 1  # whole blocks above
        left, right = F.shiftleft(first, BITS), F.shiftleft(last + 1, BITS)
        rest = F.concat(
            F.filter(F.sequence(s["lo"], F.greatest(s["lo"], left)), lambda x: x < left),
            F.filter(F.sequence(F.least(s["hi"], right), s["hi"]), lambda x: x >= right),
        )
        here = F.struct(F.lit(1).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.concat(s["out"], F.transform(F.sequence(s["lo"], s["hi"]), one(k))).alias("out"))
        up = F.struct(first.alias("lo"), last.alias("hi"), F.concat(s["out"], F.transform(rest, one(k))).alias("out"))
        return F.when(s["lo"] > s["hi"], s).when((k == levels) | (first > last), here).otherwise(up)

    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["out"])


def within(at: Column, levels: int) -> Column:
    """The blocks (level, node) that a whole number lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(at / F.pow(F.lit(1 << BITS), k)).cast("long").alias("node")))


def levels_of(spans: DataFrame, lo: Column, hi: Column) -> int:
    """Levels above the lowest that blocks of these intervals can have: as the longest one asks."""
    longest = spans.agg(F.max(hi - lo + 1)).first()[0] or 1
    return max(0, -(-int(longest).bit_length() // BITS))


def placed(points: DataFrame, spans: DataFrame, at: Column, lo: Column, hi: Column, unit: int = 1) -> tuple[DataFrame, DataFrame]:
    """points and spans with the blocks (level, node) by which they meet: a point meets a span once if it lies in it, and only then.

    Places are whole numbers. With a unit, blocks are of so many numbers, and a point may also meet a span that ends
    or begins within its unit: then the caller compares again. Spans of which lo or hi is null, and those that are empty, meet nothing.
    """
    low = lambda c: F.floor(c / unit)
    spans = spans.where(lo <= hi)
    levels = levels_of(spans, low(lo), low(hi))
    both = spans.withColumn("_block", F.explode(blocks(low(lo), low(hi), levels)))
    return points.withColumn("_block", F.explode(within(low(at), levels))), both
