"""Ordered scans without a single-task window: rows are dealt over ranges of their order, ranges are summed, and sums are carried on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one range should hold, and ranges at most; the ranges' sums are one small frame.
RANGE_ROWS, MOST_RANGES = 500_000, 4096


def ranged(df: DataFrame, key: Column) -> DataFrame:
    """df with _range: ranges of a numeric key with about equally many rows, as many as they need. A null key comes first.

    The ranges are cut at quantiles, so an outlier fills no range alone and crowds none; rows of one key stay together.
    """
    number = key.cast("double")
    rows = df.count()
    ranges = min(MOST_RANGES, max(1, rows // RANGE_ROWS))
    if ranges == 1:
        return df.withColumn("_range", F.lit(0))
    cuts = df.agg(F.percentile_approx(number, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts or []))])
    place = F.size(F.filter(bounds, lambda b: b <= number)) if len(cuts or []) < 64 else _place(bounds, number)
    return df.withColumn("_range", F.when(number.isNull(), F.lit(-1)).otherwise(place).cast("int"))


def _place(bounds: Column, number: Column) -> Column:
    """How many of the sorted bounds are at most the number, by halving."""
    lo, hi = F.lit(0), F.size(bounds)
    state = F.struct(lo.alias("lo"), hi.alias("hi"))

    def half(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= number)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_RANGES.bit_length())), state, half)["lo"]


def running_sum(df: DataFrame, key: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to each in the order, which must begin with key."""
    own = ranged(df, key).withColumn("_value", value)
    sums = own.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # At most MOST_RANGES rows meet in one task here.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumn("_inside", F.sum("_value").over(inside)).join(F.broadcast(carried), "_range")
    return summed.withColumn(name, F.col("_inside") + F.col("_carried")).drop("_range", "_value", "_inside", "_carried")


def budget_cut(df: DataFrame, key: Column, order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows admitted in order until the first that would overflow the budget; sizes are not negative."""
    return running_sum(df, key, order, size, "_used").where(F.col("_used") <= budget).drop("_used")


def gap_sessions(df: DataFrame, at: Column, order: list[Column], gap_micros: int) -> DataFrame:
    """df with session: a number that grows by one wherever more than the gap lies before a row.

    at: microseconds, the first key of the order. Each range learns the last time of the ranges before it.
    """
    own = ranged(df.withColumn("_at", at), F.col("_at"))
    ends = own.groupBy("_range").agg(F.max("_at").alias("_end"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_range", F.max("_end").over(earlier).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    told = own.withColumn("_last", F.lag("_at").over(inside)).join(F.broadcast(ends), "_range").drop("_range")
    told = told.withColumn("_new", (F.col("_at") - F.coalesce("_last", "_before") > gap_micros).cast("long")).fillna({"_new": 1})
    return running_sum(told, F.col("_at"), order, F.col("_new"), "session").drop("_at", "_last", "_before", "_new")


def keep_latest(df: DataFrame, order: Column, keep: int) -> DataFrame:
    """The `keep` rows of the highest order: a top-k, without a window over all rows."""
    return df.orderBy(order.desc()).limit(keep)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order; minima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def asof_latest(sites: DataFrame, directives: DataFrame, key: str, order: list[str], value: str, span: Column, most: str | None = None) -> DataFrame:
    """sites with the value of the last directive of the same key at or before them in the order, and the greatest value of a column (most) of those.

    Both have key and order columns; span cuts a key's rows into ranges of the order, so a key with very many
    rows is scanned by many tasks, each of which learns the last directive of the ranges before it.
    """
    high = F.col(most) if most else F.lit(None).cast("long")
    both = directives.select(key, *order, F.lit(0).alias("_site"), F.col(value).alias("_value"), high.alias("_most"), *[F.lit(None).cast(t).alias(c) for c, t in sites.dtypes if c not in (key, *order)]).unionByName(
        sites.select(*sites.columns, F.lit(1).alias("_site"), F.lit(None).cast(dict(directives.dtypes)[value]).alias("_value"), F.lit(None).cast(dict(directives.dtypes)[most] if most else "long").alias("_most"))
    )
    both = both.withColumn("_span", span)
    place = F.struct(*order)
    last = F.max(F.when(F.col("_site") == 0, F.struct(place.alias("place"), F.col("_value").alias("v")))).alias("_last")
    spans = both.groupBy(key, "_span").agg(last, F.max("_most").alias("_high"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)["v"]).withColumn("_before", F.max("_high").over(earlier)).select(key, "_span", "_carried", "_before")
    inside = Window.partitionBy(key, "_span").orderBy(*order, "_site").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).withColumn("_here", F.max("_most").over(inside)).where("_site = 1")
    return told.join(carried, [key, "_span"], "left").select(*sites.columns, F.coalesce("_inside", "_carried").alias(value), *([F.greatest("_here", "_before").alias(most)] if most else []))


def snapshot_order(rows: DataFrame, latest: Column) -> DataFrame:
    """W4. rows (snapshot, place, mtime) with position from 1: indexed ones in their order, then the others by time and hash, the latest last.

    One task orders them: there are as many as a history keeps, and orphans.
    """
    w = Window.orderBy(latest, F.col("place").isNull(), "place", "mtime", "snapshot")
    return rows.withColumn("position", F.row_number().over(w).cast("long"))
