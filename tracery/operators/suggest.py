"""Suggestions for many queries at once: an index of grams, and no scoring of what cannot be among the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fuzzy_score, source_match_score
from .recursion import cut

#: Pairs of queries and targets that one task should meet under one gram.
PAIRS = 1 << 20
# What a subsequence scores at least, for each letter of a run, and where a part begins.
FUZZY, RUN, PART = 40_000, 3, 8


def grams(x: Column, n: Column) -> Column:
    """The distinct pieces of n characters of a text, none of a shorter one."""
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x) - n + 1)), lambda k: F.substring(x, k, n))
    return F.when(F.char_length(x) >= n, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def holding(asked: DataFrame, targets: DataFrame, longest: int) -> DataFrame:
    """(q, target, low) of queries (q) and targets (target, low) that hold the gram of the query that fewest targets hold.

    A target without one of the query's grams holds neither the query nor its letters, so nothing is missed. A gram
    with very many queries and targets is dealt over parts.
    """
    size = F.least(F.char_length("q"), F.lit(longest))
    wanted = cut(asked.select("q", F.explode(grams(F.col("q"), size)).alias("gram")))
    each = F.explode(F.flatten(F.array(*[grams(F.col("low"), F.lit(n)) for n in range(1, longest + 1)])))
    own = cut(targets.select("target", "low", each.alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    often = own.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")
    filed = cut(wanted.join(often, "gram", "left").groupBy("q").agg(rarest).where("x.n > 0").select("q", "x.gram", "x.n"))
    parts = filed.groupBy("gram").agg(F.ceil(F.count("*") * F.max("n") / PAIRS).cast("int").alias("parts"))
    queries = filed.join(parts, "gram").select("q", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = own.join(parts, "gram").select("target", "low", "gram", F.pmod(F.xxhash64("target"), "parts").cast("int").alias("part"))
    return held.join(queries, ["gram", "part"]).select("q", "target", "low")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "target")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored_pairs(asked: DataFrame, targets: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(matches, subsequences): rows (q, target, score) of queries (q) and targets (target, low).

    What holds a query scores more than 50,000 less its length; a subsequence can score no more than its letters in one
    run give. A query whose k-th match is at least that has no need of subsequences, so they are sought for the others alone.
    """
    whole = holding(asked, targets, 3).where(F.instr("low", F.col("q")) > 0)
    matches = cut(whole.select("q", "target", source_match_score(F.col("q"), F.col("target")).alias("score")))
    n = F.char_length("q")
    bound = FUZZY + RUN * n * (n + 1) / 2 + PART * n
    done = _best(matches, k).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).where((F.col("n") >= k) & (F.col("least") >= bound)).select("q")
    rest = cut(asked.join(done, "q", "left_anti"))
    loose = holding(rest, targets, 1).where(F.instr("low", F.col("q")) == 0)
    loose = loose.select("q", "target", fuzzy_score(F.col("q"), F.col("target")).alias("f"), F.octet_length("target").alias("size"))
    return matches, loose.where("f is not null").select("q", "target", (FUZZY + F.col("f") - F.col("size")).cast("long").alias("score"))


def top(queries: DataFrame, targets: DataFrame, k: int = 20) -> DataFrame:
    """O7. (query, rank, target, score): the k targets (target) of each query (query) with the highest suggestion_score, ties by target.

    White space around a query and its case do not count; an empty one gets the first targets in order, without score.
    Null queries and targets are none; repeated ones count once.
    """
    asked = cut(queries.where("query is not null").select("query", F.lower(F.trim("query")).alias("q")).distinct())
    own = cut(targets.where("target is not null").select("target", F.lower("target").alias("low")).distinct())
    matches, loose = scored_pairs(asked.where("q <> ''").select("q").distinct(), own, k)
    best = _best(matches.union(loose), k)
    first = own.select("target").orderBy("target").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("target")))  # k rows
    out = asked.join(best, "q").select("query", "rank", "target", "score")
    empty = asked.where("q = ''").select("query").join(F.broadcast(first)).select("query", "rank", "target", F.lit(None).cast("long").alias("score"))
    return out.union(empty)
