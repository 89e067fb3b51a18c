"""Resolution of names: ranked lookups, unique or none, first but flagged, as each caller needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import is_line_fragment, link_fragment, link_target, slug, stem
from .ordered import first_wins


def suffixes(path: Column) -> Column:
    """All tails of a path at its separators, itself included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def partial_paths(queries: DataFrame, paths: DataFrame) -> DataFrame:
    """(query, path, ambiguous): the path itself, else the first of all that end in the query; none for no match.

    Tails are rows of their own, so the match is an equality and shuffles by tail.
    """
    exact = queries.join(paths, queries.query == paths.path, "left_semi").select("query", F.col("query").alias("path"), F.lit(False).alias("ambiguous"))
    rest = queries.join(paths, queries.query == paths.path, "left_anti").distinct()
    tails = paths.distinct().select("path", F.explode(suffixes(F.col("path"))).alias("query"))
    found = rest.join(tails, "query").groupBy("query").agg(F.min("path").alias("path"), (F.count("*") > 1).alias("ambiguous"))
    return exact.distinct().union(found)


def calls_to_symbols(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (path, text, ...) with target: the first symbol of that name in the same file, else the only one anywhere."""
    local = symbols.groupBy("path", F.col("name").alias("text")).agg(F.min(F.struct("seq", "id"))["id"].alias("_local"))
    only = symbols.groupBy(F.col("name").alias("text")).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    only = only.where("_low = _high").select("text", F.col("_low").alias("_only"))
    return calls.join(local, ["path", "text"], "left").join(only, "text", "left").select(*calls.columns, F.coalesce("_local", "_only").alias("target"))


def notes_by_key(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """queries (key) with note: by id, else file stem, else title, whatever the case; the first declaration wins."""
    keyed = notes.select("seq", "id", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lower(c).alias("_key")) for k, c in enumerate((F.col("id"), stem(F.col("path")), F.col("title")))])).alias("x"))
    best = keyed.select("seq", "id", "x.*").where("_key is not null").groupBy("_key").agg(F.min(F.struct("rank", "seq", "id"))["id"].alias("note"))
    return queries.join(best, F.lower(queries.key) == F.col("_key"), "left").select(*queries.columns, "note")


def has_heading(headings: Column, fragment: Column) -> Column:
    """Whether a note's headings hold a fragment, as it is written or as a slug; ASCII case does not count."""
    return F.exists(headings, lambda h: (F.lower(h) == F.lower(fragment)) | (slug(h) == F.lower(fragment)))


def links(raw: DataFrame, notes: DataFrame, paths: DataFrame, symbols: DataFrame, patterns: DataFrame) -> DataFrame:
    """raw (link, ...) with kind, target and ambiguous: source, pattern, note or broken.

    source: looks only at sources, match: only at patterns; else a note wins if it has the heading asked for,
    and a source comes last. Each distinct link is resolved once. notes: id, path, title, seq, headings;
    symbols: path, selector; patterns: id.
    """
    once = raw.select("link").distinct().withColumn("_t", link_target(F.col("link"))).withColumn("_f", link_fragment(F.col("link")))
    once = once.withColumn("_how", F.when(F.col("_t").startswith("source:"), "source").when(F.col("_t").startswith("match:"), "match").otherwise("any"))
    once = once.withColumn("key", F.regexp_replace("_t", "^(source|match):", ""))
    once = notes_by_key(once, notes).join(notes.select(F.col("id").alias("note"), "headings"), "note", "left")
    found = partial_paths(once.select(F.col("key").alias("query")).distinct(), paths).select(F.col("query").alias("key"), F.col("path").alias("_path"), "ambiguous")
    known = symbols.select(F.col("path").alias("_path"), F.col("selector").alias("_f")).distinct().withColumn("_symbol", F.lit(True))
    pattern = patterns.select(F.col("id").alias("key")).distinct().withColumn("_pattern", F.lit(True))
    once = once.join(found, "key", "left").join(known, ["_path", "_f"], "left").join(pattern, "key", "left")
    line = F.coalesce(is_line_fragment(F.col("_f")), F.lit(False))
    source = F.col("_path").isNotNull() & (F.col("_f").isNull() | line | F.coalesce("_symbol", F.lit(False)))
    note = (F.col("_how") == "any") & F.col("note").isNotNull() & (F.col("_f").isNull() | F.coalesce(has_heading(F.col("headings"), F.col("_f")), F.lit(False)))
    kind = (
        F.when(F.col("_how") == "match", F.when(F.coalesce("_pattern", F.lit(False)), "pattern").otherwise("broken"))
        .when(note, "note")
        .when(source, "source")
        .otherwise("broken")
    )
    named = F.when(F.col("_f").isNotNull() & ~line, F.concat("_path", F.lit("#"), "_f")).otherwise(F.col("_path"))
    once = once.withColumn("kind", kind).withColumn(
        "target", F.when(F.col("kind") == "note", F.col("note")).when(F.col("kind") == "pattern", F.col("key")).when(F.col("kind") == "source", named)
    )
    resolved = once.select("link", "kind", "target", (F.coalesce("ambiguous", F.lit(False)) & (F.col("kind") == "source")).alias("ambiguous"))
    return raw.join(resolved, "link", "left")


def selectors(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """queries (path, selector) with symbol and state: a selector in the file, else an alias in it; a null path asks everywhere.

    state is resolved, ambiguous or missing; symbols have id, path, selector, aliases.
    """
    keys = symbols.select("id", "path", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.col("selector").alias("selector"))), F.transform("aliases", lambda a: F.struct(F.lit(1).alias("rank"), a.alias("selector"))))).alias("x"))
    keys = keys.select("id", "path", "x.rank", "x.selector")

    def best(groups: list[str]) -> DataFrame:
        ranked = keys.groupBy(*groups, "rank").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        return ranked.groupBy(*groups).agg(F.min(F.struct("rank", "low", "high")).alias("b")).select(*groups, "b.low", "b.high")

    state = F.when(F.col("low").isNull(), "missing").when(F.col("low") < F.col("high"), "ambiguous").otherwise("resolved")
    out = [F.when(F.col("low") == F.col("high"), F.col("low")).alias("symbol"), state.alias("state")]
    here = queries.where("path is not null").join(best(["path", "selector"]), ["path", "selector"], "left").select(*queries.columns, *out)
    anywhere = queries.where("path is null").join(best(["selector"]), ["selector"], "left").select(*queries.columns, *out)
    return here.union(anywhere)


def patterns(queries: DataFrame, declared: DataFrame) -> DataFrame:
    """queries (pattern) with decision: the first declaration of the whole id, whatever its decision's status."""
    owners = first_wins(declared.select("pattern", "seq", "decision"), ["pattern"], ["seq"])
    return queries.join(owners.select("pattern", "decision"), "pattern", "left")


def containers(members: DataFrame, types: DataFrame) -> DataFrame:
    """members (path, container) with parent: the one type of that name in the file, else null."""
    only = types.groupBy("path", F.col("name").alias("container")).agg(F.min("id").alias("parent"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return members.join(only, ["path", "container"], "left")


def candidates(queries: DataFrame, keys: DataFrame, shown: int = 5) -> DataFrame:
    """queries (target) with state, total and shown: the ids that answer an exact key, else an older key.

    keys: id, key, legacy. The first `shown` ids in order are listed. A key's ids are ranked before they
    are gathered, so no list grows with the key.
    """
    from pyspark.sql import Window

    flat = keys.select("id", F.col("key").alias("target"), F.lit(0).alias("rank")).union(keys.where("legacy is not null").select("id", "legacy", F.lit(1))).distinct()
    least = flat.groupBy("target").agg(F.min("rank").alias("rank"))
    flat = flat.join(least, ["target", "rank"]).join(queries.select("target").distinct(), "target", "left_semi")
    totals = flat.groupBy("target").agg(F.count("*").alias("total"))
    first = flat.withColumn("_n", F.row_number().over(Window.partitionBy("target").orderBy("id"))).where(F.col("_n") <= shown)
    first = first.groupBy("target").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    state = F.when(F.col("total").isNull(), "unresolved").when(F.col("total") == 1, "resolved").otherwise("ambiguous")
    return queries.join(totals, "target", "left").join(first, "target", "left").select(*queries.columns, state.alias("state"), F.coalesce("total", F.lit(0)).alias("total"), "ids")
