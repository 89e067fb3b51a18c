"""Policies over code and imports: one pass over each file for all patterns, globs by directory, deny rules."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pattern as code
from ..functions.ids import trimmed
from ..functions.spread import sliced, spread
from ..functions.text import denies, glob_prefix, glob_regex, per_value
from .recursion import cut
from .resolve import partial_paths

# Fixed value: the code of a match's diagnostic.
VIOLATION = "policy-violation"
#: Characters of patterns that a task holds at once; more patterns are taken in several passes.
PATTERN_CHARS = 4 << 20
#: Pairs of globs and paths that one task should meet under one gram.
PAIRS = 1 << 20


def _scan(batches: Iterator[pa.RecordBatch], patterns: list[tuple[int, str]], key: str) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    found: dict[str, list[int]] = {}
    for id_, text in patterns:
        found.setdefault(text, []).append(id_)
    automaton = ahocorasick.Automaton()
    for text, ids in found.items():
        automaton.add_word(text, ids)
    if found:
        automaton.make_automaton()
    for batch in batches:
        rows = []
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            hits = {i for _, ids in automaton.iter(text) for i in ids} if text and found else set()
            rows += [(i, file) for i in sorted(hits)]
        a, b = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["pattern", key])


def literal_matches(files: DataFrame, patterns: DataFrame, key: str) -> DataFrame:
    """(pattern, file): files (key, text) that hold a pattern's (pattern, text) literal text; each file is read once for all.

    Empty patterns match nothing. Patterns go to the tasks in parts of a bounded size.
    """
    spark = files.sparkSession
    size = patterns.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PATTERN_CHARS))
    out = spark.createDataFrame([], f"pattern long, {key} long")
    for k in range(parts):
        rows = [(r.pattern, r.text) for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).where("text <> ''").collect()]
        out = out.union(files.select(key, "text").mapInArrow(partial(_scan, patterns=rows, key=key), f"pattern long, {key} long"))
    return out


def with_regex(spark: SparkSession, globs: list[tuple[str, str]]) -> DataFrame:
    """(decision, glob, regex, prefix) of globs; an invalid one has a null regex."""
    rows = []
    for decision, glob in globs:
        try:
            rows.append((decision, glob, glob_regex(glob), glob_prefix(glob)))
        except ValueError:
            rows.append((decision, glob, None, ""))
    return spark.createDataFrame(rows, "decision string, glob string, regex string, prefix string")


def literal_grams(glob: Column) -> Column:
    """Grams that every path of a glob holds: of three characters, or of two or one where it has no longer literal stretch.

    What stands in braces or brackets, or beside a `**`, whose slashes may be missing, is in no stretch.
    """
    bare = F.regexp_replace(glob, r"(?s)\\.|\[.*\]|\{.*\}|/?\*\*/?|[*?]", "\0")
    stretches = F.filter(F.split(bare, "\0"), lambda x: F.length(x) > 0)
    size = F.least(F.lit(3), F.array_max(F.transform(stretches, F.length)))
    each = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - size + 1)), lambda k: F.substring(x, k, size))
    grams = F.flatten(F.transform(F.filter(stretches, lambda x: F.length(x) >= size), each))
    return F.when(F.size(stretches) > 0, F.array_distinct(grams)).otherwise(F.array(F.lit("")))


def _by_gram(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """(decision, glob, path) of globs that begin with a special character.

    A glob is filed under that gram of its own which fewest paths hold, and only paths with this gram meet it. A gram with
    very many globs and paths is dealt over parts. Globs without a literal character meet all paths, as they match most of them.
    """
    wanted = cut(globs.select("glob", "regex").distinct().withColumn("gram", F.explode(literal_grams(F.col("glob")))))
    sizes = [r.n for r in wanted.select(F.length("gram").alias("n")).distinct().collect()]  # of 0 to 3
    if not sizes:
        return globs.select("decision", "glob", F.lit("").alias("path")).limit(0)

    def grams_of(n: int) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("path") - n + 1)), lambda k: F.substring("path", k, F.lit(n)))
        return F.when(F.length("path") >= n, all_).otherwise(F.array().cast("array<string>")) if n else F.array(F.lit(""))

    grams = [grams_of(n) for n in sizes]
    own = paths.select("path", F.explode(F.array_distinct(F.concat(*grams))).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    own = cut(own)
    often = own.groupBy("gram").agg(F.count("*").alias("paths"))
    # A gram that no path holds leaves its glob without a match.
    filed = wanted.join(often, "gram", "left").groupBy("glob", "regex").agg(F.min(F.struct(F.coalesce("paths", F.lit(0)).alias("paths"), "gram")).alias("x")).where("x.paths > 0")
    filed = cut(filed.select("glob", "regex", "x.gram", "x.paths"))
    parts = filed.groupBy("gram").agg(F.ceil(F.count("*") * F.max("paths") / PAIRS).cast("int").alias("parts"))
    asked = filed.join(parts, "gram").select("glob", "regex", "gram", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    held = own.join(parts, "gram").select("path", "gram", F.pmod(F.xxhash64("path"), "parts").cast("int").alias("part"))
    hits = held.join(asked, ["gram", "part"]).where("path rlike regex").select("glob", "path")
    return globs.select("decision", "glob").join(hits, "glob").select("decision", "glob", "path")


def governed(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """(decision, path), distinct: paths that a decision's globs match; a glob that matches none is tried as a path's tail.

    A glob's literal directories are an equality with a path's own; globs without are looked up by a gram of their literal
    characters. Neither meets a path that does not hold these.
    """
    own = paths.distinct()
    folder = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.when(k < F.size(F.split("path", "/")), F.lit("/")).otherwise(F.lit("")))))
    wanted = globs.where("regex is not null")
    hits = wanted.where("prefix <> ''").join(own.select("path", folder.alias("prefix")), "prefix").where("path rlike regex").select("decision", "glob", "path")
    hits = cut(hits.union(_by_gram(wanted.where("prefix = ''"), own)))
    rest = globs.select("decision", "glob").join(hits.select("decision", "glob").distinct(), ["decision", "glob"], "left_anti")
    found = partial_paths(rest.select(F.regexp_replace("glob", "#.*$", "").alias("query")).distinct(), own)
    fallback = rest.withColumn("query", F.regexp_replace("glob", "#.*$", "")).join(found, "query").select("decision", "path")
    return hits.select("decision", "path").union(fallback).distinct()


def denied_imports(imports: DataFrame, rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """(rule, path, module), distinct: imports (path, module) that a rule (rule, deny, deny_regex) forbids in its scope (rule, path)."""
    modules = imports.select("module").distinct()
    parts = F.split("module", "::")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "::"))
    held = modules.select("module", F.explode(heads).alias("deny")).join(rules.select("rule", "deny"), "deny").select("rule", "module")
    globs = rules.where(F.col("deny").rlike(r"[*?\[{\\]"))  # only these have to meet every module
    matched = modules.join(globs, denies(F.col("module"), F.col("deny"), F.col("deny_regex"))).select("rule", "module")
    bad = held.union(matched).distinct()
    return imports.join(bad, "module").join(scopes.distinct(), ["rule", "path"]).select("rule", "path", "module").distinct()


MATCHES = "id string, decision string, path string, line long, range string, text string, captures map<string,string>"


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MATCHES.split(", ")]
    kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string())]
    for batch in sliced(batches):
        rows: list[tuple] = []
        for path, language, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            t, told = code.tokens(text, language) if text else None, {}
            for p in asked if t else ():
                body = p["pattern"], p["rule"]
                if body not in told:  # policies of one pattern are matched once
                    told[body] = code.matches(t, *body) if code.error(*body) is None else []
                rows += [(p["id"], p["decision"], path, line, place, found, list(captures.items())) for line, place, found, captures in told[body]]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def scanned(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Match rows (id, decision, path, line, range, text, captures) of pairs (path, language, id, decision, pattern, rule) in files (path, language, text).

    A file is read, and its tokens told, once for all its policies.
    """
    asked = spread(pairs, "path", "language").groupBy("path", "language").agg(F.array_sort(F.collect_set(F.struct("id", "decision", "pattern", "rule"))).alias("asked"))  # as many as there are policies
    files = spread(files.select("path", "language", "text"), "path", "language")
    return files.join(asked, ["path", "language"]).select("path", "language", "text", "asked").mapInArrow(_matches, MATCHES)


def matches(files: DataFrame, policies: DataFrame, scope: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Match rows (id, decision, path, line, range, text, captures) of policies in the files that their decisions govern.

    files: path, language, text; policies: id, decision, language, pattern, rule; scope: decision, path, as
    governed() gives it; changed: path, if only those count. Policies that cannot be read match nothing (see
    declaration_errors).
    """
    asked = scope.select("decision", "path").distinct()
    asked = asked if changed is None else asked.join(changed.select("path").distinct(), "path", "left_semi")
    return scanned(files, asked.join(policies.select("decision", "id", "language", "pattern", "rule"), "decision"))


@dataclass
class ByGlob:
    """Matches of patterns in the files that globs select, before they are told of the policies that declare them.

    found: body, path, line, range, text, captures; hits: glob, path; owners: glob, body, decision, id, _globs (how many its decision has).
    """

    found: DataFrame
    hits: DataFrame
    owners: DataFrame


def scanned_by_glob(files: DataFrame, policies: DataFrame, globs: DataFrame, hits: DataFrame) -> ByGlob:
    """Matches of policies (id, decision, language, pattern, rule) where decisions govern by globs (decision, glob) and these select files (glob, path).

    A pattern or rule that many decisions declare is matched once in a file that any of them governs: pairs of decisions
    and files, which grow with the product of both, are neither shuffled nor scanned.
    """
    body = ["language", "pattern", "rule"]
    named = policies.select("decision", "id", *body).distinct()
    bodies = named.select(*body).distinct().withColumn("body", F.sha2(F.to_json(F.struct(*body)), 256))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"b.{c}")) for c in body]
    named = cut(named.alias("n").join(bodies.alias("b"), same).select("n.decision", "n.id", "n.language", "n.pattern", "n.rule", "b.body"))
    globs, hits = globs.select("decision", "glob").distinct(), cut(hits.select("glob", "path").distinct())
    owners = globs.withColumn("_globs", F.count("*").over(Window.partitionBy("decision"))).join(named, "decision")
    owners = cut(owners.select("glob", "body", "decision", "id", "language", "pattern", "rule", "_globs"))
    asked = hits.join(owners.select("glob", "body", *body).distinct(), "glob").select("path", "language", F.col("body").alias("id"), F.lit(None).cast("string").alias("decision"), "pattern", "rule")
    found = cut(scanned(files, asked).withColumnRenamed("id", "body").drop("decision"))
    return ByGlob(found, hits, owners.select("glob", "body", "decision", "id", "_globs"))


def told_by_glob(by: ByGlob) -> DataFrame:
    """matches() of them: each match is told of all policies that declare its pattern. Only decisions of several globs, which may select a file twice, are made distinct."""
    told = by.found.join(by.hits, "path").join(by.owners, ["glob", "body"])
    rows = lambda which: told.where(which).select("id", "decision", "path", "line", "range", "text", "captures")
    place = ["id", "decision", "path", "line", "range"]
    return rows("_globs = 1").union(rows("_globs > 1").dropDuplicates(place))


def counted_by_glob(by: ByGlob) -> DataFrame:
    """One row, n: how many rows told_by_glob() has, without making them.

    Matches are counted by glob and pattern and multiplied by the policies that ask for both. Policies of several globs
    are counted by what they ask for, all their globs and patterns; those that ask for the same have the same distinct matches.
    """
    zero = F.lit(0).cast("long")
    asked = by.owners.where("_globs = 1").groupBy("glob", "body").agg(F.count("*").alias("policies"))
    each = by.found.select("path", "body").groupBy("path", "body").agg(F.count("*").alias("rows")).join(by.hits, "path").groupBy("glob", "body").agg(F.sum("rows").alias("rows"))
    one = each.join(asked, ["glob", "body"]).agg(F.sum(F.col("policies") * F.col("rows")).alias("n"))
    wide = by.owners.where("_globs > 1").groupBy("decision", "id").agg(F.array_sort(F.collect_set(F.struct("glob", "body"))).alias("asked"))  # as many as a policy's decision has globs
    wide = wide.groupBy("asked").agg(F.count("*").alias("policies")).withColumn("which", F.sha2(F.to_json("asked"), 256))
    place = wide.select("which", "policies", F.explode("asked").alias("x")).select("which", "policies", "x.glob", "x.body")
    place = place.join(by.hits, "glob").join(by.found.select("path", "body", "line", "range").distinct(), ["path", "body"]).select("which", "policies", "path", "line", "range").distinct()
    several = place.groupBy("which", "policies").agg(F.count("*").alias("rows")).agg(F.sum(F.col("policies") * F.col("rows")).alias("n"))
    return one.union(several).agg(F.coalesce(F.sum("n"), zero).alias("n"))


def matches_by_glob(files: DataFrame, policies: DataFrame, globs: DataFrame, hits: DataFrame) -> DataFrame:
    """matches() where decisions govern by globs (decision, glob) and these select files (glob, path), by way of scanned_by_glob()."""
    return told_by_glob(scanned_by_glob(files, policies, globs, hits))


def in_match_order(found: DataFrame) -> DataFrame:
    """O5, O6. Match rows by path, line, range and text, and by captures where these tie."""
    return found.orderBy("path", "line", "range", "text", F.to_json(F.array_sort(F.map_entries("captures"))))


def violations(found: DataFrame) -> DataFrame:
    """V9. A diagnostic for each match row."""
    message = F.concat("decision", F.lit(" policy `"), "id", F.lit("` matched `"), "text", F.lit("`"))
    return found.select(F.lit("error").alias("severity"), F.lit(VIOLATION).alias("code"), "path", "line", message.alias("message"))


def declaration_errors(patterns: DataFrame) -> DataFrame:
    """(id, line, code) of unusable policy patterns (id, line, language, pattern, rule), with their path if they have one."""
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    why = (
        F.when(blank("id"), "missing-policy-pattern-id")
        .when(F.col("pattern").isNotNull() & F.col("rule").isNotNull(), "ambiguous-policy-pattern-body")
        .when(F.col("language").isNull() & F.col("pattern").isNull() & F.col("rule").isNull(), "missing-policy-pattern-definition")
        .when(blank("language"), "missing-policy-pattern-language")
        .when(F.col("pattern").isNull() & F.col("rule").isNull(), "missing-policy-pattern-body")
        .when(blank("pattern") & blank("rule"), "empty-policy-pattern")
        .when(per_value(code.error, "string")("pattern", "rule").isNotNull(), "invalid-policy-pattern")
    )
    return patterns.select(*[c for c in ("path", "id", "line") if c in patterns.columns], why.alias("code")).where("code is not null")
