"""Validation from notes and files alone: what rules take as inputs is derived here, and what blocks a publication."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import glob_prefix, glob_regex
from . import partitions, policy, recursion, resolve, rules
from .recursion import kept


def _read_globs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for glob in batch.column(0).to_pylist():
            try:
                rows.append((glob, glob_regex(glob), glob_prefix(glob)))
            except ValueError:
                rows.append((glob, None, ""))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["glob", "regex", "prefix"])


def selections(globs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(told, hits) of globs (glob): glob, valid and found of each distinct one, and (glob, path) of the files it selects.

    A glob that selects no file stands for the file that it spells, if there is one; then it need not be readable.
    """
    read = kept(globs.select("glob").where("glob is not null").distinct().mapInArrow(_read_globs, "glob string, regex string, prefix string"))
    hits = kept(policy.governed(read.select(F.col("glob").alias("decision"), "glob", "regex", "prefix"), paths.select("path")).select(F.col("decision").alias("glob"), "path"))
    found = hits.select("glob").distinct().withColumn("found", F.lit(True))
    told = read.join(found, "glob", "left").select("glob", F.coalesce("found", F.lit(False)).alias("found"), (F.col("regex").isNotNull() | F.col("found").isNotNull()).alias("valid"))
    return told, hits


def symbol_targets(values: DataFrame, paths: DataFrame, symbols: DataFrame) -> DataFrame:
    """values (value) with found and legacy: whether the file and the symbol in it exist, and whether it is written in an older way.

    symbols: id, path, selector, aliases. The way to write a target is the whole path and the symbol's own selector.
    """
    body = F.regexp_replace("value", "^source:", "")
    once = values.select("value").distinct().withColumn("key", ids.link_target(body)).withColumn("selector", ids.link_fragment(body))
    once = once.withColumn("line", F.coalesce(ids.is_line_fragment(F.col("selector")), F.lit(False)))
    found = resolve.partial_paths(once.select(F.col("key").alias("query")).distinct(), paths.select("path").distinct()).select(F.col("query").alias("key"), "path")
    once = kept(once.join(found, "key", "left"))
    asked = once.where("path is not null and selector is not null and not line").select("path", "selector").distinct()
    answers = resolve.selectors(asked, symbols).where("symbol is not null").join(symbols.select(F.col("id").alias("symbol"), F.col("selector").alias("own")), "symbol")
    once = once.join(answers.select("path", "selector", "own"), ["path", "selector"], "left")
    whole = F.col("path").isNotNull() & (F.col("selector").isNull() | F.col("line") | F.col("own").isNotNull())
    written = F.when(F.col("selector").isNull() | F.col("line"), F.col("path")).otherwise(F.concat_ws("#", "path", "own"))
    plain = F.when(F.col("line"), F.col("key")).otherwise(body)
    return once.select("value", whole.alias("found"), (whole & (F.col("value").startswith("source:") | (plain != written))).alias("legacy"))


@dataclass
class Derived:
    """What rules.validate takes, and the targets of effective decisions, of one state of notes and files."""

    notes: DataFrame
    links: DataFrame
    targets: DataFrame
    decisions: DataFrame
    declared: DataFrame
    patterns: DataFrame
    matched: DataFrame
    effective: DataFrame
    by_glob: policy.ByGlob


@dataclass
class _Standing:
    """Notes with what is history among them, the decisions that are effective, and what globs of the others select."""

    notes: DataFrame
    known: DataFrame
    effective: DataFrame
    asked: DataFrame
    by_glob: DataFrame
    hits: DataFrame


def _standing(notes: DataFrame, paths: DataFrame) -> _Standing:
    notes = kept(notes)
    decided = notes.where("kind = 'decision' and id is not null")
    accepted = decided.where("status = 'accepted'").select("id").distinct()
    edges = decided.select(F.col("id").alias("src"), F.explode("supersedes").alias("dst"))
    replaced = kept(recursion.reachable(accepted, edges).distinct())
    historical, effective = accepted.join(replaced, "id", "left_semi"), kept(accepted.join(replaced, "id", "left_anti"))
    old = historical.withColumn("historical", F.lit(True))
    known = notes.join(old, "id", "left").withColumn("historical", F.coalesce("historical", F.lit(False)) & (F.col("kind") == "decision"))
    known = kept(known.withColumn("historical", F.coalesce("historical", F.lit(False))))
    now = known.where("not historical")
    every = F.when((F.col("kind") == "decision") & (F.size("governs") == 0), F.array(F.lit("**"))).otherwise(F.col("governs"))
    globs = lambda what, column: now.select("path", F.lit(what).alias("what"), F.explode(column).alias("value"))
    asked = kept(globs("governs", every).union(globs("scope", F.col("targets_scope"))))
    told, hits = selections(asked.select(F.col("value").alias("glob")), paths)
    by_glob = asked.join(told.withColumnRenamed("glob", "value"), "value").select("path", "what", "value", "found", "valid", F.lit(False).alias("legacy"))
    return _Standing(notes, known, effective, asked, by_glob, hits)


def derive(notes: DataFrame, files: DataFrame, symbols: DataFrame) -> Derived:
    """V4, V13, V14. All inputs of validation from notes (as sources.notes gives them), files (path, language, text) and symbols (id, path, selector, aliases).

    Accepted decisions that others supersede are history: neither their targets nor what they govern are asked for.
    A decision that governs nothing in particular governs all files. Policies are scanned in what their decision governs,
    where it is effective and declares the pattern first.
    """
    paths = files.select("path").distinct()
    standing = _standing(notes, paths)
    notes, known, effective, asked, hits, by_glob = standing.notes, standing.known, standing.effective, standing.asked, standing.hits, standing.by_glob
    decided, now = notes.where("kind = 'decision' and id is not null"), known.where("not historical")
    named = now.select("path", F.explode("targets_symbols").alias("value"))
    by_symbol = named.join(symbol_targets(named, paths, symbols), "value").select("path", F.lit("symbol").alias("what"), "value", "found", F.lit(True).alias("valid"), "legacy")
    declared = decided.select("path", F.col("id").alias("decision"), F.posexplode("policies").alias("seq", "p")).select("path", "decision", "seq", F.col("p.id").alias("local"), "p.language", "p.pattern", "p.rule")
    declared = kept(declared)
    local = ids.trimmed(F.col("local"))
    owned = declared.where(F.coalesce(local, F.lit("")) != "").select(F.concat_ws("/", "decision", local).alias("pattern"), local.alias("local"), "path", F.lit(None).cast("long").alias("line"), "seq")
    refs = known.select("path", F.explode("target_patterns").alias("value"))
    full = F.when(F.instr("value", "/") > 0, F.concat_ws("/", ids.pattern_decision(F.col("value")), ids.pattern_local(F.col("value")))).otherwise(F.col("value"))
    there = owned.select(F.col("pattern").alias("full")).distinct().withColumn("found", F.lit(True))
    by_pattern = refs.withColumn("full", full).join(there, "full", "left").select("path", F.lit("pattern").alias("what"), "value", F.coalesce("found", F.lit(False)).alias("found"), F.lit(True).alias("valid"), F.lit(False).alias("legacy"))
    targets = kept(by_glob.union(by_symbol).union(by_pattern).withColumn("line", F.lit(None).cast("long")))
    order = notes.select(F.col("path").alias("seq"), "path", "id", "title", F.transform("headings", lambda h: h["text"]).alias("headings")).where("id is not null")
    selectors = symbols.select("path", F.explode(F.concat(F.array("selector"), "aliases")).alias("selector"))
    links = resolve.links(notes.select("path", F.explode("links").alias("l")).select("path", "l.link", "l.line"), order, paths, selectors, owned.select(F.col("pattern").alias("id")))
    registered = kept(partitions.registered(declared, effective))
    governing = asked.where("what = 'governs'").join(notes.select("path", F.col("id").alias("decision")), "path").join(registered.select("decision").distinct(), "decision", "left_semi")
    scanned = policy.scanned_by_glob(files, registered, governing.select("decision", F.col("value").alias("glob")), hits)
    matched = policy.violations(policy.told_by_glob(scanned))
    errors = policy.declaration_errors(declared.select("path", F.col("local").alias("id"), F.lit(None).cast("long").alias("line"), "language", "pattern", "rule"))
    own = decided.select("id", "path", "supersedes", "superseded_by")
    return Derived(known, links, targets, own, errors, owned, matched, notes.join(effective, "id", "left_semi").where("kind = 'decision'").select("path"), scanned)


def check(d: Derived, decision_dir: str, changed: DataFrame | None = None) -> DataFrame:
    """V14. All diagnostics in order, or those of changed paths (path) alone, which leave out what concerns several notes."""
    own = rules.validate(d.notes, d.links, d.targets, d.decisions, d.declared, d.matched, decision_dir, changed)
    return own if changed is not None else rules.in_order(own.union(rules.duplicate_pattern_rules(d.patterns)))


def counts(d: Derived, decision_dir: str) -> DataFrame:
    """V14. (severity, code, n): how many diagnostics of each code check() gives.

    What policies find is counted and not made: a match has a diagnostic for each policy that asks for it, so these grow
    with the product of decisions and files.
    """
    rest = rules.gathered(d.notes, d.links, d.targets, d.decisions, d.declared, d.matched.where(F.lit(False)), decision_dir).union(rules.duplicate_pattern_rules(d.patterns))
    found = policy.counted_by_glob(d.by_glob).where("n > 0").select(F.lit("error").alias("severity"), F.lit(policy.VIOLATION).alias("code"), "n")
    return rest.groupBy("severity", "code").agg(F.count("*").alias("n")).union(found).groupBy("severity", "code").agg(F.sum("n").alias("n"))


def blocking(d: Derived) -> DataFrame:
    """V13. What keeps a state from being published: globs of effective decisions that govern nothing or cannot be read."""
    return _unfit(d.targets, d.effective)


def _unfit(targets: DataFrame, effective: DataFrame) -> DataFrame:
    return rules.in_order(rules.target_rules(targets.where("what = 'governs'").join(effective, "path", "left_semi")).where("severity = 'error'"))


def blockers(notes: DataFrame, files: DataFrame) -> DataFrame:
    """V13. blocking() of notes and files where nothing else is asked: only globs and supersession are looked at, no symbol, link or policy."""
    s = _standing(notes, files.select("path").distinct())
    own = s.notes.join(s.effective, "id", "left_semi").where("kind = 'decision'").select("path")
    return _unfit(s.by_glob.withColumn("line", F.lit(None).cast("long")), own)
