"""Validation rules: each gives diagnostics (severity, code, path, line, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import recursion

# Sections that a decision must have, in this order, and statuses.
SECTIONS = ["Context", "Decision", "Consequences"]
STATUSES = ["draft", "accepted", "rejected", "superseded"]


def told(rows: DataFrame, severity: str, code: str | Column, message: Column, line: Column | None = None) -> DataFrame:
    own = code if isinstance(code, Column) else F.lit(code)
    return rows.select(F.lit(severity).alias("severity"), own.alias("code"), "path", (F.lit(None).cast("long") if line is None else line).alias("line"), message.alias("message"))


def note_local_rules(notes: DataFrame, decision_dir: str) -> DataFrame:
    """V1-V3. notes: path, id, kind, title, status, headings (level, text, line), frontmatter_error, historical.

    A note whose frontmatter cannot be read has no other diagnostics of its own.
    """
    bad = told(notes.where("frontmatter_error is not null"), "error", "invalid-frontmatter", F.col("frontmatter_error"), F.lit(1).cast("long"))
    good = notes.where("frontmatter_error is null")
    here = decision_path(F.col("path"), decision_dir)
    decision = good.where("kind = 'decision'")
    known = decision.where(ids.is_decision_id(F.coalesce("id", F.lit(""))))
    rows = [
        bad,
        told(good.where("id is null"), "error", "missing-id", F.lit("note has no id")),
        told(good.where(~F.coalesce("kind", F.lit("")).isin("doc", "decision")), "error", "invalid-kind", F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("")))),
        told(good.where(here & (F.coalesce("kind", F.lit("")) != "decision")), "error", "adr-dir-non-decision", F.lit("only decisions belong here")),
        told(decision.where(~ids.is_decision_id(F.coalesce("id", F.lit("")))), "error", "invalid-adr-id", F.concat(F.lit("not a decision id: "), F.coalesce("id", F.lit("")))),
        told(decision.where(~here), "error", "decision-location", F.lit(f"decisions belong to {decision_dir}")),
        told(known.where(~ids.decision_file_ok(F.col("id"), F.col("path"))), "error", "adr-filename", F.concat(F.lit("file name does not match "), "id")),
        told(decision.where(document_error().isNotNull()), "error", "document-format", document_error()),
    ]
    return reduce(DataFrame.union, rows)


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """V7. Every note whose id another one declares too."""
    good = notes.where("frontmatter_error is null")
    many = good.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return told(good.join(many, "id"), "error", "duplicate-id", F.concat(F.lit("id is declared more than once: "), "id"))


def duplicate_pattern_rules(declared: DataFrame) -> DataFrame:
    """V7. declared: pattern (the full id), local (its part in the decision), path (the note), line, seq (order of declarations).

    Each later declaration in the note that declares a pattern first, and every note of several that declare it.
    """
    first = declared.groupBy("pattern").agg(F.min(F.struct("path", "seq")).alias("f"), F.array_sort(F.collect_set("path")).alias("notes"))  # as many notes as declare one pattern
    rows = declared.join(first, "pattern")
    again = rows.where((F.col("path") == F.col("f.path")) & (F.col("seq") > F.col("f.seq")))
    several = rows.where(F.size("notes") > 1).select("pattern", "path", "notes").distinct()
    message = F.concat(F.lit("pattern id `"), "pattern", F.lit("` is declared in multiple notes: "), F.array_join("notes", ", "))
    return told(again, "error", "duplicate-policy-pattern", F.concat(F.lit("policy pattern id `"), "local", F.lit("` is declared more than once")), F.col("line").cast("long")).union(told(several, "error", "duplicate-pattern-id", message))


def note_rules(notes: DataFrame, decision_dir: str) -> DataFrame:
    """V1-V3 and duplicate ids."""
    return note_local_rules(notes, decision_dir).union(duplicate_ids(notes))


def decision_path(path: Column, decision_dir: str) -> Column:
    """F12. Whether a path is a decision's: a Markdown file under the folder, but for the README directly there."""
    return path.startswith(f"{decision_dir}/") & path.endswith(".md") & (path != f"{decision_dir}/README.md")


def document_error() -> Column:
    """What is wrong with a decision's document, else null; historical ones need no sections."""
    first = F.filter("headings", lambda h: h["level"] == 1)
    second = F.transform(F.filter("headings", lambda h: (h["level"] == 2) & h["text"].isin(SECTIONS)), lambda h: h["text"])
    return (
        F.when(F.coalesce(ids.trimmed(F.col("title")), F.lit("")) == "", "title is empty")
        .when(~F.coalesce("status", F.lit("")).isin(STATUSES), "status is unknown")
        .when(F.size(first) != 1, "there must be one first-level heading")
        .when(ids.slug(first[0]["text"]) != ids.slug(F.col("title")), "the heading differs from the title")
        .when(~F.coalesce("historical", F.lit(False)) & (second != F.array(*[F.lit(x) for x in SECTIONS])), "sections are missing, repeated or out of order")
    )


def link_rules(links: DataFrame) -> DataFrame:
    """V5. links: path, link, line, kind, ambiguous, as resolved."""
    link = F.col("link")
    return reduce(DataFrame.union, [
        told(links.where("kind = 'broken'"), "error", "broken-link", F.concat(F.lit("link leads nowhere: "), link), F.col("line")),
        told(links.where((F.col("kind") == "source") & ~link.startswith("source:")), "warning", "source-wikilink", F.concat(F.lit("write source: before "), link), F.col("line")),
        told(links.where("kind = 'source' and ambiguous"), "warning", "ambiguous-source-link", F.concat(F.lit("several files answer to "), link), F.col("line")),
        told(links.where((F.col("kind") == "note") & ids.link_target(link).rlike(r"(?i)\.md$|/")), "error", "non-portable-note-link", F.concat(F.lit("link by id: "), link), F.col("line")),
    ])


def target_rules(targets: DataFrame) -> DataFrame:
    """V4. targets: path, line, what (symbol, scope, pattern, governs), value, found, valid, legacy."""
    value = F.col("value")
    return reduce(DataFrame.union, [
        told(targets.where("not valid"), "error", "invalid-glob", F.concat(F.lit("glob cannot be read: "), value), F.col("line")),
        told(targets.where("valid and legacy"), "warning", "legacy-source-target", F.concat(F.lit("older way to write "), value), F.col("line")),
        told(targets.where("valid and not found and what = 'symbol'"), "error", "unresolved-target", F.concat(F.lit("target does not exist: "), value), F.col("line")),
        told(targets.where("valid and not found and what = 'pattern'"), "error", "unresolved-pattern", F.concat(F.lit("pattern does not exist: "), value), F.col("line")),
        told(targets.where("valid and not found and what = 'scope'"), "warning", "empty-target-scope", F.concat(F.lit("scope holds no file: "), value), F.col("line")),
        told(targets.where("valid and not found and what = 'governs'"), "error", "unresolved-governs", F.concat(F.lit("governs nothing: "), value), F.col("line")),
    ])


def supersession_rules(decisions: DataFrame) -> DataFrame:
    """V6. decisions: id, path, supersedes, superseded_by."""
    forth = decisions.select("id", "path", F.explode("supersedes").alias("other"))
    back = decisions.select("id", "path", F.explode("superseded_by").alias("other"))
    known = decisions.select(F.col("id").alias("other")).distinct()
    edges = forth.select(F.col("id").alias("src"), F.col("other").alias("dst"))
    mirrored = back.select(F.col("other").alias("src"), F.col("id").alias("dst"))
    lonely = forth.join(known, "other", "left_semi").join(mirrored, (F.col("id") == F.col("src")) & (F.col("other") == F.col("dst")), "left_anti")
    lonely_back = back.join(known, "other", "left_semi").join(edges, (F.col("other") == F.col("src")) & (F.col("id") == F.col("dst")), "left_anti")
    rings = recursion.cycles(edges).select(F.col("start").alias("id"), F.array_join("path", " -> ").alias("ring")).join(decisions.select("id", "path"), "id")
    return reduce(DataFrame.union, [
        told(forth.join(known, "other", "left_anti"), "error", "unknown-supersedes", F.concat(F.lit("unknown decision: "), "other")),
        told(back.join(known, "other", "left_anti"), "error", "unknown-superseded-by", F.concat(F.lit("unknown decision: "), "other")),
        told(lonely.union(lonely_back), "error", "inconsistent-supersession", F.concat("id", F.lit(" and "), "other", F.lit(" do not name each other"))),
        told(rings, "error", "supersession-cycle", F.col("ring")),
    ])


def immutability(changes: DataFrame, allowed: DataFrame, decision_dir: str) -> DataFrame:
    """V11. Changed decisions: changes (status, path, previous_path) that neither add nor copy one and are not in allowed (path).

    allowed holds the exceptions by the path that the change leads to: proven receipts, renames of sources,
    portable links, and what a branch alone has.
    """
    own = changes.where(~F.col("status").isin("added", "copied") & decision_path(F.coalesce("previous_path", "path"), decision_dir))
    shown = F.concat_ws(" -> ", "previous_path", "path")
    return told(own.join(allowed.select("path").distinct(), "path", "left_anti").withColumn("_shown", shown), "error", "adr-immutability-violation", F.concat("_shown", F.lit(": decisions are immutable; supersede it by a new one")))


def scope_move(changes: DataFrame, config: str, before: str, now: str) -> DataFrame:
    """V12. One diagnostic where a change of the configuration moves the decision folder and a decision changes with it."""
    paths = changes.select(F.explode(F.array("path", "previous_path")).alias("path")).where("path is not null")
    told_ = paths.agg(F.max(F.col("path") == config).alias("moved"), F.max(decision_path(F.col("path"), before) | decision_path(F.col("path"), now)).alias("decision"))
    rows = told_.where(F.col("moved") & F.col("decision") & F.lit(before != now)).withColumn("path", F.lit(config))
    return told(rows, "error", "decision-scope-move", F.lit(f"decisions move from {before} to {now} together with a change of a decision"))


def widening(config: str, decision_dir: str) -> Column:
    """F8. Whether a change (status, path, previous_path) needs everything to be checked."""
    touched = [F.coalesce((F.col(c) == config) | F.col(c).startswith(f"{decision_dir}/"), F.lit(False)) for c in ("path", "previous_path")]
    return F.col("status").isin("deleted", "renamed", "other") | touched[0] | touched[1]


def needs_full_scan(changes: DataFrame, config: str, decision_dir: str) -> bool:
    """F8. Whether any change of a set does: a file went or moved, or the configuration or a decision changed."""
    whole = changes if "previous_path" in changes.columns else changes.withColumn("previous_path", F.lit(None).cast("string"))
    return bool(whole.agg(F.max(widening(config, decision_dir))).first()[0])


def gathered(notes: DataFrame, links: DataFrame, targets: DataFrame, decisions: DataFrame, declared: DataFrame, matched: DataFrame, decision_dir: str, changed: DataFrame | None = None) -> DataFrame:
    """The rows of validate() in no order."""
    definitions = told(declared, "error", F.col("code"), F.lit("policy pattern cannot be used"), F.col("line"))
    local = [note_local_rules(notes, decision_dir), target_rules(targets), definitions, link_rules(links), matched.select("severity", "code", "path", "line", "message")]
    own = reduce(DataFrame.union, local)
    if changed is not None:
        return own.join(changed.select("path").distinct(), "path", "left_semi").select("severity", "code", "path", "line", "message")
    return own.union(duplicate_ids(notes)).union(supersession_rules(decisions))


def validate(notes: DataFrame, links: DataFrame, targets: DataFrame, decisions: DataFrame, declared: DataFrame, matched: DataFrame, decision_dir: str, changed: DataFrame | None = None) -> DataFrame:
    """V14, F7. All diagnostics in order, or those of changed paths (path) alone.

    notes, links, targets and decisions as the rules above take them; declared: path, line, code of policy
    patterns that cannot be used; matched: policy diagnostics. A check of changed paths leaves out what
    concerns several notes: ids declared twice and supersession.
    """
    return in_order(gathered(notes, links, targets, decisions, declared, matched, decision_dir, changed))


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    """A7. One row: errors, warnings."""
    return diagnostics.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def in_order(diagnostics: DataFrame) -> DataFrame:
    """O4. Diagnostics by path, line (none first) and code."""
    return diagnostics.orderBy("path", F.coalesce("line", F.lit(0)), "code", "message")


def containing(diagnostics: DataFrame, part: str) -> DataFrame:
    """F6. Diagnostics whose path, message or code holds a text."""
    return diagnostics.where(F.contains("path", F.lit(part)) | F.contains("message", F.lit(part)) | F.contains("code", F.lit(part)))


def blocking(diagnostics: DataFrame) -> DataFrame:
    """V13. What keeps a graph from being published."""
    return diagnostics.where("severity = 'error' and code = 'unresolved-governs'")


def report(diagnostics: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """A8. (category, n, sets_code) of failures; the first category in order that has any sets the exit code."""
    rank = F.coalesce(*[F.when(F.col("code").isin(codes), F.lit(k)) for k, codes in enumerate(categories.values())], F.lit(len(categories)))
    name = F.create_map(*[F.lit(x) for k, c in enumerate([*categories, "other"]) for x in (k, c)])
    counted = diagnostics.where("severity = 'error'").groupBy(rank.alias("rank")).agg(F.count("*").alias("n"))
    first = counted.agg(F.min("rank").alias("first"))
    return counted.crossJoin(first).select(name[F.col("rank")].alias("category"), "n", (F.col("rank") == F.col("first")).alias("sets_code"))


def github_lines(diagnostics: DataFrame) -> DataFrame:
    """Workflow commands of diagnostics."""
    where = F.concat(F.lit("file="), text.github_escaped(F.col("path"), True), F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise(F.lit("")))
    return diagnostics.select(F.concat(F.lit("::"), "severity", F.lit(" "), where, F.lit(",title="), "code", F.lit("::"), text.github_escaped(F.col("message"))).alias("value"))


def text_lines(diagnostics: DataFrame) -> DataFrame:
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    return diagnostics.select(F.concat("severity", F.lit("["), "code", F.lit("] "), place, F.lit(": "), "message").alias("value"))
