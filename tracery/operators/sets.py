"""Set operators: differences of snapshots, changed paths, duplicates, renames, proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_text


def compared(a: DataFrame, b: DataFrame, keys: list[str], parts: int | None = None) -> DataFrame:
    """Distinct keys of both frames with _a and _b, whether each has them: one shuffle for all differences. parts: tasks that it is dealt over."""
    sides = a.select(*keys, F.lit(True).alias("_a"), F.lit(False).alias("_b")).union(b.select(*keys, F.lit(False), F.lit(True)))
    return (sides.repartition(parts, *keys) if parts else sides).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def snapshot_diff(nodes_a: DataFrame, edges_a: DataFrame, nodes_b: DataFrame, edges_b: DataFrame, parts: int | None = None) -> DataFrame:
    """(change, item): nodes by id and edges by text that only one of two snapshots has. parts: tasks that edges are dealt over."""

    def one_sided(a: DataFrame, b: DataFrame, what: str, parts: int | None = None) -> DataFrame:
        change = F.when(F.col("_b"), f"{what}_added").otherwise(f"{what}_removed").alias("change")
        return compared(a, b, ["item"], parts).where("_a <> _b").select(change, "item")

    na, nb = (n.select(F.col("id").alias("item")) for n in (nodes_a, nodes_b))
    ea, eb = (e.select(edge_text(F.col("src"), F.col("kind"), F.col("dst")).alias("item")) for e in (edges_a, edges_b))
    return one_sided(na, nb, "node").union(one_sided(ea, eb, "edge", parts))


def symmetric_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side alone has, by one full join."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return left.join(right, keys, "full").where("_a is null or _b is null").select(*keys)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U3. Keys that both sides have, distinct."""
    return a.select(*keys).intersect(b.select(*keys))


def equal_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row, equal: whether both sides hold the same keys."""
    return symmetric_difference(a, b, keys).agg((F.count("*") == 0).alias("equal"))


def affected_paths(changes: DataFrame) -> DataFrame:
    """Paths of changes (path, previous_path), before and after."""
    return changes.select(F.explode(F.array("path", "previous_path")).alias("path")).where("path is not null").distinct()


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Every row whose key another row has too; counts are combined before the shuffle."""
    many = rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(many, key)


def duplicate_patterns(declared: DataFrame) -> DataFrame:
    """(pattern, note, seq, reason): later declarations in the first owning note, and every note of several.

    declared: pattern, note, seq.
    """
    notes = declared.groupBy("pattern").agg(F.countDistinct("note").alias("_notes"), F.min("note").alias("_first"))
    ranked = declared.withColumn("_n", F.row_number().over(Window.partitionBy("pattern", "note").orderBy("seq"))).join(notes, "pattern")
    again = ranked.where("note = _first and _n > 1").select("pattern", "note", "seq", F.lit("again in its note").alias("reason"))
    across = ranked.where("_notes > 1 and _n = 1").select("pattern", "note", "seq", F.lit("in several notes").alias("reason"))
    return again.union(across)


def changes_between(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change rows (status, path, previous_path) of two listings (path, hash).

    A path on one side is added or deleted, a new hash is modified. Equal contents of one deleted and one
    added path are a rename; of a path that stays, a copy.
    """
    b, a = before.select("path", F.col("hash").alias("_before")), after.select("path", F.col("hash").alias("_after"))
    both = b.join(a, "path", "full")
    added, deleted = both.where("_before is null"), both.where("_after is null")
    one = lambda rows, h, name: rows.groupBy(F.col(h).alias("hash")).agg(F.min("path").alias(name), F.count("*").alias(f"_n_{name}"))
    renamed = one(deleted, "_before", "previous_path").join(one(added, "_after", "path"), "hash").where("_n_previous_path = 1 and _n_path = 1").select("path", "previous_path")
    kept = before.join(after, ["path", "hash"]).groupBy("hash").agg(F.min("path").alias("previous_path"))
    copied = added.join(renamed, "path", "left_anti").select("path", F.col("_after").alias("hash")).join(kept, "hash").select("path", "previous_path")
    plain = added.join(renamed.select("path").union(copied.select("path")), "path", "left_anti").select("path")
    gone = deleted.join(renamed.select(F.col("previous_path").alias("path")), "path", "left_anti").select("path")
    modified = both.where("_before <> _after").select("path")
    none = F.lit(None).cast("string").alias("previous_path")
    rows = [(renamed, "renamed"), (copied, "copied"), (plain, "added"), (gone, "deleted"), (modified, "modified")]
    out = None
    for frame, status in rows:
        one_ = frame.select(F.lit(status).alias("status"), "path", F.col("previous_path") if "previous_path" in frame.columns else none)
        out = one_ if out is None else out.union(one_)
    return out


def rename_conflicts(changes: DataFrame) -> DataFrame:
    """Paths that several renames leave or reach; copies do not count."""
    renames = changes.where("status = 'renamed'")
    left = renames.groupBy(F.col("previous_path").alias("path")).agg(F.countDistinct("path").alias("n")).where("n > 1").select("path", F.lit("left twice").alias("reason"))
    reached = renames.groupBy("path").agg(F.countDistinct("previous_path").alias("n")).where("n > 1").select("path", F.lit("reached twice").alias("reason"))
    return left.union(reached)


def proof(receipt: DataFrame, staged: DataFrame) -> DataFrame:
    """(path, reason) where a receipt (path, before, after) and what is staged differ; no rows prove it."""
    r = receipt.select("path", F.col("before").alias("rb"), F.col("after").alias("ra"), F.lit(1).alias("_r"))
    s = staged.select("path", F.col("before").alias("sb"), F.col("after").alias("sa"), F.lit(1).alias("_s"))
    reason = F.when(F.col("_r").isNull(), "not in the receipt").when(F.col("_s").isNull(), "not staged").when(~(F.col("rb").eqNullSafe(F.col("sb")) & F.col("ra").eqNullSafe(F.col("sa"))), "other contents")
    return r.join(s, "path", "full").select("path", reason.alias("reason")).where("reason is not null")


def reconciled(unresolved: DataFrame, changes: DataFrame) -> DataFrame:
    """unresolved (value) with outcome and path: renamed, deleted, copied or unresolved, in this order."""
    pick = lambda status, key, value: changes.where(F.col("status") == status).groupBy(F.col(key).alias("value")).agg(F.min(value).alias(f"_{status}"))
    out = unresolved
    for status, key, value in (("renamed", "previous_path", "path"), ("deleted", "path", "path"), ("copied", "previous_path", "path")):
        out = out.join(pick(status, key, value), "value", "left")
    outcome = F.when(F.col("_renamed").isNotNull(), "renamed").when(F.col("_deleted").isNotNull(), "deleted").when(F.col("_copied").isNotNull(), "copied").otherwise("unresolved")
    return out.select(*unresolved.columns, outcome.alias("outcome"), F.coalesce("_renamed", "_copied").alias("path"))
