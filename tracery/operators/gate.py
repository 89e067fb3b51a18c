"""Which changes of published decisions are no violation: what proves each is derived from the changes and their texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spread import sliced, spread
from ..sources import notes
from . import sets
from .recursion import chain_ends, cut, kept


def composed_renames(changes: DataFrame) -> DataFrame:
    """R3. (old, new): the renames among changes (status, path, previous_path), each chain followed to its last path; copies are none.

    Where a path is left or reached twice there is no one answer, and so no rename at all.
    """
    moved = cut(changes.where("status = 'renamed'").select(F.col("previous_path").alias("src"), F.col("path").alias("dst")).distinct())
    twice = sets.rename_conflicts(changes).limit(1).count()
    heads = moved.join(moved.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("start"))
    ends = chain_ends(moved.where(F.lit(not twice))).join(heads, "start", "left_semi")
    return ends.select(F.col("start").alias("old"), F.col("end").alias("new"))


def cyclic_renames(changes: DataFrame) -> DataFrame:
    """R3. Paths whose renames never come to an end: those of a cycle and those on the way to one."""
    moved = cut(changes.where("status = 'renamed'").select(F.col("previous_path").alias("src"), F.col("path").alias("dst")).distinct())
    return moved.select(F.col("src").alias("path")).distinct().join(chain_ends(moved).select(F.col("start").alias("path")), "path", "left_anti")


def _governed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the old text of a decision governs, and whether it is a links' migration; only of accepted ones what they govern."""
    for batch in sliced(batches):
        paths, values, linked = [], [], []
        for path, old, new in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            before, after = notes.parse(path, old), notes.parse(path, new)
            both = before["status"] == after["status"] == "accepted"
            paths.append(path)
            values.append(before["governs"] if both else [])
            linked.append(old != new and notes.portable(new) == old)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(linked, pa.bool_())], ["path", "governs", "linked"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for path, old, new, pairs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            told = notes.governs_rewritten(old, {p["old"]: p["new"] for p in pairs})
            if told is not None and told == new != old:
                same.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(same, pa.string())], ["path"])


def allowed_changes(changes: DataFrame, receipt: DataFrame | None = None, staged: DataFrame | None = None, base: DataFrame | None = None) -> DataFrame:
    """V11. (path, why) of changes (status, path, previous_path, old_text, new_text) that a rule allows.

    source rename: an accepted decision of which only what it governs changed, each value as files were renamed.
    portable links: only links to decisions changed, from their ids to files with the id as alias. receipt: where a receipt
    (path, before, after) is exactly what is staged, all of it. branch: what the base of the branch (path) does not
    have, which is asked only in a check of a branch.
    """
    texts = changes.where("status = 'modified' and previous_path is null and old_text is not null and new_text is not null").select("path", "old_text", "new_text")
    texts = kept(spread(texts, "path"))
    told = kept(texts.mapInArrow(_governed, "path string, governs array<string>, linked boolean"))
    out = told.where("linked").select("path", F.lit("portable links").alias("why"))
    renamed = told.select("path", F.explode("governs").alias("old")).distinct().join(composed_renames(changes), "old").groupBy("path").agg(F.collect_list(F.struct("old", "new")).alias("pairs"))  # as many as a note governs
    moved = spread(texts.join(renamed, "path").select("path", "old_text", "new_text", "pairs"), "path").mapInArrow(_rewritten, "path string")
    out = out.union(moved.select("path", F.lit("source rename")))
    if receipt is not None and staged is not None:
        proven = sets.proof(receipt, staged).agg((F.count("*") == 0).alias("proven"))  # one row
        own = staged.join(F.broadcast(proven), F.col("proven"), "left_semi").join(receipt.select("path"), "path", "left_semi")
        out = out.union(own.select("path", F.lit("receipt")))
    if base is not None:
        here = changes.select(F.coalesce("previous_path", "path").alias("_before"), "path")
        out = out.union(here.join(base.select(F.col("path").alias("_before")).distinct(), "_before", "left_anti").select("path", F.lit("branch")))
    return out.distinct()
