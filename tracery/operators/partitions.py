"""Policy matches kept from scan to scan: a partition for each policy, and only what is stale is scanned again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import trimmed
from ..sources import snapshots
from . import policy
from .hashing import typed_hash
from .ordered import first_wins
from .recursion import cut

#: Of the matcher and of the rows that are kept: another version makes all of them stale.
VERSION = "1"


def registered(declared: DataFrame, effective: DataFrame) -> DataFrame:
    """P1. The first declaration of each pattern id, where its decision is effective, with the full id.

    declared: path and seq (order of declarations), decision, local, language, pattern, rule; effective: id. Those
    without decision or local id are none's. A later declaration does not stand in for a first one that is not
    effective.
    """
    named = declared.withColumn("local", trimmed(F.col("local"))).where("decision is not null and local is not null and local <> ''")
    first = first_wins(named.withColumn("id", F.concat_ws("/", "decision", "local")), ["id"], ["path", "seq"])
    return first.join(effective.select(F.col("id").alias("decision")), "decision", "left_semi")


def plan(policies: DataFrame, globs: DataFrame) -> DataFrame:
    """policies (id, decision, language, pattern, rule) with the fingerprint of what decides their matches: definition and globs (decision, glob) of the decision."""
    scopes = globs.groupBy("decision").agg(F.to_json(F.array_sort(F.collect_set("glob"))).alias("_scopes"))
    own = policies.join(scopes, "decision", "left")
    return own.withColumn("fingerprint", typed_hash("policy-partition", F.lit(VERSION), F.col("id"), F.col("language"), F.col("pattern"), F.col("rule"), F.col("_scopes"))).drop("_scopes")


def pairs(planned: DataFrame, files: DataFrame, scope: DataFrame) -> DataFrame:
    """(fingerprint, path, hash, language, id, decision, pattern, rule): each file (path, language, hash) that a policy's decision governs (decision, path)."""
    asked = scope.select("decision", "path").distinct().join(planned, "decision")
    return files.select("path", "language", "hash").join(asked, ["path", "language"])


KEY = ["fingerprint", "path", "hash"]


def stale(now: DataFrame, before: DataFrame) -> DataFrame:
    """P7. Pairs that were not scanned as they are: of a new or changed policy, or of a file that is new, changed or newly governed."""
    return now.join(before.select(*KEY), KEY, "left_anti")


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    _, path, fs = snapshots._fs(spark, f"{folder}/{name}")
    return spark.read.schema(schema).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], schema)


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """Match rows (id, decision, path, line, range, text, captures) as the last scan left them."""
    return _read(spark, folder, "matches", f"{policy.MATCHES}, fingerprint string").where("path is not null").drop("fingerprint")


def rescan(spark: SparkSession, folder: str, files: DataFrame, planned: DataFrame, scope: DataFrame) -> int:
    """P7, S18. Bring the match table of a folder up to date; how many (policy, file) pairs were scanned for it.

    files: path, language, hash, text; planned: as plan() gives it; scope: decision, path. The table is partitioned by
    fingerprint. Partitions of policies with stale or lost pairs are written anew, of what is still valid there and what was
    scanned; others are not touched, and those of policies that are no more go. The list of scanned pairs is written
    last: if that is missed, the next scan does the same work again and comes to the same rows.
    """
    told = snapshots.read_json(spark, folder, "scanned")
    schema = "fingerprint string, path string, hash string"
    before = _read(spark, folder, told, schema) if told else spark.createDataFrame([], schema)
    now = cut(pairs(planned, files, scope))
    new = cut(stale(now, before))
    lost = before.join(now.select(*KEY), KEY, "left_anti")
    touched = cut(new.select("fingerprint").union(lost.select("fingerprint")).distinct())
    valid = now.select(*KEY).join(new.select(*KEY), KEY, "left_anti").select("fingerprint", "path")
    held = _read(spark, folder, "matches", f"{policy.MATCHES}, fingerprint string")
    kept = held.join(valid, ["fingerprint", "path"], "left_semi").join(touched, "fingerprint", "left_semi").select(held.columns)
    scanned = policy.scanned(files, new.select("path", "language", "id", "decision", "pattern", "rule"))
    scanned = scanned.join(planned.select("id", "fingerprint"), "id").select(held.columns)
    # A row without a path stands for each partition, so one whose last match is gone is written too.
    empty = touched.select(*[F.col(c) if c == "fingerprint" else F.lit(None).cast(t).alias(c) for c, t in held.dtypes])
    rows = cut(kept.union(scanned).union(empty))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(f"{folder}/matches")
    name = f"pairs-{uuid.uuid4().hex}"
    now.select(*KEY).write.parquet(f"{folder}/{name}")
    snapshots.write_json(spark, folder, "scanned", name)
    alive = {f"fingerprint={r.fingerprint}" for r in planned.select("fingerprint").collect()}  # as many as there are policies
    for part in snapshots._names(spark, f"{folder}/matches"):
        if part.startswith("fingerprint=") and part not in alive:
            snapshots._delete(spark, f"{folder}/matches/{part}")
    for old in snapshots._names(spark, folder):
        if old.startswith("pairs-") and old != name:
            snapshots._delete(spark, f"{folder}/{old}")
    return new.count()
