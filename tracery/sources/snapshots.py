"""Published snapshots: tables under a folder of their own, one index that commits them, recovery and retention.

A publication has these steps, and may stop between any two of them:

1. tables are written to a folder that no reader knows (staged);
2. that folder gets the name of its contents' root hash, or goes if there is one already (installed);
3. a new index is written under a name of its own and gets the next index's name (committed);
4. older indexes, and snapshots that the new index no longer lists, are deleted (cleaned).

Before step 3 readers see the last snapshot, after it the new one; no file is ever replaced. `recover` deletes
what an interrupted publication left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import edge_text
from ..functions.spread import TASK_ROWS
from ..operators.hashing import root_hash


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    _, p, fs = _fs(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def _rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether old got the name new, which nothing had."""
    jvm, p, fs = _fs(spark, old)
    to = jvm.org.apache.hadoop.fs.Path(new)
    return not fs.exists(to) and fs.rename(p, to)


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that nothing has read yet, whole or not at all."""
    jvm, p, fs = _fs(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not _rename(spark, p.toString(), path):
        fs.delete(p, False)
        raise RuntimeError(f"{path} was written by another publication")


def _indexes(spark: SparkSession, folder: str, name: str = "index") -> list[int]:
    parts = [x.split(".") for x in _names(spark, folder)]
    return sorted(int(x[1]) for x in parts if len(x) == 3 and x[0] == name and x[2] == "json" and x[1].isdigit())


def read_json(spark: SparkSession, folder: str, name: str) -> object:
    """The newest document of a name, or nothing."""
    known = _indexes(spark, folder, name)
    return json.loads("".join(r.value for r in spark.read.text(f"{folder}/{name}.{known[-1]}.json", wholetext=True).collect())) if known else None


def write_json(spark: SparkSession, folder: str, name: str, value: object) -> None:
    """A new newest document of a name; older ones go after it stands."""
    known = _indexes(spark, folder, name)
    _write(spark, f"{folder}/{name}.{(known or [0])[-1] + 1}.json", json.dumps(value))
    for k in known:
        _delete(spark, f"{folder}/{name}.{k}.json")


def history(spark: SparkSession, folder: str) -> list[dict]:
    """Committed snapshots, oldest first: at most as many as are kept."""
    return read_json(spark, folder, "index") or []


def contents(tables: dict[str, DataFrame]) -> str:
    """One hash of all tables' rows, whatever their order."""
    out = {}
    for name, t in sorted(tables.items()):
        rows = t.select("hash") if "hash" in t.columns and name in ("nodes", "edges") else t.select(F.sha2(F.to_json(F.struct(*sorted(t.columns))), 256).alias("hash"))
        out[name] = root_hash(rows).first()[0] or "empty"
    return root_hash(next(iter(tables.values())).sparkSession.createDataFrame([(f"{k}:{v}",) for k, v in out.items()], "hash string")).first()[0]


#: Columns by which tables of a snapshot are put in buckets: the same rows of two snapshots lie in the same bucket.
BUCKETED = {"nodes": ["id"], "edges": ["src", "kind", "dst"]}


def buckets_for(rows: int) -> int:
    """Buckets for tables of so many rows: one task sorts a bucket. A power of two, so snapshots that grow keep their number for long."""
    return max(8, 1 << (-(-rows // TASK_ROWS) - 1).bit_length())


def _write_table(t: DataFrame, path: str, name: str, buckets: int | None) -> None:
    if not buckets or name not in BUCKETED:
        t.write.parquet(path)
        return
    keys, own = BUCKETED[name], f"tracery_{uuid.uuid4().hex}"
    # Rows are dealt as the buckets are, so each bucket is one file and keeps its order.
    t.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(own)
    t.sparkSession.sql(f"DROP TABLE {own}")  # the files stay, under the snapshot's name


class PublicationBlocked(ValueError):
    """Diagnostics that keep a state from being published."""


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], keep: int = 20, at: Callable[[str], None] = lambda step: None, blockers: DataFrame | None = None, shown: int = 1000, buckets: int | None = None) -> str:
    """Write tables as a snapshot and commit it; returns the root hash of all of them (nodes and edges by their own hashes).

    blockers: diagnostics (path, code, message); if there are any nothing is written, and the last snapshot stays (the
    first `shown` of very many are told). buckets: nodes and edges are stored in so many, so that snapshots with equally many
    are compared without a shuffle.

    Equal contents are one snapshot that becomes the newest; what was written for it again goes. What falls out of the
    kept ones is deleted last. at(step) is called after each step.
    """
    if blockers is not None and (rows := blockers.orderBy("path", "code", "message").limit(shown).collect()):
        raise PublicationBlocked("\n".join(f"{r.path}: {r.code}: {r.message}" for r in rows))
    staged = f"{folder}/staged-{uuid.uuid4().hex}"
    for name, t in tables.items():
        _write_table(t, f"{staged}/{name}", name, buckets)
    at("staged")
    # The hash is of what was written: a table that is evaluated twice may come out otherwise.
    root = contents({name: spark.read.schema(t.schema).parquet(f"{staged}/{name}") for name, t in tables.items()})
    if root in _names(spark, folder) or not _rename(spark, staged, f"{folder}/{root}"):
        _delete(spark, staged)
    at("installed")
    kept = [x for x in history(spark, folder) if x["root"] != root]
    before = next((x for x in history(spark, folder) if x["root"] == root), None)
    own = before.get("buckets") if before else buckets  # an equal snapshot stays as it was written
    kept = [*kept, {"root": root, "seq": max((x["seq"] for x in kept), default=0) + 1, "buckets": own}][-keep:]
    known = _indexes(spark, folder)
    _write(spark, f"{folder}/index.{(known or [0])[-1] + 1}.json", json.dumps(kept))
    at("committed")
    recover(spark, folder)
    at("cleaned")
    return root


def recover(spark: SparkSession, folder: str) -> None:
    """Delete what the newest index does not list: older indexes, staged tables, and snapshots without a commit."""
    listed, known = {x["root"] for x in history(spark, folder)}, _indexes(spark, folder)
    for name in _names(spark, folder):
        old_index = any(name == f"index.{k}.json" for k in known[:-1])
        snapshot = len(name) == 64 and all(c in "0123456789abcdef" for c in name)
        if old_index or name.startswith("staged-") or name.endswith(".new") or (snapshot and name not in listed):
            _delete(spark, f"{folder}/{name}")


def load(spark: SparkSession, folder: str, ref: str, name: str) -> DataFrame:
    """A table of a snapshot: latest, or a root hash."""
    known = [x["root"] for x in history(spark, folder)]
    root = known[-1] if ref == "latest" and known else ref
    if root not in known:
        raise ValueError(f"no such snapshot: {ref}")
    return spark.read.parquet(f"{folder}/{root}/{name}")


def bucketed(spark: SparkSession, folder: str, ref: str, name: str) -> DataFrame:
    """load(), and Spark knows the buckets of the table if it was stored in some."""
    plain = load(spark, folder, ref, name)
    known = history(spark, folder)
    entry = known[-1] if ref == "latest" else next(x for x in known if x["root"] == ref)
    if not entry.get("buckets") or name not in BUCKETED:
        return plain
    table, columns = f"tracery_{name}_{entry['root'][:16]}_{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}", ", ".join(f"`{c}` {t}" for c, t in plain.dtypes)
    keys = ", ".join(BUCKETED[name])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {entry['buckets']} BUCKETS LOCATION '{folder}/{entry['root']}/{name}'")
    return spark.table(table)


def stored_diff(spark: SparkSession, folder: str, a: str, b: str) -> DataFrame:
    """U1, S15. sets.snapshot_diff of two stored snapshots: bucket by bucket, without a shuffle, where both have equally many."""
    out = None
    for name, text in (("nodes", F.col("id")), ("edges", edge_text(F.col("src"), F.col("kind"), F.col("dst")))):
        keys = BUCKETED[name]
        old, new = (bucketed(spark, folder, ref, name).select(*keys) for ref in (a, b))
        for change, left, right in ((f"{name[:-1]}_added", new, old), (f"{name[:-1]}_removed", old, new)):
            rows = left.join(right, keys, "left_anti").distinct().select(F.lit(change).alias("change"), text.alias("item"))
            out = rows if out is None else out.union(rows)
    return out
