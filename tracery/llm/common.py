"""Shared pieces of the training-data operators: table access, lineage cuts, streaming Arrow groups, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, partial, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch: long texts come in small batches, so that tasks hold little at once.
BATCH_CONF, DEFAULT_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)
def _own_dir(application: str) -> str:
    return f"file://{tempfile.gettempdir()}/tracery-{application}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where that is unset, one of our own serves a local session, whose executors are its driver; on a cluster
    it is an error, as each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir(spark.sparkContext.applicationId)
    return found.rstrip("/")


_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/tracery-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the scratch tables made in here at the end: for a step whose result is written outside the shared folder or by `stored` before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_path(spark, path)


def kept_table(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """stored(make(), name), without the scratch tables that making it took."""
    path = scratch_path(spark, name)
    with temporary(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write df in the shared folder and read it back. Gives the path too, for drop_path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of finished queries.

    They go when nothing uses the query's frames any more; Spark's event queue holds on to the last query
    until another has run, so a trivial one runs first.
    """
    gc.collect()
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying its values; nulls have zero length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal key from batches sorted by it; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and values[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = values[lo]
    if held:
        yield pa.Table.from_batches(held)


def run_arrow(df: DataFrame, f: Callable[..., Iterator[pa.RecordBatch]], schema: str, **fixed) -> DataFrame:
    """mapInArrow with fixed keyword arguments, over batches of bounded bytes (unless the session sets its own bound)."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF) == DEFAULT_BATCH:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(partial(f, **fixed), schema)


def uncollected(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f with Python's cycle collection off until the task's batches are done: for steps that make many objects and no cycles."""

    @wraps(f)
    def own(batches: Iterator[pa.RecordBatch], **fixed) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from f(batches, **fixed)
        finally:
            gc.enable()

    return own


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Component of each of n local nodes (its smallest index), by vectorised hooking and pointer jumping."""
    parent = np.arange(n)
    left, right = left.astype(np.int64), right.astype(np.int64)
    while len(left):
        a, b = parent[left], parent[right]
        open_ = a != b
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, component), component the smallest node reachable.

    Each round hooks every node to its smallest neighbour, jumps pointers once and contracts the edges,
    so rounds grow with the logarithm of the longest chain. Minima are combined before the shuffle, and a
    node with very many edges sits on the splittable side of each join. Each round is a table in the
    shared folder. Null ends and loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    live, live_path = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges"
    )
    labels, labels_path = None, None
    while live.limit(1).count():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("u"), F.least("a", "b").alias("p"))
        up = hook.select(F.col("u").alias("q_u"), F.col("p").alias("q_p"))
        jump, jump_path = stored(hook.join(up, hook.p == up.q_u).select("u", F.col("q_p").alias("p")), "jump")
        if labels is None:
            labels, labels_path = stored(jump.select(F.col("u").alias("node"), F.col("p").alias("component")), "labels")
        else:
            old = labels_path
            labels, labels_path = stored(
                labels.join(jump, labels.component == jump.u, "left").select("node", F.coalesce("p", "component").alias("component")), "labels"
            )
            drop_path(spark, old)
        left = jump.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = jump.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        old = live_path
        live, live_path = stored(
            live.join(left, "a").join(right, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct(), "edges"
        )
        drop_path(spark, old)
        drop_path(spark, jump_path)
    drop_path(spark, live_path)
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels
