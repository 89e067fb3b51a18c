"""SimHash near-duplicates found by covering locality-sensitive hashing, which misses no pair within the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_path, mixed, roots, run_arrow, stored

#: Fingerprints of a bucket that one task compares at once; larger buckets are dealt out in pairs of parts.
PART = 8192


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a whole text, unsigned; a text without words has 0."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    start = np.cumsum(size + 1) - size - 1
    if len(found) > words:
        spans = zip(start[: len(found) - words + 1].tolist(), (start + size)[words - 1 :].tolist(), strict=True)
    else:
        spans = iter([(0, len(joined))])
    one = xxhash.xxh64_intdigest
    h = np.array([one(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def covering_masks(radius: int) -> np.ndarray:
    """2^(radius+1) - 1 masks: whichever `radius` bits two fingerprints differ in, some mask leaves out all of them.

    Bit i has a non-zero vector of radius + 1 bits, and mask v keeps i where the two have an odd product.
    Up to `radius` vectors never span the whole space, so some v is orthogonal to those of all differing bits.
    """
    many = (1 << (radius + 1)) - 1
    own = 1 + np.arange(64) % many
    masks = [sum(1 << i for i in range(64) if int(own[i] & v).bit_count() & 1) for v in range(1, many + 1)]
    return np.array(masks, np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(batch.num_columns - 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*batch.schema.names[:-1], "fp"])


def _keys(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for lo in range(0, len(fps), 4096):
            part = fps[lo : lo + 4096]
            keys = mixed((part.view(np.uint64)[:, None] & masks[None, :]) ^ mixed(np.arange(1, len(masks) + 1, dtype=np.uint64))[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), pa.array(np.repeat(part, len(masks)))], ["key", "fp"])


def linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of the first one in its component of links, all pairs compared in blocks."""
    label = np.arange(len(fps))
    fps = fps.view(np.uint64)
    step = max(1, (1 << 21) // max(1, len(fps)))
    for lo in range(0, len(fps), step):
        near = np.bitwise_count(fps[lo : lo + step, None] ^ fps[None, lo:]) <= radius
        a, b = np.nonzero(near)
        a, b = label[a + lo], label[b + lo]
        new = a != b
        if new.any():
            pairs = np.unique(np.minimum(a[new], b[new]) * len(fps) + np.maximum(a[new], b[new]))
            label = roots(len(fps), pairs // len(fps), pairs % len(fps))[label]
    return label


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges that join what links in each run of equal keys: fewer than the run has members, never all pairs."""

    def edges(key: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cut = np.flatnonzero(np.diff(key)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        two = first[last - first == 2]
        near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
        a, b = [fp[two][near]], [fp[two + 1][near]]
        for lo, hi in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
            members = fp[lo:hi]
            label = linked(members, radius)
            joins = label != np.arange(len(members))
            a.append(members[joins])
            b.append(members[label[joins]])
        return a, b

    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
        if len(key) and key[0] != key[-1]:
            whole = np.searchsorted(key, key[-1])  # the last run may go on
            a, b = edges(key[:whole], fp[:whole])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            key, fp = key[whole:], fp[whole:]
    if len(key):
        a, b = edges(key, fp)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def fingerprint_edges(fps: DataFrame, radius: int, part: int = PART) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column fp that connect all pairs within the radius."""
    keys = run_arrow(fps.select("fp"), _keys, "key long, fp long", masks=covering_masks(radius))
    heavy = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    dealt = keys.join(heavy, "key").withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(group.alias("key"), "fp")
    return run_arrow(dealt.repartition("key").sortWithinPartitions("key", "fp"), _links, "a long, b long", radius=radius)


def _components(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp, ...) with the component of their fingerprints."""
    found = components(fingerprint_edges(nodes, radius)).select(F.col("node").alias("fp"), F.col("component").alias("_component"))
    return nodes.join(found, "fp", "left").withColumn("component", F.coalesce("_component", "fp")).drop("_component")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    docs has doc_id and text; other columns are ignored. Null, empty and wordless texts have fingerprint
    zero and link like any other; a very long text is read whole, and a bit that is set in just half of its
    hashes is 0. Equal fingerprints are one node, so copies cost one row each; repeated rows stay. A null
    doc_id is never a component's name while another id is in it. No documents give no rows.
    """
    own, _ = stored(run_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")), _fingerprints, "doc_id long, fp long", words=words), "fps")
    nodes, path = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = _components(nodes, radius)
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    groups, _ = stored(named.join(names, "component").select("fp", "component_id"), "groups")
    drop_path(docs.sparkSession, path)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(groups, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """docs without near-copies: of each group the row of the smallest doc_id (nulls last) stays, once.

    Rows that share an id but not a text are told apart by a hash of the text; of rows that share both one
    stays, whichever its other columns. All columns stay but `_key` and `_row`. Groups are those of simhash_groups.
    """
    keys = ["_key", "_row"]
    text = F.col("text").cast("string")
    keyed = docs.drop(*keys).withColumn("_key", F.xxhash64(F.lit(1), "doc_id", text)).withColumn("_row", F.xxhash64(text))  # neither is null
    own, path = stored(run_arrow(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text), _fingerprints, "doc_id long, _key long, _row long, fp long", words=words), "fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_key"))
    nodes, nodes_path = stored(own.groupBy("fp").agg(first.alias("first")), "nodes")
    firsts, _ = stored(_components(nodes, radius).groupBy("component").agg(F.min("first").alias("first")).select("first._key", "first._row"), "firsts")
    drop_path(docs.sparkSession, path)
    drop_path(docs.sparkSession, nodes_path)
    return keyed.join(firsts, keys, "left_semi").dropDuplicates(keys).drop(*keys)  # one shuffle for both
