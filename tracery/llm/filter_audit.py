"""Filter interaction audit: what five document filters remove in each of their 120 orders, and each filter's Shapley sum.

A document is its source, the mask of filters that it fails and its two labels, so a part (a source) is at most 32 x 4
counted cells. The orders are walked by adjacent transpositions (Steinhaus-Johnson-Trotter): two steps change with
each swap, and only those are summed from the cells again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import run_arrow

FILTERS = "ABCDE"
#: The filter that looks at other documents is the last bit; the others are told from the text alone.
COPY = 1 << FILTERS.index("E")
CELLS = "array<struct<mask:int,good:boolean,toxic:boolean,n:bigint>>"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

UPPER = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = b"#$%&*|"
CONTINUING = bytes(range(0x80, 0xC0))
SPACES = b"\t\n\v\f\r "


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, between ASCII white space, a piece at a time: no word is cut."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[at:end].split()
        at = end


def failed(data: bytes) -> int:
    """Mask of the filters that a text fails by itself."""
    n, seen = 0, set()
    for piece in words(data):
        n += len(piece)
        seen.update(piece)
    upper = len(data) - len(data.translate(None, UPPER))
    points = len(data.translate(None, CONTINUING))
    signs = len(data) != len(data.translate(None, SIGNS))
    return (n < 200) | (100 * len(seen) < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | signs << 3


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(2).to_pylist()]
        masks = pa.array([failed(x) for x in texts], pa.int32())
        digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), masks, digests], ["doc_id", "part", "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by source, filters failed and labels.

    Texts are known by their SHA-256. All copies of a text fail the same filters but E, which only those of its
    smallest id pass, so a text is counted by part and labels before its copies meet, and a hot one is few rows there.
    """
    data = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    # Documents without an id are dealt by their text; they are nobody's later copy and no label is theirs.
    seen = run_arrow(data, _features, "doc_id long, part string, mask int, digest binary").withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")))
    seen = seen.withColumn("spread", F.coalesce("spread", F.lit(0).cast("long"))).withColumn("key", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("known", F.col("doc_id").isNotNull())
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = marks.withColumn("spread", F.lit(0).cast("long")).withColumn("known", F.lit(True))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    marked = seen.join(marks, ["key", "spread", "known"], "left").select("doc_id", "key", "spread", "known", "part", "mask", "digest", flag("good"), flag("toxic"))
    same_id = marked.groupBy("key", "spread", "known", "part", "mask", "digest", "good", "toxic").agg(F.count("*").alias("n"))
    own = ["part", "mask", "good", "toxic"]
    # The smallest id of a text within its part and labels, with how many rows have it; then all rows of it there.
    text = same_id.groupBy("digest", "known", *own).agg(F.min(F.struct("key", "n")).alias("first"), F.sum("n").alias("n"))
    least = F.min(F.when(F.col("known"), F.col("first.key"))).over(Window.partitionBy("digest"))  # of as many rows as a text has parts and labels
    text = text.withColumn("least", least)
    passing = F.when(~F.col("known"), F.col("n")).when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(F.lit(0).cast("long"))
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passing.alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - passing).alias("n"))))
    return text.select("part", "good", "toxic", each.alias("x")).groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def swaps(n: int) -> Iterator[int]:
    """Places i whose elements i and i + 1 are swapped, one after the other, to walk all orders of n elements once."""
    items, towards = list(range(n)), [-1] * n
    while True:
        movable = [x for i, x in enumerate(items) if 0 <= (j := i + towards[x]) < n and items[j] < x]
        if not movable:
            return
        x = max(movable)
        i = items.index(x)
        j = i + towards[x]
        items[i], items[j] = items[j], items[i]
        for y in range(x + 1, n):
            towards[y] = -towards[y]
        yield min(i, j)


def walk(counted: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(order, steps) of all orders of parts whose cells are counted, an array (part, mask, good, toxic).

    steps: an array (part, step, count), the counts as in COUNTS but for shapley, which is the sum so far at the
    step's filter: the last order has it whole. It is one array for all orders, and only two steps differ from the last.
    """
    masks = np.arange(1 << len(FILTERS))
    order = list(range(len(FILTERS)))
    steps = np.zeros((len(counted), len(FILTERS), len(COUNTS)), np.int64)
    sums = np.zeros((len(counted), len(FILTERS)), np.int64)

    def update(i: int) -> None:
        bit, before = 1 << order[i], sum(1 << f for f in order[:i])
        fails = (masks & bit) != 0
        here, left = counted[:, fails & (masks & before == 0)], counted[:, masks & (before | bit) == 0]
        steps[:, i, 0] = left.sum((1, 2, 3))
        steps[:, i, 1] = here.sum((1, 2, 3))
        steps[:, i, 2] = counted[:, fails & (masks & before != 0)].sum((1, 2, 3))
        steps[:, i, 3] = counted[:, masks == bit].sum((1, 2, 3))
        steps[:, i, 4] = here[:, :, 1].sum((1, 2))
        steps[:, i, 5] = here[:, :, :, 1].sum((1, 2))

    for i in range(len(order)):
        update(i)
    moves = swaps(len(order))
    while True:
        sums[:, order] += steps[:, :, 1]
        steps[:, :, 6] = sums[:, order]
        yield "".join(FILTERS[f] for f in order), steps
        i = next(moves, None)
        if i is None:
            return
        order[i], order[i + 1] = order[i + 1], order[i]
        update(i)
        update(i + 1)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, n = batch.column(0), batch.num_rows
        counted = np.zeros((n, 1 << len(FILTERS), 2, 2), np.int64)
        held = batch.column(1)
        cell, row = held.flatten(), np.repeat(np.arange(n), np.asarray(held.value_lengths()))
        mask, good, toxic, count = (cell.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
        np.add.at(counted, (row, mask, good, toxic), count)
        found = [(order, steps.copy()) for order, steps in walk(counted)]
        last = dict(zip(found[-1][0], found[-1][1][:, :, 6].T, strict=True))
        for order, steps in found:
            steps[:, :, 6] = np.stack([last[f] for f in order], 1)
            own = parts.take(pa.array(np.repeat(np.arange(n), len(FILTERS))))
            flat = steps.reshape(-1, len(COUNTS))
            columns = [own, pa.array([order] * len(flat), pa.string()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), n))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(flat[:, c]) for c in range(len(COUNTS)))], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every source, order and step.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. A null text is the empty one, and fails A; a null
    source is the part ''. A document without an id has no label, never fails E and is no smaller id to others. Rows of
    one id are documents of their own; those of one text and id pass E together. A document with several label rows is
    good, or toxic, if one of them says so; null labels say nothing. A very long text is read whole, its words in
    pieces. No documents give no rows. Other columns are ignored. A part is at most 128 cells in a task.
    """
    rows = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).cast(CELLS).alias("cells"))
    return run_arrow(rows, _audited, RESULT)
