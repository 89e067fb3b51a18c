"""Best-fit packing: few-document length patterns fitted to the length histogram by non-negative least squares."""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import run_arrow, stored
from .tokens import word_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, most: int) -> Iterator[pa.RecordBatch]:
    words, end = word_tokens(tokenizer), end_id.to_bytes(4, "little")
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.ids(text.as_py()) + end
            for k, at in enumerate(range(0, len(ids), 4 * most)):
                part = ids[at : at + 4 * most]
                for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(gradient).max(initial=0)))
    while rounds > 0 and (~free).any():
        pick = np.where(free, -np.inf, gradient)
        j = int(pick.argmax())
        if pick[j] <= tolerance:
            break
        free[j] = True
        while rounds > 0:
            rounds -= 1
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = float(np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300)))
            x[at] += step * (s - x[at])
            free[at[(x[at] <= 1e-12)]] = False
            x[~free] = 0
        gradient = a.T @ (b - a @ x)
    return x


def patterns(bins: int, docs: int) -> list[tuple[int, ...]]:
    """Every way to fill bins with up to docs parts, largest part first."""
    found: list[tuple[int, ...]] = []

    def grow(left: int, top: int, parts: tuple[int, ...]) -> None:
        if not left:
            found.append(parts)
        elif len(parts) < docs:
            for p in range(min(left, top), (left - 1) // (docs - len(parts)), -1):
                grow(left - p, p, (*parts, p))

    grow(bins, bins, ())
    return found


def _best_fit(runs: list[tuple[int, Counter]], left: dict[int, int], most: int) -> dict[int, list[tuple[int, Counter]]]:
    """Runs (sequences, lengths in each) by the room they leave, once all of left is packed: longest first, each by best fit, into runs or new ones."""
    spaces: dict[int, list[tuple[int, Counter]]] = defaultdict(list)
    keys: list[int] = []

    def put(m: int, took: Counter) -> None:
        free = most - sum(x * c for x, c in took.items())
        if not spaces[free]:
            bisect.insort(keys, free)
        spaces[free].append((m, took))

    for run in runs:
        put(*run)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            k = bisect.bisect_left(keys, length)
            if k < len(keys):
                free = keys[k]
                m, took = spaces[free].pop()
                if not spaces[free]:
                    del keys[k]
            else:
                free, m, took = most, n, Counter()
            fits = min(free // length, n)
            full = min(m, n // fits)
            if took and m > full:
                put(m - full, took)
            put(full, took + Counter({length: fits}))
            n -= full * fits
    return spaces


def plan(histogram: dict[int, int], most: int, bins: int = 128, docs: int = 3) -> np.ndarray:
    """Where pieces of each length go: rows (length, first rank, copies in a sequence, sequences, first sequence, offset).

    Works on the histogram alone, so its size follows the number of lengths, never the number of pieces.
    Fitted patterns come first, the last part of each as long as its room allows; the rest goes by best fit,
    longest first, into what they leave free and then into new sequences. Then the sequences with the most
    room are packed anew, more of them each time and all at last, so the result is never worse than best fit.
    """
    width = -(-most // bins)
    left = dict(histogram)
    queue: dict[int, deque] = defaultdict(deque)
    for length in sorted(left, reverse=True):
        queue[-(-length // width)].append(length)
    runs: list[tuple[int, Counter]] = []
    ways = patterns(most // width, docs)
    if left and ways:
        a = np.zeros((most // width, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                a[part - 1, j] += 1
        b = np.zeros(most // width)
        for length, n in left.items():
            if -(-length // width) <= len(b):
                b[-(-length // width) - 1] += n
        times = nnls(a, b)
        sizes = sorted(left)
        for j in np.argsort(-times, kind="stable"):
            n = int(times[j] + 1e-6)
            while n > 0:
                took: Counter = Counter()
                for part in ways[j][:-1]:  # the longest lengths that the bins still hold
                    length = next((x for x in queue[part] if left[x] > took[x]), None)
                    if length is None:
                        break
                    took[length] += 1
                # the last part is the longest that what is left holds: bins are coarse, lengths are not
                free = most - sum(x * c for x, c in took.items())
                k = bisect.bisect_right(sizes, free) - 1
                while k >= 0 and left[sizes[k]] <= took[sizes[k]]:
                    k -= 1
                if took.total() < len(ways[j]) - 1 or k < 0 or sizes[k] <= width * (ways[j][-1] - 1):
                    break
                took[sizes[k]] += 1
                m = min(n, *(left[x] // c for x, c in took.items()))
                runs.append((m, took))
                n -= m
                for x, c in took.items():
                    left[x] -= c * m
                    if not left[x]:
                        sizes.pop(bisect.bisect_left(sizes, x))
                        queue[-(-x // width)].remove(x)
    spaces = _best_fit(runs, left, most)
    # Sequences with the most room are taken apart and packed anew, more of them each time, while that saves some.
    total = sum(m for own in spaces.values() for m, _ in own)
    least = -(-sum(x * n for x, n in histogram.items()) // most)
    share = 1 / 64
    while total > least and share <= 1:
        kept, again, apart = [], Counter(), share * total
        for free in sorted(spaces, reverse=True):
            for m, took in spaces[free]:
                n = min(m, max(0, -int(-apart // 1)))
                apart -= n
                if n:
                    again.update({x: c * n for x, c in took.items()})
                if m > n:
                    kept.append((m - n, took))
        tried = _best_fit(kept, dict(again), most)
        got = sum(m for own in tried.values() for m, _ in own)
        if got < total:
            spaces, total = tried, got
        else:
            share *= 2
    rows, ranks, first = [], Counter(), 0
    for free in sorted(spaces):
        for m, took in spaces[free]:
            at = 0
            for length, c in sorted(took.items(), reverse=True):
                rows.append((length, ranks[length], c, m, first, at))
                ranks[length] += c * m
                at += length * c
            first += m
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def _place(batches: Iterator[pa.RecordBatch], rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PACKED.split(", ")]
    big = np.int64(1) << 40
    keys = rows[:, 0] * big + rows[:, 1]
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
        at = rows[np.searchsorted(keys, length * big + rank, side="right") - 1]
        k = rank - at[:, 1]
        got = [batch.column(batch.schema.get_field_index(x)) for x in names[:5]]
        yield pa.RecordBatch.from_arrays([*got, pa.array(at[:, 4] + k // at[:, 2]), pa.array(at[:, 5] + k % at[:, 2] * length)], names)


def pack(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1, bins: int = 128, pattern_docs: int = 3) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs has doc_id and text; other columns are ignored. A null or empty text is the end id alone; a text of
    more than `most` ids, however long, is cut into pieces. A null doc_id stays null. Repeated rows and
    repeated ids are packed as often as they occur; pieces that tie in length are placed by id, piece and
    checksum. No documents give no rows. The driver sees one count for each length (at most `most`); ranks
    within a length are dealt over salted groups.
    """
    spark = docs.sparkSession
    pieces, _ = stored(run_arrow(docs.select("doc_id", "text"), _cut, PIECES, tokenizer=tokenizer, end_id=end_id, most=most), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(histogram.values())
    salts = min(1024, max(16, total // 2_000_000))
    if not total:
        return spark.createDataFrame([], PACKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(firsts, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("first") + F.col("own") - 1)
    return run_arrow(ranked.drop("salt", "own", "first"), _place, PACKED, rows=plan(histogram, most, bins, pattern_docs))
