"""Benchmark decontamination: n-gram seeds pair passages with test items, and Smith-Waterman alignment scores them."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, run_arrow, stored

WORD = re.compile(r"\w+")
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that an alignment with a positive score can span, in times of its item's words: each match pays for two others.
SPAN = 3
#: Bytes of benchmark text that tasks hold at once; a larger benchmark is taken in so many parts.
ITEM_BYTES = 4 << 20
#: Words of the passages, and of the items, that are aligned at once, and scores of distinct stretches that a task remembers.
ALIGNED_WORDS, KEPT_SCORES = 1 << 20, 1 << 16
PAIRS = "doc_id long, item_id long, score double, start_word long, n_seeds int"


class Items:
    """A part of the benchmark: word numbers, the seeds (n-grams) of its items, and where each seed stands."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int):
        self.n = n
        self.ids = [r[0] for r in rows]
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall((r[1] or "").lower())], np.int64) for r in rows]
        seed, item, place = [], [], []
        for k, w in enumerate(self.words):
            size = min(n, len(w))  # an item of fewer words is one seed
            if size:
                h = self.hashes(w, size)
                seed.append(h)
                item.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)

    @staticmethod
    def hashes(words: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k].astype(np.uint64))
        return h

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in words, index into the seeds) of every seed that occurs."""
        at, which = [], []
        known = words > 0
        for n in self.sizes:
            if len(words) < n:
                continue
            full = known[: len(words) - n + 1].copy()
            for k in range(1, n):
                full &= known[k : len(words) - n + 1 + k]
            p = np.flatnonzero(full)
            if not len(p):
                continue
            h = np.full(len(p), n, np.uint64)
            for k in range(n):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[p + k].astype(np.uint64))
            lo, hi = np.searchsorted(self.seed, h, "left"), np.searchsorted(self.seed, h, "right")
            count = hi - lo
            at.append(np.repeat(p, count))
            which.append(np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def windows(first: int, end: int, span: int) -> Iterator[tuple[int, int]]:
    """Pieces of a stretch of words, each of 2 x span words at most, such that every run of span words lies in one."""
    yield first, min(end, first + 2 * span)
    while first + 2 * span < end:
        first += span
        yield first, min(end, first + 2 * span)


def _candidates(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    """For each stretch of a text that holds seeds of an item: the seeds, and the numbered words around them."""
    names = ["doc_id", "item", "seeds", "start", "words"]
    get = items.number.get
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = WORD.findall((text.as_py() or "").lower())
            words = np.fromiter(map(get, found, repeat(0)), np.int64, len(found))
            at, which = items.hits(words)
            if not len(at):
                continue
            item, begins = items.item[which], at - items.place[which]
            order = np.lexsort((begins, item))
            item, begins, which = item[order], begins[order], which[order]
            size = np.array([len(items.words[k]) for k in item.tolist()])
            cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(begins) > size[1:])) + 1
            for group in np.split(np.arange(len(item)), cut):
                n = int(size[group[0]])
                first, end = max(0, int(begins[group[0]]) - n // 2), min(len(words), int(begins[group[-1]]) + n + n // 2)
                for lo, hi in windows(first, end, SPAN * n):
                    own = group if hi - lo == end - first else group[slice(*np.searchsorted(begins[group], [lo - n, hi]))]
                    if len(own):
                        rows.append((doc_id, int(item[group[0]]), np.unique(items.seed[which[own]]).view(np.int64), lo, words[lo:hi].astype("<i4").tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def smith_waterman(passages: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of passages with items, pair by pair, all pairs a row of the matrix at a time."""
    n, width, height = len(items), max(map(len, items), default=0), max(map(len, passages), default=0)
    item, passage = np.full((n, width), -1, np.int32), np.full((n, height), -2, np.int32)
    for k, (p, w) in enumerate(zip(passages, items, strict=True)):
        item[k, : len(w)], passage[k, : len(p)] = w, p
    above, best = np.zeros((n, width + 1), np.int32), np.zeros(n, np.int32)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(height):
        here = np.zeros((n, width + 1), np.int32)
        step = np.where(item == passage[:, i : i + 1], MATCH, MISMATCH)
        here[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + step, above[:, 1:] + GAP))
        here = np.maximum.accumulate(here + slope, axis=1) - slope  # gaps in the passage
        best = np.maximum(best, here.max(1))
        above = here
    return best


def _scores(pairs: list[tuple[int, bytes]], items: Items, threshold: float) -> list[float]:
    """Share of a full match's score for each (item, words); 0 where the item's words that occur cannot reach the threshold."""
    out = [0.0] * len(pairs)
    open_: list[tuple[int, int, np.ndarray]] = []
    for k, (item, raw) in enumerate(pairs):
        own, words = items.words[item], np.frombuffer(raw, "<i4")
        if np.isin(own, words).sum() / len(own) >= threshold:  # no alignment matches more words than these
            open_.append((len(words), k, words))
    open_.sort(key=lambda x: x[:2])
    lo = 0
    while lo < len(open_):
        hi, width = lo + 1, len(items.words[pairs[open_[lo][1]][0]])
        while hi < len(open_) and hi - lo < 512:
            width = max(width, len(items.words[pairs[open_[hi][1]][0]]))
            if (hi + 1 - lo) * max(width, open_[hi][0]) > ALIGNED_WORDS:
                break
            hi += 1
        own = [items.words[pairs[k][0]] for _, k, _ in open_[lo:hi]]
        best = smith_waterman([w for _, _, w in open_[lo:hi]], own)
        for (_, k, _), n, w in zip(open_[lo:hi], best.tolist(), own, strict=True):
            out[k] = n / (MATCH * len(w))
        lo = hi
    return out


def _align(batches: Iterator[pa.RecordBatch], items: Items, threshold: float, rare: dict[int, set[int]]) -> Iterator[pa.RecordBatch]:
    """Align every stretch, each distinct (item, words) of a task once. Rarity only counts seeds, it drops no stretch."""
    known: dict[tuple[int, bytes], float] = {}
    for batch in batches:
        item = batch.column(1).to_pylist()
        raw = batch.column(4).to_pylist()
        keys = [(k, hashlib.blake2b(w, digest_size=16).digest()) for k, w in zip(item, raw, strict=True)]
        if len(known) > KEPT_SCORES:
            known = {}
        new = {key: (k, w) for key, k, w in zip(keys, item, raw, strict=True) if key not in known}
        known.update(zip(new, _scores(list(new.values()), items, threshold), strict=True))
        score = np.array([known[key] for key in keys], np.float64)
        ok = np.flatnonzero(score >= threshold)
        seeds = batch.column(2)
        n = [sum(s in rare[item[k]] for s in seeds[k].as_py()) for k in ok.tolist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(ok)), pa.array([items.ids[item[k]] for k in ok], pa.int64()), pa.array(score[ok]), batch.column(3).take(pa.array(ok)), pa.array(n, pa.int32())],
            ["doc_id", "item_id", "score", "start_word", "n_seeds"],
        )


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, common: float = 8.0, threshold: float = 0.5) -> DataFrame:
    """One row for each document and item that it holds a copy of: doc_id, item_id, score, start_word, n_seeds.

    docs has doc_id and text, benchmark item_id and text; other columns are ignored. Words are runs of
    letters, digits and underscores in lower case. An item's seeds are its n-grams of words (an item with
    fewer is one seed), and every stretch of a document that holds one is aligned, however common the seed;
    a very long stretch in overlapping pieces, such that every alignment with a score lies in one.
    n_seeds counts those of the stretch that are rare: in at most `common` times as many stretches as the
    item's median seed; it may be 0. score is the best local alignment's share of a full match's; rows below
    the threshold are left out; of stretches that tie the one with more rare seeds counts, then the first.
    A benchmark of more than ITEM_BYTES takes a pass over docs for each so many bytes. Null and empty texts and items match
    nothing; null ids stay null; repeated documents each count; equal items are each reported. No
    documents or no items give no rows.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts = max(1, -(-size // ITEM_BYTES))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    result = spark.createDataFrame([], PAIRS)
    for part in range(parts):  # one pass for each part of a bounded size
        rows = sorted((r.item_id, r.text or "") for r in tests.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect())
        items = Items(rows, n)
        found, _ = stored(run_arrow(own, _candidates, "doc_id long, item int, seeds array<long>, start long, words binary", items=items), "candidates")
        counts = found.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count("*").alias("n"))
        seen = {r.seed: r.n for r in counts.collect()}  # no more rows than the part has seeds
        by_item: dict[int, list[int]] = defaultdict(list)
        for k, s in zip(items.item.tolist(), items.seed.view(np.int64).tolist(), strict=True):
            by_item[k].append(s)
        rare = {k: {s for s in all_ if seen.get(s, 0) <= common * max(1.0, float(np.median([seen.get(x, 0) for x in all_])))} for k, all_ in by_item.items()}
        scored = run_arrow(found, _align, PAIRS, items=items, threshold=threshold, rare=rare)
        best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_seeds", (-F.col("start_word")).alias("at"))).alias("b"))
        result = result.union(best.select("doc_id", "item_id", "b.score", (-F.col("b.at")).alias("start_word"), "b.n_seeds"))
    return result
