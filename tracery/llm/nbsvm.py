"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators for a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, run_arrow

BITS = 18
#: Byte n-grams and word n-grams that are features; a word equal to the one before counts as one and the same word.
BYTE_GRAMS, WORD_GRAMS = (2, 3, 4), (1, 2, 3)
CHUNK = 1 << 20


class Features:
    """Distinct hashed n-grams of whole texts; one scratch table for each object keeps first places."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, np.int64)

    def _distinct(self, at: np.ndarray) -> np.ndarray:
        order = np.arange(len(at))
        self.seen[at] = order
        return at[self.seen[at] == order]

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        found = []
        for lo in range(0, max(1, len(raw)), CHUNK):  # bounded memory for very long texts
            part = raw[lo : lo + CHUNK + max(BYTE_GRAMS) - 1].astype(np.uint64)
            code = part
            for n in range(2, max(BYTE_GRAMS) + 1):
                code = code[:-1] * np.uint64(256) + part[n - 1 :] if len(part) >= n else part[:0]
                if n in BYTE_GRAMS:
                    found.append(self._distinct(self._hash(code, n)))
        before = np.zeros(0, np.uint64)  # the last words of the part before: n-grams go on across parts
        lo = 0
        while lo < len(raw):
            hi = self._end_of_word(raw, lo + CHUNK)
            own = self._codes(raw[lo:hi]) if hi - lo <= 2 * CHUNK else np.array([self._long(w) for w in raw[lo:hi].tobytes().split()], np.uint64)
            code = np.concatenate([before, own])
            found.append(self._distinct(self._words(code, len(before))))
            before, lo = code[-max(WORD_GRAMS) :], hi
        return np.sort(self._distinct(np.concatenate(found)))

    @staticmethod
    def _end_of_word(raw: np.ndarray, at: int) -> int:
        """The first place from `at` on that stands before white space, so that no word is cut; a word may be any length."""
        while at < len(raw):
            part = raw[at : at + CHUNK]
            space = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(space):
                return at + int(space[0])
            at += CHUNK
        return len(raw)

    def _hash(self, code: np.ndarray, n: int) -> np.ndarray:
        h = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(64 - BITS)).astype(np.int64)

    def _codes(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each word."""
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            return np.zeros(0, np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._powers(len(raw)))])
        return mixed((total[end] - total[start]) * self._inverse(start))

    def _long(self, word: bytes) -> int:
        """The hash of one word, a part at a time."""
        total = 0
        for at in range(0, len(word), CHUNK):
            part = np.frombuffer(word, np.uint8, min(CHUNK, len(word) - at), at).astype(np.uint64) + np.uint64(1)
            total += int((part * self._powers(len(part))).sum()) * pow(self.BASE, at, 1 << 64)
        return int(mixed(np.array([total % (1 << 64)], np.uint64))[0])

    def _words(self, code: np.ndarray, known: int) -> np.ndarray:
        """Hashed word n-grams that end behind the first `known` words; a word equal to the one before is written as a mark of its own."""
        code = code.copy()
        code[1:][code[1:] == code[:-1]] = np.uint64(61)
        if known >= max(WORD_GRAMS):  # that first word was only needed to tell whether the second repeats it
            code, known = code[1:], known - 1
        out = []
        for n in WORD_GRAMS:
            first = max(0, known - n + 1)
            if len(code) - first >= n:
                h = np.zeros(len(code) - first - n + 1, np.uint64)
                for k in range(n):
                    h = mixed(h * np.uint64(31) + code[first + k : len(code) - n + 1 + k])
                out.append(self._hash(h & np.uint64((1 << 40) - 1), 8 + n))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    BASE = pow(0x2545F4914F6CDD1D, 1, 1 << 64)

    def _powers(self, n: int) -> np.ndarray:
        if len(getattr(self, "up", ())) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, self.BASE, np.uint64)]))
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(self.BASE, -1, 1 << 64), np.uint64)]))
        return self.up[:n]

    def _inverse(self, at: np.ndarray) -> np.ndarray:
        return self.down[at.astype(np.int64)]


def fit(texts: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weight of each feature, squared ratio of each feature, bias, slope, offset) from feature lists and labels 0 or 1.

    Ratios and the machine are fitted on four fifths of the rows, the score's slope and offset on the rest.
    """
    n = 1 << BITS
    flat = np.zeros(n)
    if len(y) < 10 or len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return flat, flat, 0.0, 0.0, float(np.log(share / (1 - share)))
    rng = np.random.default_rng(0)
    order = rng.permutation(len(y))
    rest, train = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[train].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        rest, train = order, order
    p, q = np.ones(n), np.ones(n)
    for i in train:
        (p if y[i] else q)[texts[i]] += 1
    ratio = np.log(p / (1 + y[train].sum())) - np.log(q / (1 + (1 - y[train]).sum()))
    rows = []
    for f in texts:
        v = ratio[f]
        rows.append(v / max(1e-12, float(np.sqrt(v @ v))))
    sign = np.where(y > 0, 1.0, -1.0)
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(y))
    for _ in range(epochs):  # dual coordinate descent; the bias is a feature of value one
        for i in rng.permutation(train):
            f, v = texts[i], rows[i]
            gradient = sign[i] * (float(w[f] @ v) + bias) - 1
            new = min(c, max(0.0, alpha[i] - gradient / 2.0))
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    margin = np.array([float(w[texts[i]] @ rows[i]) + bias for i in rest])
    a, b, t = 1.0, 0.0, (y[rest] * (y[rest].sum() + 1) + (1 - y[rest])) / np.where(y[rest] > 0, y[rest].sum() + 2, (1 - y[rest]).sum() + 2)
    for _ in range(50):  # Newton steps on the log loss
        s = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = s * (1 - s) + 1e-9
        g = np.array([(s - t) @ margin, (s - t).sum()])
        hess = np.array([[(h * margin) @ margin, h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return w * ratio, ratio * ratio, bias, float(a), float(b)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        got = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())], ["key", "label", "features"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    weight, square, bias, slope, offset = fit([np.frombuffer(r[2], "<i4").astype(np.int64) for r in rows], np.array([r[1] for r in rows], float))
    yield pa.RecordBatch.from_pylist([{"weight": weight.astype("<f4").tobytes(), "square": square.astype("<f4").tobytes(), "bias": bias, "slope": slope, "offset": offset}])


def _score(batches: Iterator[pa.RecordBatch], model: tuple) -> Iterator[pa.RecordBatch]:
    weight, square, bias, slope, offset = model
    features = Features()
    for batch in batches:
        out = np.empty(batch.num_rows)
        for k, text in enumerate(batch.column(2)):
            f = features(text.as_py())
            margin = bias + (float(weight[f].sum()) / max(1e-12, float(np.sqrt(square[f].sum()))) if len(f) else 0.0)
            out[k] = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000) -> tuple:
    """Fit on about max_rows labelled documents, dealt by a hash of doc_id: the bound of the model's sample.

    docs has doc_id and text, labels has doc_id and label. The sample's feature lists go to one task.
    """
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    total = labels.count()
    share = int(min(1.0, max_rows / max(1, total)) * (1 << 20))
    sample = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share)
    texts = docs.join(F.broadcast(sample), "doc_id").select(F.col("doc_id").alias("key"), "label", F.col("text").cast("string"))  # about max_rows rows
    rows = run_arrow(texts, _sampled, "key long, label int, features binary")
    r = run_arrow(rows.repartition(1), _train, "weight binary, square binary, bias double, slope double, offset double").first()
    if r is None:
        return np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 0.0
    return np.frombuffer(r.weight, "<f4"), np.frombuffer(r.square, "<f4"), r.bias, r.slope, r.offset


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learned from labelled rows whose crc32(doc_id) mod 3 is not 1.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. A null or empty text
    is scored by the bias alone; a very long one is read whole, a part at a time. A score of 0.5 counts as 1. Null labels and null ids are not learned from; of repeated labels the mean
    counts. Without labels of both kinds every score is the smoothed share of label 1. A null doc_id is not
    held out. Repeated rows each get a row; no documents give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).where(~held)
    model = learn(own, known)
    return run_arrow(own.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string")), _score, "doc_id long, held_out boolean, score double, predicted int", model=model)
