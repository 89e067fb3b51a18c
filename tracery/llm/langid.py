"""Language identification: known words by their frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, run_arrow, stored

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: Words whose scores a worker keeps; beyond that it starts anew, so memory is bounded.
MAX_WORDS = 150_000


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            found[lang.as_py()].update(WORD.findall((text.as_py() or "").lower()))
        rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its edges; one-letter n-grams leave the edges out."""
    padded = word if n == 1 else f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Logs:
    """Log frequencies by language: a row of an array for each word or n-gram."""

    at: dict[str, int]
    rows: np.ndarray


@dataclass
class Model:
    """Log frequencies by language of words, and of n-grams by their length."""

    langs: list[str]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: list[Logs]
    evidence: int = 10
    index: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def word(self, word: str) -> tuple[float, ...]:
        """Log frequencies of a word, or those of its longest known n-grams."""
        if (found := self.words.get(word)) is not None:
            return tuple(self.word_rows[found].tolist())
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            get = self.grams[n].at.get
            known = [x for g in grams(word, n) if (x := get(g)) is not None]
            if known:
                return tuple((self.grams[n].rows[known].sum(0) / len(known)).tolist())
        return (0.0,) * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score from 0 to 1) of a whole text; und and 0 if it has no letter or nothing was learned.

        All words decide the language, by their mean log frequency; a tie goes to the first language in order.
        The score is the language's share of the likelihoods of `evidence` mean words, or of all words if
        there are fewer: words of a text depend on each other, and the product over all of them says 1 of any text.
        """
        found = WORD.findall((text or "").lower())
        # WORD also matches numerals that are no decimal digits, such as \u00b2 and \u2167
        if not self.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        if self.rows is None or len(self.index) + len(found) > MAX_WORDS:
            self.index, self.rows = {}, np.zeros((1 << 12, len(self.langs)))
        index = self.index
        try:
            at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        except KeyError:
            for w in set(found).difference(index):
                if len(index) >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[len(index)] = self.word(w)
                index[w] = len(index)
            at = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
        mean = self.rows[at].mean(0)
        best = int(mean.argmax())
        odds = np.exp((mean - mean[best]) * min(len(found), self.evidence))
        return self.langs[best], float(1 / odds.sum())


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, size, gram, n) of the n-grams of counted words (lang, word, n)."""
    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    found[lang, size, g] += n
        lang, size, gram = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "size", "gram", "n"])


def learn(rows: DataFrame, max_docs: int = 3000, least: int = 2, evidence: int = 10) -> Model:
    """Fit on rows (key, lang, text) with a language.

    max_docs bounds the labelled sample: about so many documents of each language, dealt by a hash of key, so
    the model's size does not grow with the corpus. Words and n-grams that the sample holds fewer than `least`
    times count as unseen; all others are kept. They are counted in tasks, and the driver gathers what is kept.
    """
    rows = rows.where("lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, np.zeros((0, 0)), [], evidence)
    dealt = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(min(1.0, max_docs / sizes[lang]) * (1 << 20)))])
    sample = rows.where(dealt < share[F.col("lang")]).select("lang", F.col("text").cast("string"))
    counted, path = stored(run_arrow(sample, _counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    grammed = run_arrow(counted, _gram_counts, "lang string, size int, gram string, n long")
    by_lang = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{k}") for k, lang in enumerate(langs)]
    every = counted.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").union(grammed).groupBy("size", "gram").agg(*by_lang)
    every, every_path = stored(every, "grams")
    own = [f"n{k}" for k in range(len(langs))]
    totals = {r["size"]: [r[c] for c in own] for r in every.groupBy("size").agg(*[F.sum(c).alias(c) for c in own]).collect()}
    kept = every.where(sum((F.col(c) for c in own), F.lit(0)) >= least).orderBy("size", "gram").toArrow()  # bounded by the sample
    for p in (path, every_path):
        drop_path(rows.sparkSession, p)
    size, gram = kept.column("size").to_numpy(), kept.column("gram").to_pylist()
    seen = np.stack([kept.column(c).to_numpy() for c in own], axis=1).astype(np.float64) if len(gram) else np.zeros((0, len(langs)))

    def logs(of: int) -> Logs:
        lo, hi = np.searchsorted(size, [of, of + 1])
        whole = np.array(totals.get(of, [0] * len(langs))) + 0.5 * (hi - lo) + 1
        return Logs({g: k for k, g in enumerate(gram[lo:hi])}, np.log((seen[lo:hi] + 0.5) / whole))

    known, *by_size = (logs(of) for of in range(LONGEST + 1))
    return Model(langs, known.at, known.rows, [known, *by_size], evidence)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = zip(*(model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (whose last column is the text) with lang_pred and lang_score added."""
    from pyspark.sql import types as T

    own = docs.select(*[c for c in docs.columns if c != text], F.col(text).cast("string"))
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return run_arrow(own, _predict, schema, model=model)  # the model's size is bounded by the sample


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learned from rows whose crc32(doc_id) mod 4 is not 2.

    Needs doc_id, text, lang; other columns are ignored. A null doc_id is neither held out nor learned from;
    a null lang is not learned from; a text that is null or has no letter gives und with score 0, as every
    text does when nothing could be learned. A very long text is read whole; languages that tie go by name.
    Repeated rows each get a row; no documents give no rows.
    """
    own = docs.select("doc_id", "lang", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(own.where(~held).select(F.col("doc_id").alias("key"), "lang", "text"))
    scored = predict(own.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
