"""Alignment against the textbook recurrence, and planted copies of benchmark items."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import decontaminate


def plain_alignment(passage, item):
    h = np.zeros((len(passage) + 1, len(item) + 1), int)
    for i in range(1, len(passage) + 1):
        for j in range(1, len(item) + 1):
            step = 2 if passage[i - 1] == item[j - 1] else -1
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


WORDS = st.lists(st.integers(1, 4), min_size=1, max_size=12)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(WORDS, WORDS), min_size=1, max_size=5))
def test_smith_waterman(pairs):
    got = decontaminate.smith_waterman([np.array(a) for a, _ in pairs], [np.array(b) for _, b in pairs])
    assert got.tolist() == [plain_alignment(a, b) for a, b in pairs]


def test_documents(spark, sf):
    """Whole-text alignment of every document with every item finds the same pairs."""
    docs, tests = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests).collect()}
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    items = [(r.item_id, split(r.text)) for r in tests.collect()]
    number = {}
    items = [(k, np.array([number.setdefault(w, len(number) + 1) for w in ws])) for k, ws in items]
    want = {}
    for r in docs.collect():
        words = np.array([number.get(w, 0) for w in split(r.text)])
        seeds = {tuple(words[i : i + 4]) for i in range(len(words) - 3) if words[i : i + 4].all()}
        near = [(k, w) for k, w in items if len(w) < 4 or any(tuple(w[i : i + 4]) in seeds for i in range(len(w) - 3))]
        if near and len(words):
            best = decontaminate.smith_waterman([words] * len(near), [w for _, w in near])
            want |= {(r.doc_id, k): b / (2 * len(w)) for (k, w), b in zip(near, best, strict=True) if b / (2 * len(w)) >= 0.5}
    assert want and got == want


def test_edited_copies(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["tiny item", None, ""]
    fill = lambda n: " ".join(word() for _ in range(n))
    edited = items[1].split()
    edited[7], edited[19] = "changed", "too"
    del edited[13]
    rows = [
        (1, f"{fill(50)} {items[0].upper()}, {fill(9)}"), (2, f"{fill(50)} {' '.join(edited)} {fill(9)}"), (3, f"{fill(10)} {' '.join(items[2].split()[:10])} {fill(50)}"),
        (4, fill(80)), (5, None), (6, ""), (7, f"{fill(60_000)} {items[3]}"), (8, f"{items[4]} {items[4]}"), (8, items[4]), (None, items[5]), (9, f"{fill(3)} tiny item"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, item_id int, score double")
    tests = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, doc_id int")
    got = decontaminate.contaminated(docs, tests).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 0), (2, 1), (7, 3), (8, 4), (None, 5), (9, 6)], key=str)
    assert {r.doc_id: r.score for r in got}[1] == 1.0 and {r.doc_id: r.score for r in got}[2] < 1
    assert decontaminate.contaminated(docs.limit(0), tests).count() == decontaminate.contaminated(docs, tests.limit(0)).count() == 0


def test_items_in_parts(spark, sf, monkeypatch):
    docs, tests = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, tests).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 3000)
    assert sorted(map(tuple, decontaminate.contaminated(docs, tests).collect())) == whole


def test_an_item_copied_everywhere_keeps_its_seeds(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, f"{item} {k}") for k in range(300)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, item), (2, "of the and is on of it by the way")], "item_id long, text string")
    assert decontaminate.contaminated(docs, tests).count() == 300


def test_an_edited_copy_in_thousands_of_documents(spark):
    """Every 6th word changed: 13 of 37 seeds survive, and all of them are common where thousands hold the copy."""
    own = [f"w{k}" for k in range(40)]
    edited = [f"new{k}" if k % 6 == 5 else w for k, w in enumerate(own)]
    texts = {k: " ".join([f"before{k}", *(edited if k % 3 else own[:8] + [f"fill{k}"] * 20), f"after{k}"]) for k in range(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    tests = spark.createDataFrame([(1, " ".join(own)), (2, "some other item of more words than four")], "item_id long, text string")
    number = {w: k + 1 for k, w in enumerate(own)}
    item = np.array([number[w] for w in own])
    best = decontaminate.smith_waterman([np.array([number.get(w, 0) for w in t.split()]) for t in texts.values()], [item] * len(texts))
    want = {(k, 1): b / 80 for k, b in zip(texts, best.tolist(), strict=True) if b / 80 >= 0.5}
    assert len(want) == 2000
    assert {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, tests).collect()} == want


@settings(deadline=None)
@given(st.integers(0, 50), st.integers(0, 400), st.integers(1, 40))
def test_windows_hold_every_run(first, size, span):
    pieces = list(decontaminate.windows(first, first + size, span))
    assert all(b - a <= 2 * span for a, b in pieces)
    assert all(any(a <= k and min(first + size, k + span) <= b for a, b in pieces) for k in range(first, first + size))


def test_a_document_that_repeats_an_item_over_millions_of_words(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(40))
    text = " ".join(f"{item} {k}" if k % 3 else item for k in range(50_000))
    items = decontaminate.Items([(7, item)], 4)
    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([text])], ["doc_id", "text"])
    (found,) = decontaminate._candidates(iter([batch]), items)
    assert max(len(w) for w in found.column(4).to_pylist()) <= 4 * 2 * decontaminate.SPAN * 40
    tracemalloc.start()
    (got,) = decontaminate._align(iter([found]), items, 0.5, {0: set()})
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert got.num_rows == found.num_rows and max(got.column(2).to_pylist()) == 1.0
