"""Removed bytes against a table of every 50-byte string, and maximal repeats against all substrings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import suffix_dedup


def plain(rows, length=50):
    """Rows (doc_id, text) to rows of the result, by the smallest document of each string."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if doc is not None:
                least[s] = min(doc, least.get(s, doc))
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if least[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, **more):
    return sorted((tuple(r) for r in suffix_dedup.cut_repeats(docs, **more).collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r[2] for r in want) > 1000
    assert got(docs) == want


@pytest.mark.parametrize("part_bytes, hot", [(16 << 20, 2048), (3000, 2048), (3000, 2)])
def test_planted(spark, part_bytes, hot):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(9, 40))) for _ in range(12)] + ["ab" * 60, "x" * 300, "abc" * 17]
    rows = []
    for k in range(80):
        parts = [rng.choice(passages)[rng.choice([0, 0, 1, 7]) :] if rng.random() < 0.5 else " ".join(word() for _ in range(20)) for _ in range(6)]
        rows.append((rng.randrange(200), "".join(parts)))
    rows += [rows[3], (500, rows[5][1]), (None, rows[5][1]), (501, None), (502, ""), (503, rows[5][1][:50]), (504, rows[5][1][:49]), (505, "ab" * 30_000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, part int, row int").repartition(5)
    assert got(docs, part_bytes=part_bytes, hot=hot) == plain(rows)
    assert got(docs.limit(0)) == []


def test_a_common_line_in_different_surroundings(spark):
    """One line in every document: its anchors are dealt string by string, and no task has most of the rows."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line = word(70)
    rows = [(k, word(rng.randint(60, 90)) + line + word(rng.randint(60, 90))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(docs, hot=16) == got(docs) == plain(rows)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text("abc", max_size=30), min_size=1, max_size=4), st.integers(1, 4))
def test_repeat_groups(texts, least):
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int64)
    for k, t in enumerate(texts):
        text[start[k] : start[k] + size[k]] = np.frombuffer(t.encode(), np.uint8)
        text[start[k] + size[k]] = 256 + k
    sa, lcp = suffix_dedup.suffix_array(text, 64)
    symbols = text.tolist()
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])
    left = np.concatenate([[-1], np.where(text[:-1] < 256, text[:-1], -1)])
    found = {tuple(symbols[sa[lo] : sa[lo] + h]): sorted(sa[lo:hi].tolist()) for h, lo, hi in suffix_dedup.repeat_groups(sa, lcp, left, least)}
    joined, want = {}, {}
    for t, s in zip(texts, start.tolist(), strict=True):
        for a in range(len(t)):
            for b in range(a + least, len(t) + 1):
                joined.setdefault(tuple(symbols[s + a : s + b]), []).append(s + a)
    for sub, at in joined.items():
        before = {symbols[i - 1] if i and symbols[i - 1] < 256 else -1 - i for i in at}
        after = {symbols[i + len(sub)] for i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            want[sub] = sorted(at)
    assert {k: v for k, v in found.items() if k in want} == want
    assert all(joined[k] == v for k, v in found.items())


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 2) | st.just(100_000), max_size=40), st.integers(1, 20), st.integers(1, 12))
def test_suffix_array(symbols, top, least):
    """Any text, also one that ends in a repeat; prefixes below least may be told as 0."""
    sa, lcp = suffix_dedup.suffix_array(np.array(symbols, np.int64), top, least)
    assert sorted(sa.tolist()) == list(range(len(symbols)))
    cut = [symbols[i : i + top] for i in sa.tolist()]
    assert cut == sorted(cut)
    shared = [0, *(next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(cut, cut[1:], strict=False))][: len(cut)]
    assert all(have == want or (want < least and not have) for have, want in zip(lcp.tolist(), shared, strict=True))


def test_repeats_are_not_dealt_bundle_by_bundle(monkeypatch):
    """Each bundle gave a row for each part of documents, as many as both multiplied."""
    monkeypatch.setattr(suffix_dedup, "BUNDLE", 1)
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(60)).encode()
    rows = [(anchor, doc, doc, 0, bytes([65 + anchor]) + text, None) for anchor in range(20) for doc in range(8)]
    kinds = (*[pa.int64()] * 4, pa.binary(), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "doc", "row", "place", "content", "part"])
    out = [x for b in suffix_dedup._repeats(iter([batch]), 50, 4) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(out) <= 4
    assert sum(len(suffix_dedup._unpack(blob, **suffix_dedup.SPAN)["doc"]) for _, _, blob in out) >= 20 * 7


def test_no_larger_share_of_a_larger_table_is_dealt_string_by_string():
    """Anchors of a table twelve times as large have twelve times as many stretches; the bound was the same."""
    assert suffix_dedup.hot_from(10) == suffix_dedup.HOT < suffix_dedup.hot_from(200) < suffix_dedup.hot_from(400) <= suffix_dedup.HOT_MOST
    assert suffix_dedup.hot_from(1 << 20) == suffix_dedup.HOT_MOST
