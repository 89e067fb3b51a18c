"""Packing and token files against the library's own tokens of each text."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import packing, rans, tokens
from tracery.llm.queries import word_tokenizer


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(deadline=None, max_examples=300)
@given(st.text() | st.text(st.sampled_from("aB. ,'’\n\t é0<|endoftxsr>ßİ́-")))
def test_ids(text):
    t = tokens.word_tokens(word_tokenizer())
    assert t.ids(text) == packed(t.whole.encode(text, add_special_tokens=False).ids)


def check_pieces(rows, texts, library, most):
    """rows of pack() hold every piece of every text once, in place; gives the number of sequences."""
    want = Counter()
    for doc, text in texts:
        ids = library(text)
        for k, at in enumerate(range(0, len(ids), most)):
            part = ids[at : at + most]
            want[(doc, k, at, len(part), zlib.crc32(packed(part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= most
    return len(by)


def best_fit(lengths, most):
    """Sequences that best fit, longest first, needs."""
    free = []
    for n in sorted(lengths, reverse=True):
        k = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if k is None:
            free.append(most - n)
        else:
            free[k] -= n
    return len(free)


def test_pack_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = packing.pack(docs, word_tokenizer()).collect()
    n = check_pieces(rows, texts, library, 4096)
    assert n <= best_fit([r.length for r in rows], 4096)


def test_pack_cases(spark, library):
    texts = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 500), (3, "word " * 500), (4, "x y " * 31 + "z"), (5, "long text " * 100_000)]
    docs = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, length int, rank int, salt int")
    check_pieces(packing.pack(docs, word_tokenizer(), most=64).collect(), texts, library, 64)
    assert packing.pack(docs.limit(0), word_tokenizer()).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 400), max_size=40), st.sampled_from([16, 64]))
def test_plan(histogram, bins):
    rows = packing.plan(histogram, 256, bins).tolist()
    placed, load = Counter(), defaultdict(list)
    for length, first, c, m, sequence, offset in rows:
        assert placed[length] == first
        placed[length] += c * m
        for s in range(m):
            load[sequence + s].append((offset, length * c))
    assert placed == Counter(histogram)
    for places in load.values():
        places.sort()
        assert [o for o, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        assert sum(n for _, n in places) <= 256
    lengths = list(Counter(histogram).elements())
    assert len(load) <= best_fit(lengths, 256) if len(lengths) < 3000 else True


def test_nnls_finds_the_least_residual():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a = rng.random((8, 12))
        b = rng.random(8) * 10
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and (gradient <= 1e-6).all() and abs(gradient[x > 0]).max(initial=0) < 1e-6


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=300), st.integers(1, 3))
def test_blocks_round_trip(ids, blocks):
    ids = np.array(ids, np.uint32)
    ids = np.concatenate([ids, np.full(-len(ids) % rans.LANES, ids[0], np.uint32)])
    ids = np.stack([np.roll(ids, k) for k in range(blocks)])
    table = rans.Table(np.bincount(ids.reshape(-1), minlength=701))
    assert (table.decode(table.encode(ids), ids.shape[1]) == ids).all()


def expected(texts, library):
    """Rows by ascending document, and the ids before each document's first row."""
    out, start = [], 0
    for doc, text in sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0)):
        ids = library(text)
        out.append((doc, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    return out


def test_files_of_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()], library)
    assert sorted(tuple(r) for r in rans.token_files(docs, word_tokenizer()).collect()) == want


def test_several_files_and_long_texts(spark, library, tmp_path):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["red", "house", "Übung", "x1", "."]) for _ in range(rng.choice([0, 5, 300])))) for k in rng.sample(range(1000), 60)]
    texts += [(2000, "long words here " * 60_000), (2001, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/corpus"
    written, table = rans.write_corpus(docs, folder, word_tokenizer(), file_bytes=4000)
    assert written.count() > 3
    got = sorted(tuple(r) for r in rans.read_corpus(written, folder, table).collect())
    assert got == expected(texts, library)
    assert {f.name for f in (tmp_path / "corpus").glob("part-*")} == {r.file for r in written.collect()}  # no attempt is left behind
    largest = max(written.collect(), key=lambda r: r.blocks)
    assert largest.blocks > 2
    uri = f"{folder}/{largest.file}"
    whole = [(d, p, i.tolist()) for d, p, i in rans.read_file(uri, table)]
    for size in (1, 2, 3):  # any ranges of blocks give every document once
        parts = [(d, p, i.tolist()) for k in range(0, largest.blocks, size) for d, p, i in rans.read_file(uri, table, k, k + size)]
        assert parts == whole
    broken = max((tmp_path / "corpus").glob("part-*.rans"), key=lambda f: f.stat().st_size)
    raw = bytearray(broken.read_bytes())
    raw[40] ^= 1
    broken.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        list(rans.read_file(f"file://{broken}", table))


def test_file_cases(spark, library):
    rows = [(5, "b"), (5, "b"), (5, "c c"), (None, "a"), (1, None), (2, "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, bucket int, ids int")
    got = sorted((tuple(r) for r in rans.token_files(docs, word_tokenizer()).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 2, 5, 5, 5] and [r[1] for r in got] == [0, *itertools.accumulate(r[2] for r in got)][:-1]
    assert Counter((r[0], r[2], r[3]) for r in got) == Counter((d, len(i), zlib.crc32(packed(i))) for d, i in ((d, library(t)) for d, t in rows))
    assert rans.token_files(docs.limit(0), word_tokenizer()).count() == 0
