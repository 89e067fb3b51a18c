"""SimHash groups against all pairs of fingerprints, written out plainly."""

import itertools
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracery.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_groups(texts):
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    named = components(fps, links)
    return {(d, f"{fps[d]:016x}", named[d]) for d in texts}


@settings(deadline=None)
@given(st.text(st.sampled_from("aB \t\x0b\x1cÀ\x00\n.")))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for bits in itertools.combinations(range(64), 3):
        off = sum(1 << b for b in bits)
        assert any(int(m) & off == 0 for m in masks)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_groups({r.doc_id: r.text for r in docs.collect()})
    got = {tuple(r) for r in simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == want
    assert len({c for _, _, c in got}) < len(got)


def test_hot_bucket_in_parts(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for k in range(300):  # a long chain and a star, all in few buckets, and strangers
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))))
        fps.add(rng.getrandbits(64))
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    want = components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    for part in (8192, 16):
        edges = simhash.fingerprint_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, part)
        got = components(signed, [tuple(r) for r in edges.collect()])
        assert got == want


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d"), (4, "a b c d"), (5, "A b C d"), (None, "a b c d"), (7, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, fp int, component_id string, key int")
    got = sorted((tuple(r) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[1][1:] == by[2][1:] == by[3][1:] == ("0" * 16, 1)
    assert by[4][2] == by[5][2] == by[None][2] == 4 and by[7][2] == 7
    assert simhash.simhash_groups(docs.limit(0)).count() == 0
