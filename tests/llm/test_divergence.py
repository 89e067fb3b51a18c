"""The divergence audit against every pair computed in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracery.llm import divergence

SCHEMA = "lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = [t.translate(lower) for t in TERM.findall(text or "")]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def share(c, kept=kept):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(total)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            terms = sorted((-apart(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def got(spark, rows, schema=SCHEMA, more=(), **how):
    frame = spark.createDataFrame([(*r, *more) for r in rows], schema)
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(frame, **how).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeéñ中" for b in ("", "x", "Y", "zz", "ß")]
    rows = [(rng.choice(["en", "de"]), f"s{rng.randrange(7)}", " ".join(rng.choices(words, k=rng.randrange(40)))) for _ in range(150)]
    return rows + [("en", "hot", " ".join(words[:5]) + " 1-a_B")] * 80


@pytest.mark.parametrize("how", [{}, {"held": 3}, {"cells": 16}, {"groups": 2}, {"groups": 1, "cells": 8, "held": 1}])
def test_all_pairs(spark, how):
    rows = corpus(1)
    assert got(spark, rows, **how) == plain(rows)


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = corpus(2) + [(None, None, None), (None, "a", "x y"), ("fr", "a", ""), ("fr", "b", None), ("fr", "", "un"), ("en", "no terms", "12 3"), ("en", None, "@[`{\x7f"), ("it", "alone", "una " * 30)] + [("it", "alone", "una UNA")] * 10
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, SCHEMA + ", term string, n int, part int, value string", ("t", 1, 2, "v")) == plain(rows)
    assert got(spark, []) == []


def test_pieces_cut_no_term(monkeypatch):
    text = "Ärger übt-Mann 中文a ".encode() * 30
    want = text.translate(divergence.TERM_BYTES).split()
    for n in (1, 2, 5, 64):
        monkeypatch.setattr(divergence, "PIECE", n)
        assert [t for piece in divergence.terms(text) for t in piece] == want


def test_shares_beyond_64_bits():
    count, whole = np.array([10**13, 5, 8 * 10**15]), np.array([3 * 10**13, 7, 9 * 10**15 - 1])
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]
