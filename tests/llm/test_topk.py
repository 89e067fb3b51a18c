"""Exact top-k against all products in Python's integers."""

import math

import numpy as np
import pytest

from tracery.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=5, every=50):
    """[(query_id, rank, vec_id, score)] of rows (vec_id, vector) with distinct ids."""
    own = {i: [math.floor(256 * float(x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in own.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in own.items() if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def got(frame, **more):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, **more).collect())


def test_embeddings(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.select("vec_id", "embedding").collect()]
    assert got(frame) == plain(rows)
    assert got(frame, tile_bytes=8_000, block=3, depth=6, parties=3) == plain(rows)  # many tiles and query blocks


@pytest.mark.parametrize("seed", [0, 1])
def test_ties_copies_and_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    hot = [0.5, -0.25, 0.125]
    rows = [(i, hot if i % 3 == 0 else [float(x) for x in rng.integers(-2, 3, 3) / 4]) for i in range(-100, 500)]
    rows += [(600 + i, [float(x) for x in rng.normal(size=2)]) for i in range(60)]  # another length
    rows += [(700, []), (701, []), (750, [0.0] * 3), (800, None), (850, [1.0, None, 2.0]), (900, [float("nan")] * 3), (950, [float("inf"), 0.0, 0.0]), (None, hot)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(frame) == plain(rows)
    assert got(frame, tile_bytes=500, block=2, depth=6) == plain(rows)


def test_few_rows_empty_table_and_other_columns(spark):
    rows = [(0, [1.0]), (50, [2.0]), (51, [-3.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", query_id string, rank int")
    assert got(frame) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_an_id_of_several_rows_counts_once(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [1.0]), (0, [0.5]), (1, [3.0]), (1, [3.0]), (2, [1.0])], SCHEMA)
    assert got(frame) == plain([(0, [0.5]), (1, [3.0]), (2, [1.0])])


def test_large_components(spark):
    rows = [(i, [float(16 * 2.0 ** (i % 7 * 3)), -float(i) * 2.0**12, 0.3]) for i in range(0, 60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(frame) == plain(rows)


def test_only_what_reaches_the_cutoff_is_collected(spark):
    """Phase 2 tells few of all shares where the cutoff is good."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    row = {"dim": 32, "chunk": 0, "party": 0, "block": -1, "n": len(x), "columns": 16, "values": x.tobytes(), "cut": None}
    asked = row | {"block": 0, "n": 4, "values": x[:4].tobytes(), "cut": np.array([40, 40, 40, np.iinfo(np.int64).min]).tobytes()}
    batch = pa.RecordBatch.from_pylist([row, asked])
    told = [r for b in topk._told(iter([batch]), 2, 32) for r in b.to_pylist()]
    q = np.concatenate([np.frombuffer(r["q"], np.int32) for r in told])
    assert np.bincount(q)[3] == len(x) and (np.bincount(q)[:3] < 60).all()
