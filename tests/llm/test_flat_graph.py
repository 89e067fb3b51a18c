"""Flat graph links against all pairs."""

import numpy as np
import pytest

from tests.llm.test_simhash import components
from tracery.llm import flat_graph

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, threshold=0.93):
    """{vec_id: (n_links, component_id, kept)} of rows (vec_id, label, vector) with distinct ids."""
    good = {}
    for vec_id, label, v in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[vec_id] = (label, np.array(v, np.float64))
    links = []
    ids = sorted(good)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links.append((a, b))
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    named = components([r[0] for r in rows], links)
    return {k: (n, named[k], named[k] == k) for k, n in count.items()}


def got(frame, **more):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in flat_graph.near_vectors(frame, **more).collect()}


def test_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = plain([tuple(r) for r in frame.select("vec_id", "label", "embedding").collect()])
    assert got(frame) == want


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(60):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 60)):
            rows.append((k, int(rng.integers(0, 2)), [float(np.float32(x)) for x in centre + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.5])]))
            k += 1
    centre = rng.normal(size=24)
    return rows + [(k + i, 0, [float(np.float32(x)) for x in centre * (1 + i % 3)]) for i in range(200)]


def test_many_small_shards(spark, clustered, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", 64)
    want = plain(clustered)
    frame = spark.createDataFrame(clustered, SCHEMA)
    assert got(frame, target=1.0, audits=4000) == want  # whatever the graphs missed is compared whole
    rows = flat_graph.near_vectors(frame, target=0.0, audits=4000).collect()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    links = sum(n for n, _, _ in want.values())
    assert all(found[k][0] <= n for k, (n, _, _) in want.items())
    assert sum(found[k][0] for k in want) >= 0.98 * links
    assert 0.9 < rows[0].audited_recall <= 1


def test_clusters_cover_and_follow_the_vectors(spark, clustered, monkeypatch):
    monkeypatch.setattr(flat_graph, "SHARD", 64)
    frame = spark.createDataFrame(clustered, SCHEMA).selectExpr("cast(label AS string) AS `group`", "vec_id AS rep", "1L AS copies", "embedding").toPandas()
    reps = spark.createDataFrame([(g, int(r), 1, np.array(e, "<f4").tobytes()) for g, r, e in zip(frame.group, frame.rep, frame.embedding)], "`group` string, rep long, copies long, vec binary")
    rows = flat_graph.clusters(reps, "<f4", 0.93, 4000).toPandas()
    homes = rows[rows.home]
    assert sorted(homes.rep) == sorted(frame.rep) and set(rows.groupby("rep").border.any().loc[lambda x: x].index) == set(rows.rep.value_counts().loc[lambda x: x > 1].index)
    sizes = rows.groupby("node").rep.nunique()
    assert sizes.max() <= 400 and len(sizes) > 8  # 200 equal directions stay together


def test_no_link_is_no_recall(spark):
    frame = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], SCHEMA)
    assert [r.audited_recall for r in flat_graph.near_vectors(frame).collect()] == [None, None]


def test_a_large_cell_is_dealt_by_members_and_queries(spark):
    own = spark.range(2000).selectExpr("id AS rep", "3L AS node", "cast('v' AS binary) AS vec", "1L AS copies", "id % 4 > 0 AS home", "false AS border", "20 AS parts", "cast(id % 20 AS int) AS part")
    shards = flat_graph._shards(own).groupBy("shard").agg({"*": "count"}).collect()
    assert len(shards) == 400 and max(r[1] for r in shards) <= 200
    met = flat_graph._shards(own)
    pairs = met.where("home").selectExpr("shard", "rep AS a").join(met.where("member").selectExpr("shard", "rep AS b"), "shard")
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 1500 * 2000


def test_prune_keeps_the_nearest(clustered):
    v = np.array([r[2] for r in clustered[:200]])
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    s = v @ v.T
    np.fill_diagonal(s, -9)
    near = np.argsort(-s, 1)[:, :40]
    kept = flat_graph.prune(v, near, 8)
    assert (kept[:, 0] == near[:, 0]).all()
    d = lambda a, b: 2 - 2 * v[a] @ v[b]
    for row in range(200):
        own = [x for x in kept[row].tolist() if x >= 0]
        for i, b in enumerate(own):
            assert all(1.44 * d(a, b) > d(row, b) - 1e-12 for a in own[:i])


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, None), (2, 0, []), (3, 0, [0.0, 0.0]), (4, 0, [1.0, None]), (5, 0, [nan, 1.0]), (6, 0, [inf, 1.0]), (7, None, [1.0, 0.0]), (8, 0, [1.0, 0.0]),
        (None, 0, [1.0, 0.0]), (9, 0, [2.0, 0.0]), (10, 1, [1.0, 0.0]), (11, 0, [1.0, 0.0]), (12, 0, [-0.0, 0.0]), (13, 0, [1.0, 0.0, 0.0]), (14, 0, [-1.0, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", links int, component string")
    found = got(frame)
    assert {k for k, (n, _, _) in found.items() if n} == {8, 9, 11} and len(found) == len(rows)
    assert all(found[k] == (2, 8, k == 8) for k in (8, 9, 11)) and all(found[k] == (0, k, True) for k in found if k not in (8, 9, 11))
    assert flat_graph.near_vectors(frame.limit(0)).count() == 0
    twice = flat_graph.near_vectors(frame.where("vec_id in (8, 10)").union(frame.where("vec_id = 8"))).collect()
    assert sorted((r.vec_id, r.n_links) for r in twice) == [(8, 1), (8, 1), (10, 0)]  # a repeated row is a copy
