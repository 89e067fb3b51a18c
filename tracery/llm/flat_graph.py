"""Embedding near-duplicates by a robust-pruned flat graph, built on overlapping cluster shards and searched by range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_key, components, drop_path, mixed, roots, run_arrow, stored

#: Members of a shard, and bytes of their vectors in double precision; longer vectors come in smaller shards.
SHARD, SHARD_BYTES = 8192, 32 << 20
#: Clusters into which one too large is split at once, and clusters that a vector near a border joins then.
FAN, OVERLAP = 64, 4
#: Out-edges kept by pruning, long edges beside them, and in-edges added back for the search.
NEAR, LONG, BACK = 16, 4, 16
CANDIDATES, ALPHA = 48, 1.2
QUERIES = 512
#: Vectors that meet one copy of their cluster's centres.
DEALT = 50_000
BLOB = "shard long, rep binary, copies binary, vec binary, member binary, home binary, border binary, out binary"


def _clean(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
        at = lists.offsets.to_numpy()
        v = lists.values.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)  # no negative zero
        usable = np.isfinite(v).astype(np.int64)  # a null component is not finite here
        good = np.concatenate([[0], np.cumsum(usable)])
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.concatenate([[0.0], np.cumsum(np.where(usable, v, 0).astype(np.float64) ** 2)])
            length = size[at[1:]] - size[at[:-1]]
        many = at[1:] - at[:-1]
        ok = (many > 0) & (good[at[1:]] - good[at[:-1]] == many) & np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(lists.is_valid())
        raw, width = v.tobytes(), np.dtype(kind).itemsize
        out: list[bytes | None] = [None] * len(ok)
        for i in np.flatnonzero(ok).tolist():
            own = v[at[i] : at[i + 1]].astype(np.float64)
            n = float(own @ own) if not (0 < length[i] < np.inf) or length[i] < 1e-6 * size[-1] else length[i]
            if 0 < n < np.inf:
                out[i] = raw[at[i] * width : at[i + 1] * width]
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def _matrix(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _centres(key: tuple, rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Unit centres of one cluster's sample, by a few rounds of spherical k-means."""
    v = _unit(_matrix(list(rows.vec), kind))
    k = max(1, min(int(rows.k.iloc[0]), len(v)))
    rng = np.random.default_rng(0)
    c = v[np.sort(rng.choice(len(v), k, replace=False))]
    for _ in range(8):
        own = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, v)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return pd.DataFrame({"node": [key[0]], "centres": [c.astype("<f8").tobytes()]})


def _assign(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each vector's nearest child of its cluster, and for a vector at home there the children near enough to hold one within the radius.

    Rows come by cluster and salt, the cluster's centres (without a vector) before its vectors.
    """
    radius = np.sqrt(2 - 2 * threshold)
    names = ["node", "rep", "vec", "copies", "home", "border", "n"]
    c, apart = np.zeros((0, 0)), np.zeros((0, 0))
    for batch in batches:
        centres = batch.column(batch.schema.get_field_index("centres"))
        cut = [0, *(np.flatnonzero(np.asarray(centres.is_valid()))).tolist(), batch.num_rows]
        for lo, hi in zip(cut, cut[1:], strict=False):
            if lo < hi and centres[lo].is_valid:
                raw = np.frombuffer(centres[lo].as_py(), "<f8")
                lo += 1
                c = raw.reshape(-1, int(batch.column(batch.schema.get_field_index("d"))[lo - 1].as_py()))
                apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
            if lo >= hi:
                continue
            rows = batch.slice(lo, hi - lo).select(names)
            home = rows.column(4).to_numpy(zero_copy_only=False).astype(bool)
            near = _unit(_matrix(rows.column(2).to_pylist(), kind)) @ c.T
            best = near.argmax(1)
            gap = near[np.arange(len(near)), best][:, None] - near - radius * apart[best]
            order = np.argsort(-near, axis=1, kind="stable")[:, :OVERLAP]
            joins = (np.take_along_axis(gap, order, 1) <= 0) & home[:, None]
            joins[:, 0] = True
            who, k = np.nonzero(joins)
            child = order[who, k]
            taken = rows.take(pa.array(who))
            node = mixed(taken.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + child.astype(np.uint64) + np.uint64(1)).view(np.int64)
            border = taken.column(5).to_numpy(zero_copy_only=False).astype(bool) | (joins.sum(1) > 1)[who]
            yield pa.RecordBatch.from_arrays([pa.array(node), *(taken.column(i) for i in (1, 2, 3)), pa.array(home[who] & (k == 0)), pa.array(border), taken.column(6)], [*names[:-1], "was"])


def prune(v: np.ndarray, candidates: np.ndarray, most: int, alpha: float = ALPHA) -> np.ndarray:
    """Robust pruning, for all rows at once: the nearest candidate stays, and those much nearer to it than to the row go.

    candidates: (rows, c) indices, -1 for none, nearest first. Gives (rows, most) indices, -1 for none.
    """
    n, c = candidates.shape
    out = np.full((n, most), -1)
    safe = np.maximum(candidates, 0)
    for lo in range(0, n, 64):
        own, ids = v[lo : lo + 64], safe[lo : lo + 64]
        vectors = v[ids]
        to_row = 2 - 2 * np.einsum("nd,ncd->nc", own, vectors)
        between = 2 - 2 * vectors @ vectors.transpose(0, 2, 1)
        open_ = candidates[lo : lo + 64] >= 0
        rows = np.arange(len(ids))
        for k in range(most):
            pick = np.where(open_, to_row, np.inf).argmin(1)
            got = open_[rows, pick]
            if not got.any():
                break
            out[lo : lo + 64, k] = np.where(got, ids[rows, pick], -1)
            covered = alpha * alpha * between[rows, pick] <= to_row
            open_ &= ~covered
            open_[rows, pick] = False
    return out


def build(v: np.ndarray) -> np.ndarray:
    """(n, NEAR + LONG) out-edges of one shard's unit vectors: pruned nearest ones and some at random places."""
    n = len(v)
    c = min(CANDIDATES, n - 1)
    if c <= 0:
        return np.full((n, NEAR + LONG), -1)
    v = v.astype(np.float32)
    near = np.empty((n, c), np.int64)
    for lo in range(0, n, 512):
        s = v[lo : lo + 512] @ v.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        near[lo : lo + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    far = (mixed(np.arange(n * LONG, dtype=np.uint64)) % np.uint64(n)).astype(np.int64).reshape(n, LONG)
    return np.concatenate([prune(v, near, NEAR), far], 1)


def _build(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """One row for each shard: its vectors, and the edges among its members as places in it."""
    for shard in by_key(batches, "shard"):
        raw = shard.column("vec").to_pylist()
        flags = [shard.column(x).to_numpy().astype(np.uint8) for x in ("member", "home", "border")]
        if not flags[0].any() or not flags[1].any():
            continue
        nodes = np.flatnonzero(flags[0])
        edges = build(_unit(_matrix([raw[i] for i in nodes.tolist()], kind)))
        numbers = [shard.column("rep").to_numpy().astype("<i8"), shard.column("copies").to_numpy().astype("<i8")]
        blobs = [*(x.tobytes() for x in numbers), b"".join(raw), *(x.tobytes() for x in flags), edges.astype("<i4").tobytes()]
        yield pa.RecordBatch.from_arrays([shard.column("shard")[:1].combine_chunks(), *(pa.array([b], pa.large_binary()).cast(pa.binary()) for b in blobs)], [x.split()[0] for x in BLOB.split(", ")])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of vectors that are members of several shards."""
    for batch in batches:
        for k in range(batch.num_rows):
            at = {x: batch.column(batch.schema.get_field_index(x))[k].as_py() for x in ("shard", "rep", "member", "border", "out")}
            rep, member, border = np.frombuffer(at["rep"], "<i8"), np.frombuffer(at["member"], "u1") > 0, np.frombuffer(at["border"], "u1") > 0
            nodes = np.flatnonzero(member)
            edges = np.frombuffer(at["out"], "<i4").reshape(len(nodes), -1)
            rows = np.flatnonzero(border[nodes])
            lists = [rep[nodes[e[e >= 0]]] for e in edges[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(rep[nodes[rows]]), pa.array(np.full(len(rows), at["shard"])), pa.array(lists, pa.list_(pa.int64()))], ["rep", "shard", "out"])


def search(v: np.ndarray, edges: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of similarity >= threshold, and some just below: greedy search from the medoid, then outward through all in range.

    edges: (n, r) indices, -1 for none. own: each query's node, -1 if it is none of this graph's; its edges
    are followed too. Pairs hold no query with its own node.
    """
    n, q = len(v), len(queries)
    v, queries, threshold = v.astype(np.float32), queries.astype(np.float32), threshold - 1e-5  # pairs are verified later
    beam = min(beam, n)
    medoid = int((v @ v.mean(0)).argmax())
    seen = np.zeros((q, n + 1), bool)  # the last column stands for no node
    rows = np.arange(q)
    ids, sims = np.full((q, beam), n), np.full((q, beam), -np.inf)
    done = np.ones((q, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, queries @ v[medoid], False
    seen[:, medoid] = True
    padded, table = np.concatenate([v, np.zeros((1, v.shape[1]), np.float32)]), np.concatenate([np.where(edges < 0, n, edges), np.full((1, edges.shape[1]), n)])
    inside: list[tuple[np.ndarray, np.ndarray]] = [(rows[sims[:, 0] >= threshold], np.full(int((sims[:, 0] >= threshold).sum()), medoid))]
    for _ in range(2 * beam):
        pick = np.where(done, -np.inf, sims).argmax(1)
        live = np.flatnonzero(~done[rows, pick])
        if not len(live):
            break
        done[live, pick[live]] = True
        new = table[ids[live, pick[live]]]
        new = np.where(seen[live[:, None], new], n, new)
        seen[live[:, None], new] = True
        s = (padded[new] @ queries[live][:, :, None])[:, :, 0]
        s[new == n] = -np.inf
        a, b = np.nonzero(s >= threshold)
        inside.append((live[a], new[a, b]))
        every, value = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], s], 1)
        over = np.concatenate([done[live], new == n], 1)
        top = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (every, value, over))
    a, b = (np.concatenate(x) for x in zip(*inside, strict=True))
    known = own >= 0
    pairs = np.unique(np.concatenate([a * (n + 1) + b, rows[known] * (n + 1) + own[known]]))
    front, found = pairs, [pairs]
    while len(front):
        grown = []
        for lo in range(0, len(front), 8192):
            part = front[lo : lo + 8192]
            a = np.repeat(part // (n + 1), table.shape[1])
            b = table[part % (n + 1)].reshape(-1)
            fresh = ~seen[a, b] & (b < n)
            pair = np.unique(a[fresh] * (n + 1) + b[fresh])
            a, b = pair // (n + 1), pair % (n + 1)
            seen[a, b] = True
            near = np.einsum("pd,pd->p", queries[a], v[b]) >= threshold
            grown.append(pair[near])
        front = np.setdiff1d(np.concatenate(grown), pairs) if len(found) == 1 else np.concatenate(grown)
        found.append(front)
    pairs = np.unique(np.concatenate(found))
    a, b = pairs // (n + 1), pairs % (n + 1)
    other = own[a] != b
    return a[other], b[other]


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", x, y) / (np.sqrt(np.einsum("nd,nd->n", x, x)) * np.sqrt(np.einsum("nd,nd->n", y, y)))


def united(edges: np.ndarray, rep: np.ndarray, extra: list[dict]) -> np.ndarray:
    """A shard's edges united with its members' lists from other shards, and in-edges added back: (n, r) places, -1 for none."""
    n = len(rep)
    source, target = np.nonzero(edges >= 0)
    target = edges[source, target].astype(np.int64)
    if extra:
        order = np.argsort(rep, kind="stable")
        a = np.repeat(np.array([x["rep"] for x in extra], np.int64), [len(x["out"]) for x in extra])
        b = np.concatenate([np.asarray(x["out"], np.int64) for x in extra])
        place = [np.minimum(np.searchsorted(rep[order], x), n - 1) for x in (a, b)]
        here = (rep[order][place[0]] == a) & (rep[order][place[1]] == b)
        a, b = (order[p][here] for p in place)
        pairs = np.unique(np.concatenate([source * n + target, a * n + b]))
        source, target = pairs // n, pairs % n

    def rows(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        out = np.full((n, min(most, int(rank.max(initial=0)) + 1)), -1)
        kept = rank < most
        out[a[kept], rank[kept]] = b[kept]
        return out

    mix = np.argsort(mixed(source.astype(np.uint64) * np.uint64(n) + target.astype(np.uint64)), kind="stable")
    return np.concatenate([rows(source, target, OVERLAP * (NEAR + LONG)), rows(target[mix], source[mix], BACK)], 1)


def _joined(rep: np.ndarray, label: np.ndarray, asking: np.ndarray, links: np.ndarray, distinct: np.ndarray) -> pa.RecordBatch:
    """Rows of a shard: how many links each query has, and edges that join what links."""
    joined = np.flatnonzero(label != np.arange(len(rep)))
    none = [None] * len(joined)
    columns = [np.concatenate([rep[asking], rep[joined]]), pa.array([*[None] * len(asking), *rep[label[joined]].tolist()], pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), columns[1], *(pa.array([*x.tolist(), *none], pa.int64()) for x in (links, distinct))], ["rep", "to", "links", "others"])


def _count(raw: np.ndarray, copies: np.ndarray, x: np.ndarray, y: np.ndarray, place: np.ndarray, threshold: float, label: np.ndarray, links: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Verify candidate pairs (x, y) in double precision, count those that link, and join them in label."""
    for k in range(0, len(x), 1 << 15):
        a, b, at = (z[k : k + (1 << 15)] for z in (x, y, place))
        real = _cosine(raw[a], raw[b]) >= threshold
        np.add.at(links, at[real], copies[b[real]])
        np.add.at(distinct, at[real], 1)
        a, b = label[a[real]], label[b[real]]
        new = a != b
        if new.any():
            label = roots(len(label), a[new], b[new])[label]
    return label


def _search(batches: Iterator[pa.RecordBatch], kind: str, threshold: float, beam: int) -> Iterator[pa.RecordBatch]:
    """For each query of a shard the copies it links to, and edges that join what links: never all pairs."""
    for batch in batches:
        for k in range(batch.num_rows):
            s = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
            rep, copies = np.frombuffer(s["rep"], "<i8"), np.frombuffer(s["copies"], "<i8")
            raw = np.frombuffer(s["vec"], kind).reshape(len(rep), -1).astype(np.float64)
            nodes, asking = np.flatnonzero(np.frombuffer(s["member"], "u1")), np.flatnonzero(np.frombuffer(s["home"], "u1"))
            own = np.full(len(rep), -1)
            own[nodes] = np.arange(len(nodes))
            v = _unit(raw)
            edges = united(np.frombuffer(s["out"], "<i4").reshape(len(nodes), -1), rep[nodes], s["extra"] or [])
            label, links, distinct = np.arange(len(rep)), np.zeros(len(asking), np.int64), np.zeros(len(asking), np.int64)
            for lo in range(0, len(asking), QUERIES):
                part = asking[lo : lo + QUERIES]
                a, b = search(v[nodes], edges, v[part], own[part], threshold - 1e-9, beam)
                label = _count(raw, copies, part[a], nodes[b], lo + a, threshold, label, links, distinct)
            yield _joined(rep, label, asking, links, distinct)


def _compare(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """As _search, every query of a shard against every member, in blocks."""
    for shard in by_key(batches, "shard"):
        rep, copies = shard.column("rep").to_numpy(), shard.column("copies").to_numpy()
        raw = _matrix(shard.column("vec").to_pylist(), kind)
        nodes, asking = (np.flatnonzero(shard.column(x).to_numpy().astype(bool)) for x in ("member", "home"))
        if not len(nodes) or not len(asking):
            continue
        v = _unit(raw)
        label, links, distinct = np.arange(len(rep)), np.zeros(len(asking), np.int64), np.zeros(len(asking), np.int64)
        for lo in range(0, len(asking), QUERIES):
            a, b = np.nonzero(v[asking[lo : lo + QUERIES]] @ v[nodes].T >= threshold - 1e-9)
            other = asking[lo + a] != nodes[b]
            a, b = a[other], b[other]
            label = _count(raw, copies, asking[lo + a], nodes[b], lo + a, threshold, label, links, distinct)
        yield _joined(rep, label, asking, links, distinct)


def _brute(batches: Iterator[pa.RecordBatch], asked: dict[str, tuple[np.ndarray, np.ndarray]], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of asked vectors to all other vectors of their labels, compared in blocks."""
    for batch in batches:
        group, rep = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        for g, (ids, raw) in asked.items():
            at = np.flatnonzero(group == g)
            if len(at):
                m = _matrix(batch.column(2).take(pa.array(at)).to_pylist(), kind)
                a, b = np.nonzero(_unit(raw) @ _unit(m).T >= threshold - 1e-9)
                real = (_cosine(raw[a], m[b]) >= threshold) & (ids[a] != rep[at[b]])
                n = np.bincount(a[real], minlength=len(ids))
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit].astype(np.int64))], ["rep", "n"])


def _shards(own: DataFrame) -> DataFrame:
    """Rows (shard, rep, vec, copies, home, member, border): a shard has one part of a cluster's members and asks one part of its vectors.

    Members are repeated for each part that asks, so a shard holds two parts at most, however large its
    cluster; a vector asks every part of its own cluster.
    """
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = own.withColumn("asks", each).withColumn("to", F.col("part")).withColumn("member", F.lit(True)).withColumn("home", F.col("home") & (F.col("asks") == F.col("part")))
    others = own.where("home").withColumn("asks", F.col("part")).withColumn("to", each).where("to <> part").withColumn("member", F.lit(False))
    every = members.unionByName(others).withColumn("shard", F.xxhash64("node", "to", "asks"))
    return every.select("shard", "rep", "vec", "copies", "home", "member", "border")


def _parts(cells: DataFrame) -> DataFrame:
    """cells with the part of its cluster that each row belongs to: as many as its members need."""
    sizes = cells.groupBy("node").agg(F.count("*").alias("n"), F.first("most").alias("_most"))
    own = cells.join(sizes, "node").withColumn("parts", F.ceil(F.col("n") / F.col("_most")).cast("int"))
    return own.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("parts")).cast("int"))


def clusters(reps: DataFrame, kind: str, threshold: float, max_sample: int) -> DataFrame:
    """Rows (node, rep, vec, copies, home, border, most): each vector at home in one cluster, and a member of others near its border.

    A cluster of more than 2 x `most` vectors is split into up to FAN around centres of its sample, again
    and again, until all are small enough or a split parts nothing. So there are as many clusters as the
    vectors need, and each level compares a vector with FAN centres at most.
    """
    spark = reps.sparkSession
    width = F.octet_length("vec") / np.dtype(kind).itemsize
    most = F.greatest(F.lit(64), F.least(F.lit(SHARD), F.floor(F.lit(SHARD_BYTES // 8) / width))).cast("int")
    none = F.lit(None)
    rows = reps.select(F.xxhash64("group").alias("node"), "rep", "vec", "copies", F.lit(True).alias("home"), F.lit(False).alias("border"), none.cast("long").alias("was"))
    kept = None
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.count_if("home").alias("asks"), F.max("was").alias("was"), F.first(most).alias("most"), F.first(width).cast("int").alias("d"))
        big, big_path = stored(sizes.where((F.col("asks") > 0) & (F.col("n") > 2 * F.col("most")) & (F.col("was").isNull() | (F.col("n") <= 0.5 * F.col("was")))).drop("was"), "big")
        if not big.limit(1).count():
            return rows.drop("was").withColumn("most", most)
        k = F.least(F.lit(FAN), F.ceil(OVERLAP * F.col("n") / F.col("most"))).cast("int")
        share = F.least(F.lit(1.0), F.lit(max_sample) / F.col("asks")) * (1 << 20)
        sample = rows.where("home").join(big, "node").where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < share).select("node", "vec", k.alias("k"))
        centres, centres_path = stored(sample.groupBy("node").applyInPandas(lambda key, x: _centres(key, x, kind), "node long, centres binary"), "centres")
        told = big.join(centres, "node").withColumn("salts", F.ceil(F.col("n") / DEALT).cast("int"))
        heads = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        heads = heads.select("node", "salt", none.cast("long").alias("rep"), none.cast("binary").alias("vec"), none.cast("long").alias("copies"), F.lit(False).alias("home"), F.lit(False).alias("border"), "n", "centres", "d")
        dealt = rows.drop("was").join(told.select("node", "n", "salts"), "node").withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(13)), F.col("salts")).cast("int"))
        dealt = dealt.select("node", "salt", "rep", "vec", "copies", "home", "border", "n", none.cast("binary").alias("centres"), none.cast("int").alias("d"))
        both = heads.union(dealt).repartition("node", "salt").sortWithinPartitions("node", "salt", F.col("centres").isNull())
        split = run_arrow(both, _assign, "node long, rep long, vec binary, copies long, home boolean, border boolean, was long", kind=kind, threshold=threshold)
        before = kept
        rows, kept = stored(rows.join(told.select("node"), "node", "left_anti").unionByName(split), "clusters")
        for path in (before, big_path, centres_path):
            if path:
                drop_path(spark, path)


def near_vectors(vectors: DataFrame, threshold: float = 0.93, beam: int = 32, max_sample: int = 4000, target: float = 0.99, audits: int = 400, most_audits: int = 4000) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, audited_recall.

    vectors has vec_id, label and embedding; other columns are ignored. Vectors link when their labels are
    equal and their cosine in double precision is at least the threshold, so a tie with it links. A null
    vec_id or label, and a vector that is null, empty, zero or holds null or non-finite components, links
    with nothing. Vectors of other dimension within a label are kept apart; a long vector makes its shards
    smaller. Equal vectors are one node of the graph and links of each other; repeated rows count as copies.
    No vectors give no rows.

    A label's vectors are one cluster or, beyond 2 x SHARD, many that overlap; a task holds one shard. About
    `audits` vectors, up to `most_audits` if fewer than 200 links are met, are compared with all others of
    their label. A label of which less than the target share of the links was found is compared whole, in
    blocks. audited_recall is the share found before that, links between distinct vectors counted once each,
    and null where the audit met no link.
    """
    spark = vectors.sparkSession
    real = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if real else "<f8"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if real else "array<double>").alias("embedding"))
    clean = run_arrow(own, _clean, "vec_id long, label string, vec binary", kind=kind)
    valid = clean.where("vec is not null").withColumn("group", F.concat_ws("/", F.octet_length("vec"), "label")).withColumn("digest", F.unhex(F.sha2("vec", 256)))
    reps, reps_path = stored(valid.groupBy("group", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "reps")
    total = reps.count()
    tasks = max(4 * spark.sparkContext.defaultParallelism, total // SHARD)
    found_columns = "rep long, to long, links long, others long"

    def dealt(cells: DataFrame) -> DataFrame:
        return _shards(_parts(cells)).repartition(tasks, "shard").sortWithinPartitions("shard", "rep")

    built, built_path = stored(run_arrow(dealt(clusters(reps, kind, threshold, max_sample)), _build, BLOB, kind=kind), "shards")
    lists = run_arrow(built.select("shard", "rep", "member", "border", "out"), _lists, "rep long, shard long, out array<long>")
    shared = lists.groupBy("rep").agg(F.collect_set("shard").alias("shards"), F.array_distinct(F.flatten(F.collect_list("out"))).alias("out")).where(F.size("shards") > 1)
    extra = shared.select("rep", "out", F.explode("shards").alias("shard")).groupBy("shard").agg(F.collect_list(F.struct("rep", "out")).alias("extra"))
    found, _ = stored(run_arrow(built.drop("border").repartition(tasks, "shard").join(extra.repartition(tasks, "shard"), "shard", "left"), _search, found_columns, kind=kind, threshold=threshold, beam=beam), "links")
    drop_path(spark, built_path)

    recall, poor = None, []
    for many in (audits, most_audits):
        rows = reps.where(F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(max(1, total))) < many).select("group", "rep", "vec").collect() if total else []
        asked = {g: [r for r in rows if r.group == g] for g in sorted({r.group for r in rows})}
        matrices = {g: (np.array([r.rep for r in of], np.int64), _matrix([r.vec for r in of], kind)) for g, of in asked.items()}
        truth = run_arrow(reps.select("group", "rep", "vec"), _brute, "rep long, n long", asked=matrices, kind=kind, threshold=threshold).groupBy("rep").agg(F.sum("n").alias("n"))
        told = {r.rep: (r.n, r.got or 0) for r in truth.join(found.where("others is not null").groupBy("rep").agg(F.sum("others").alias("got")), "rep", "left").collect()}
        share = {g: [sum(x) for x in zip(*(told[r.rep] for r in of if r.rep in told), strict=True)] for g, of in asked.items()}
        met = sum(x[0] for x in share.values() if x)
        recall = sum(x[1] for x in share.values() if x) / met if met else None
        poor = [g for g, x in share.items() if x and x[1] < target * x[0]]
        if met >= 200 or many >= total:
            break
    if poor:  # the exact way
        again = reps.where(F.col("group").isin(poor))
        cells = again.select(F.xxhash64("group").alias("node"), "rep", "vec", "copies", F.lit(True).alias("home"), F.lit(False).alias("border"), F.lit(SHARD).alias("most"))
        exact = run_arrow(dealt(cells), _compare, found_columns, kind=kind, threshold=threshold)
        found, _ = stored(found.join(again.select("rep"), "rep", "left_anti").select(*found.columns).union(exact), "links")
    counts = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("rep"), "component")
    result = reps.select("group", "digest", "rep", "copies").join(counts, "rep", "left").join(named, "rep", "left")
    result, _ = stored(result.select("group", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    drop_path(spark, reps_path)
    linked = valid.select("vec_id", "group", "digest").join(result, ["group", "digest"]).select("vec_id", "n_links", "component_id")
    alone = clean.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = linked.unionByName(alone)
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).withColumn("audited_recall", F.lit(recall).cast("double"))
