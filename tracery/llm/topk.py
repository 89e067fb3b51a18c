"""Exact top-k by inner product in three phases under one uniform threshold.

Vectors are dealt into chunks, and their components into parties: a tile is one party's components of a chunk, and its
scores are a party's share of a product. Phase 1 gathers each tile's list of best shares; their exact products give
each query a cutoff that its k-th best product cannot be below. Phase 2 sends the cutoff to all tiles: a vector that
reaches it has a share of a party-th of it in at least one tile, and those are collected. Phase 3 looks up the shares
that are missing. No other vector can be among the k best, so the result is exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, run_arrow, stored

#: Parts of the components: with each part more the cutoff's share tells less.
PARTIES = 2
#: Bytes of a tile, queries of a block, and shares of a tile's first list for each query.
TILE_BYTES, BLOCK, DEPTH = 2 << 20, 128, 32
#: Shares that leave a long do not fit in, where they stay.
ENDS = 1 << 61
#: Pairs whose missing shares are computed at once.
AT_ONCE = 1 << 16


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of a list column's values, as doubles that hold it exactly."""
    return np.floor(256 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))


def _bound(a: np.ndarray, b: np.ndarray) -> float:
    most = lambda x: float(np.abs(x).max()) if x.size else 0.0
    return most(a) * most(b) * a.shape[1]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products a @ b.T in Python's integers, kept between the ends."""
    own = a.astype(object)
    for at in np.ndindex(own.shape):
        own[at] = int(a[at])
    out = np.zeros((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        other = [int(x) for x in row]
        out[:, j] = [max(-ENDS, min(ENDS, sum(map(int.__mul__, x, other)))) for x in own]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in floats where these hold each sum."""
    bound = _bound(q, x)
    if bound < 1 << 24:
        return np.rint(q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return _exact(q, x)


def paired(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows that belong together."""
    if _bound(q, x) < 1 << 53:
        return np.einsum("ij,ij->i", q.astype(np.float64), x.astype(np.float64)).astype(np.int64)
    return np.array([_exact(q[i : i + 1], x[i : i + 1])[0, 0] for i in range(len(q))], np.int64)


#: block is -1 for a tile, and a query block's number for one; ids are those of its vectors, `each` how many a vector has.
PART = "dim int, chunk int, party int, block int, n int, columns int, ids binary, each binary, values binary"
PART_NAMES = [x.split()[0] for x in PART.split(", ")]


def _parts(batches: Iterator[pa.RecordBatch], parties: int, queries: bool) -> Iterator[pa.RecordBatch]:
    """A row for each party of each tile or query block: of rows (key, dim, place, ids, embedding) by key."""
    for part in by_key(batches, "key"):
        dim, place, n = part["dim"][0].as_py(), part["place"][0].as_py(), part.num_rows
        values = np.concatenate([whole_numbers(c) for c in part["embedding"].chunks]).reshape(n, dim)
        ids = part["ids"].combine_chunks()
        flat, each = ids.flatten().to_numpy().astype(np.int64), np.asarray(ids.value_lengths()).astype(np.int32)
        kind = np.float32 if not values.size or np.abs(values).max() <= 1 << 24 else np.float64
        cuts = np.linspace(0, dim, parties + 1).astype(int)
        rows = [
            (dim, 0 if queries else place, p, place if queries else -1, n, hi - lo, flat.tobytes(), each.tobytes(), values[:, lo:hi].astype(kind).tobytes())
            for p, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))
        ]
        kinds = [pa.int32()] * 6 + [pa.binary()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], PART_NAMES)


def _matrix(row: dict) -> np.ndarray:
    n, columns, values = row["n"], row["columns"], row["values"]
    if not n * columns:
        return np.zeros((n, columns))
    return np.frombuffer(values, np.float32 if len(values) == 4 * n * columns else np.float64).reshape(n, columns)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


ENTRIES = "dim int, chunk int, party int, block int, q binary, x binary, share binary"


def _told(batches: Iterator[pa.RecordBatch], parties: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Phases 1 and 2: the shares that a tile tells of each query block, after the tile in the task's rows.

    Of queries with a cutoff those that are a party's part of it or more, of others the `depth` greatest.
    """
    x = np.zeros((0, 0))
    for row in _rows(batches):
        if row["block"] < 0:
            x = _matrix(row)
            continue
        share = products(_matrix(row), x)
        if row["cut"] is None:
            least = min(depth, share.shape[1])
            at = np.argpartition(-share, least - 1, axis=1)[:, :least] if least else np.zeros((len(share), 0), np.int64)
            q, x_at = np.repeat(np.arange(len(share)), least), at.ravel()
        else:
            q, x_at = np.nonzero(parties * share >= np.frombuffer(row["cut"], np.int64)[:, None])
        for lo in range(0, len(q), AT_ONCE):
            a, b = q[lo : lo + AT_ONCE], x_at[lo : lo + AT_ONCE]
            values = [row["dim"], row["chunk"], row["party"], row["block"], a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes(), share[a, b].tobytes()]
            kinds = [pa.int32()] * 4 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in ENTRIES.split(", ")])


def _leading(q: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first entries of each query, by score and then by id."""
    order = np.lexsort((id_, -score, q))
    own = q[order]
    first = np.searchsorted(own, own)
    return order[np.arange(len(own)) - first < k]


BEST = "dim int, block int, n int, queries binary, q binary, ids binary, scores binary"
BEST_NAMES = [x.split()[0] for x in BEST.split(", ")]


def _best(dim: int, block: int, n: int, queries: bytes, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    values = [dim, block, n, queries, q.astype(np.int32).tobytes(), ids.tobytes(), scores.tobytes()]
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], BEST_NAMES)


def _resolved(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Phase 3: the k best rows of a chunk for each query, of the entries that its tiles told, with the shares that none told.

    Rows of a chunk: its tiles, then for each query block its parties and their entries.
    """
    tiles: list[dict] = []
    x: list[np.ndarray] = []
    asked: list[dict] = []
    entries: list[dict] = []

    def block() -> Iterator[pa.RecordBatch]:
        n = tiles[0]["n"] if tiles else 0
        told = {}
        for p in {e["party"] for e in entries}:
            own = [e for e in entries if e["party"] == p]
            q, at = (np.concatenate([np.frombuffer(e[c], np.int32) for e in own]).astype(np.int64) for c in ("q", "x"))
            code, share = q * n + at, np.concatenate([np.frombuffer(e["share"], np.int64) for e in own])
            order = np.argsort(code)
            told[p] = code[order], share[order]
        if not told:
            return
        pairs = np.unique(np.concatenate([code for code, _ in told.values()]))
        q, at, total = pairs // n, pairs % n, np.zeros(len(pairs), np.int64)
        for p in range(len(x)):
            code, share = told.get(p, (np.zeros(0, np.int64),) * 2)
            place = np.searchsorted(code, pairs)
            here = np.zeros(len(pairs), bool)
            here[place < len(code)] = code[place[place < len(code)]] == pairs[place < len(code)]
            total[here] += share[place[here]]
            missing, mine = np.flatnonzero(~here), _matrix(asked[p])
            for lo in range(0, len(missing), AT_ONCE):
                m = missing[lo : lo + AT_ONCE]
                total[m] += paired(mine[q[m]], x[p][at[m]])
        ids, each = np.frombuffer(tiles[0]["ids"], np.int64), np.frombuffer(tiles[0]["each"], np.int32).astype(np.int64)
        start = np.cumsum(each) - each
        lead = _leading(q, total, ids[start[at]], k)  # a vector's smallest id stands for it: k vectors have the k best rows
        q, at, total = q[lead], at[lead], total[lead]
        own = np.repeat(np.arange(len(at)), each[at])
        ids = ids[start[at][own] + np.arange(len(own)) - np.repeat(np.cumsum(each[at]) - each[at], each[at])]
        q, total = q[own], total[own]
        lead = _leading(q, total, ids, k)
        yield _best(asked[0]["dim"], asked[0]["block"], asked[0]["n"], asked[0]["ids"], q[lead], ids[lead], total[lead])

    for row in _rows(batches):
        if row["kind"] < 2 and row["party"] == 0:
            if asked:
                yield from block()
            asked, entries = [], []
            if row["kind"] == 0:
                tiles, x = [], []
        if row["kind"] == 0:
            tiles.append(row)
            x.append(_matrix(row))
        elif row["kind"] == 1:
            asked.append(row)
        else:
            entries.append(row)
    if asked:
        yield from block()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row for each query block, of its rows of all chunks."""
    last: dict | None = None
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def lead() -> tuple[np.ndarray, ...]:
        q, ids, scores = (np.concatenate(c) for c in zip(*held, strict=True))
        at = _leading(q, scores, ids, k)
        return q[at], ids[at], scores[at]

    for row in _rows(batches):
        if last and (last["dim"], last["block"]) != (row["dim"], row["block"]):
            yield _best(last["dim"], last["block"], last["n"], last["queries"], *lead())
            held, size = [], 0
        last = row
        held.append((np.frombuffer(row["q"], np.int32), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["scores"], np.int64)))
        size += len(held[-1][0])
        if size >= 1 << 20:
            held, size = [lead()], 0
    if last:
        yield _best(last["dim"], last["block"], last["n"], last["queries"], *lead())


def _cut(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(dim, block, cut): the k-th score of each query, the least of all longs where it has fewer."""
    for row in _rows(batches):
        q, scores = np.frombuffer(row["q"], np.int32), np.frombuffer(row["scores"], np.int64)
        cut = np.full(row["n"], np.iinfo(np.int64).min)
        full = np.bincount(q, minlength=row["n"]) >= k
        last = np.searchsorted(q, np.arange(row["n"]), "right") - 1
        cut[full] = scores[last[full]]
        yield pa.RecordBatch.from_arrays([pa.array([row["dim"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([cut.tobytes()], pa.binary())], ["dim", "block", "cut"])


FOUND = "query long, found array<struct<vec_id:bigint,score:bigint>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        q, ids, scores = (np.frombuffer(row[c], t) for c, t in (("q", np.int32), ("ids", np.int64), ("scores", np.int64)))
        queries, offsets = np.frombuffer(row["queries"], np.int64), np.searchsorted(q, np.arange(row["n"] + 1))
        entries = pa.StructArray.from_arrays([pa.array(ids), pa.array(scores)], ["vec_id", "score"])
        yield pa.RecordBatch.from_arrays([pa.array(queries), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)], ["query", "found"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, parties: int = PARTIES, depth: int = DEPTH, tile_bytes: int = TILE_BYTES, block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best other rows of each row whose vec_id `every` divides.

    vectors: vec_id, embedding; a score is the inner product of floor(256 x) of all components, exact; ties go to the
    smaller vec_id. Vectors without id, null ones and those with a null or non-finite component take no part.
    An id of several rows counts once, with the smallest of its vectors. Vectors of different lengths are not
    compared; empty ones score 0 among themselves. Equal vectors are scored once and stand by their smallest ids, so a
    hot one costs no more than another. Shares of a product beyond 2^61 stay there. No vectors give no rows.
    Other columns are ignored.

    The queries' products with all vectors are computed in blocks, twice. A task holds the tiles of a chunk, about
    parties x tile_bytes, and a query block's scores in a tile. The tables of tiles and cutoffs stay in the shared
    folder for the result to be read from.
    """
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null").where(valid)
    own = own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    dim, is_query = F.size("embedding").alias("dim"), F.col("vec_id") % every == 0
    # A row for each length of vectors: n different lengths take n^2 / 2 components, so these are few.
    sizes = vectors.where("embedding is not null").select(dim, is_query.alias("_q")).groupBy("dim").agg(F.count("*").alias("n"), F.count_if("_q").alias("n_q"))
    most = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    sizes = F.broadcast(sizes.select("dim", most(F.col("n") * F.greatest("dim", F.lit(1)) * 4 / parties, tile_bytes).alias("chunks"), most(F.col("n_q"), block).alias("blocks")))
    # A vector's k + 1 smallest ids are all that can be among a query's k best, which leave out its own.
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = own.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    distinct = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def parts(rows: DataFrame, count: str, queries: bool) -> DataFrame:
        rows = rows.select(dim, "embedding", "ids").join(sizes, "dim")
        rows = rows.select("dim", F.pmod(F.xxhash64(F.col("ids")[0]), F.col(count)).cast("int").alias("place"), "ids", "embedding")
        rows = rows.withColumn("key", F.concat_ws(" ", "dim", "place")).repartition("key").sortWithinPartitions("key")
        return stored(run_arrow(rows, _parts, PART, parties=parties, queries=queries), "parts")[0]

    asked_ids = own.where(is_query)
    one = asked_ids.groupBy("embedding").agg(F.min("vec_id").alias("query"))
    tiles = parts(distinct, "chunks", False)
    asked = parts(one.select("embedding", F.array("query").alias("ids")), "blocks", True)

    def phase(cuts: DataFrame | None) -> DataFrame:
        """The k + 1 best rows of each query, of what tiles tell under the cutoffs or in their first lists."""
        none = F.lit(None).cast("binary").alias("cut")
        to_all = asked.select(*PART_NAMES, none) if cuts is None else asked.join(cuts, ["dim", "block"]).select(*PART_NAMES, "cut")
        to_all = to_all.join(sizes, "dim").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*PART_NAMES, "cut")
        both = tiles.select(*PART_NAMES, none).union(to_all).withColumn("key", F.concat_ws(" ", "dim", "chunk", "party"))
        told = run_arrow(both.repartition("key").sortWithinPartitions("key", "block"), _told, ENTRIES, parties=parties, depth=depth)
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("q", "binary"), ("x", "binary"), ("share", "binary"))]
        kind = F.when(F.col("block") < 0, 0).otherwise(1).alias("kind")
        empty = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PART.split(", ")[4:]]
        whole = both.select(*PART_NAMES, *nothing, kind).union(told.select(*PART_NAMES[:4], *empty, "q", "x", "share", F.lit(2).alias("kind")))
        whole = whole.withColumn("key", F.concat_ws(" ", "dim", "chunk")).repartition("key").sortWithinPartitions("key", "block", "kind", "party")
        best = run_arrow(whole, _resolved, BEST, k=k + 1)
        return run_arrow(best.repartition("dim", "block").sortWithinPartitions("dim", "block"), _merged, BEST, k=k + 1)

    cuts, _ = stored(run_arrow(phase(None), _cut, "dim int, block int, cut binary", k=k + 1), "cutoffs")
    found = run_arrow(phase(cuts), _found, FOUND)
    names = asked_ids.join(one, "embedding").select(F.col("vec_id").alias("query_id"), "query")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = names.join(found, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
