"""Source divergence audit: how far the term shares of a language's sources lie apart, and which terms set a source apart.

Terms are counted in tasks, then dealt into blocks. A block of a language is a dense matrix of groups by terms; all
pairs of its groups are compared by broadcasting, and the pair matrices and heaps of the blocks are merged. All
arithmetic is on integers.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, run_arrow, stored

#: Documents of a language that hold a term which is kept, and shares of a whole.
LEAST, SHARES = 10, 1_000_000_000
#: Ranks of terms that are told for a group.
TOP = 10
#: Cells (groups by terms) of a dense block, and groups of a block; more groups are compared in pairs of blocks of groups.
CELLS, GROUPS = 1 << 18, 1 << 10
#: Parts over which a language's terms are dealt to meet what is known of the language.
PARTS = 256
#: Counts that a task holds before it hands them on.
HELD = 1 << 19

#: Letters, A-Z as a-z, and all that is not ASCII; everything else parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time: no term is cut."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and TERM_BYTES[text[end]] != 32:
            end += 1
        yield text[at:end].translate(TERM_BYTES).split()
        at = end


COUNTS = ["lang", "source", "term", "n", "docs"]


def _counted(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of the batches, combined as far as they are held; a group's own row has no term."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        nonlocal size
        for group, found in counts.items():
            own, n = docs[group], len(found)
            columns = [pa.array([group[0]] * n, pa.string()), pa.array([group[1]] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64()), pa.array([own[t] for t in found], pa.int64())], COUNTS)
        counts.clear()
        docs.clear()
        size = 0

    groups = set()
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            group = (lang, source)
            groups.add(group)
            found, before = counts[group], len(counts[group])
            distinct: set[bytes] = set()
            for piece in terms(text or b""):
                found.update(piece)
                distinct.update(piece)
            docs[group].update(distinct)
            size += len(found) - before
            if size >= held:
                yield from handed()
    yield from handed()
    if groups:
        a, b = zip(*sorted(groups), strict=True)
        none = [None] * len(a)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(none, pa.string()), pa.array(none, pa.int64()), pa.array(none, pa.int64())], COUNTS)


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SHARES * count / whole), three digits at a time so that no product leaves 64 bits (wholes below 9e15)."""
    out, rest = np.divmod(count, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    d = p - q
    return d * d // (p + q)


PARTIAL = "lang string, source string, part string, item string, value long"


class _Best:
    """The TOP greatest values of a group, of terms that tie the smallest."""

    def __init__(self) -> None:
        self.heap: list[tuple] = []

    class _Last(str):
        """A term that is less where it comes later, so the heap's least is the one to leave."""

        def __lt__(self, other: str) -> bool:
            return str.__gt__(self, other)

    def add(self, value: int, term: str) -> None:
        entry = (value, self._Last(term))
        if len(self.heap) < TOP:
            heapq.heappush(self.heap, entry)
        elif self.heap[0] < entry:
            heapq.heapreplace(self.heap, entry)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair sums and best terms of each block: rows of one tile are its groups (without term) and its counts.

    Tiles of a language that follow each other in a task are summed before they are handed on.
    """
    sums: dict[tuple[str, str, str], int] = defaultdict(int)
    best: dict[tuple[str, str], _Best] = defaultdict(_Best)

    def handed() -> Iterator[pa.RecordBatch]:
        rows = [(lang, a, "pair", b, v) for (lang, a, b), v in sums.items()]
        rows += [(lang, a, "term", str(t), v) for (lang, a), found in best.items() for v, t in found.heap]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        sums.clear()
        best.clear()
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])

    for tile in by_key(batches, "tile"):
        lang, side, other = (tile[c][0].as_py() for c in ("lang", "side", "other"))
        term = tile["term"].combine_chunks().dictionary_encode()
        names, place = term.dictionary.to_pylist(), term.indices.fill_null(-1).to_numpy().astype(np.int64)
        source, own = tile["source"].to_pylist(), tile["own"].to_numpy()
        n, whole = tile["n"].to_numpy(), tile["whole"].to_numpy()
        total, lang_whole = tile["total"].to_numpy(), tile["lang_whole"].to_numpy()
        heads = np.flatnonzero(place < 0)
        index = {source[i]: k for k, i in enumerate(heads)}
        group = np.array([index[x] for x in source], np.int64)
        dense = np.full((len(heads), len(names)), 2, np.int64)
        body = np.flatnonzero(place >= 0)
        dense[group[body], place[body]] = n[body] + 2
        p = shares(dense, whole[heads][:, None])
        label, block = [source[i] for i in heads], own[heads]
        if side == other:
            pairs = [(i, slice(i + 1, None)) for i in range(len(heads))]
            at = np.arange(len(heads))
        else:  # sources of one block of groups against those of the other
            at = np.argsort(block != side, kind="stable")
            first = int((block == side).sum())
            pairs = [(i, slice(first, None)) for i in range(first)]
            p = p[at]
        if names:
            for i, rest in pairs:
                values = apart(p[i], p[rest]).sum(1)
                for j, v in zip(at[rest].tolist(), values.tolist(), strict=True):
                    sums[lang, *sorted((label[at[i]], label[j]))] += v
        else:
            for i, rest in pairs:
                for j in at[rest].tolist():
                    sums[lang, *sorted((label[at[i]], label[j]))] += 0
        if side == other and len(body):
            q = shares(total[body] + 2, lang_whole[body])
            mine = p[group[body], place[body]]
            value = apart(mine, q)
            for k in np.flatnonzero(mine > q):
                best[lang, label[group[body[k]]]].add(int(value[k]), names[place[body[k]]])
        if len(sums) + TOP * len(best) >= HELD:
            yield from handed()
    yield from handed()


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs, total): occurrences and documents of each term, and a row without term for each group.

    total and docs count the term in all of its language. Tasks have combined what they read, so one shuffle by
    language and term serves the counts of sources and of the language.
    """
    empty = F.lit("")
    data = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), F.col("text").cast("binary").alias("text"))
    part = run_arrow(data, _counted, "lang string, source string, term string, n long, docs long", held=held)
    own = part.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources
    return own.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("docs"), F.sum("n").over(by_term).alias("total"))


def divergence(docs: DataFrame, held: int = HELD, cells: int = CELLS, groups: int = GROUPS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of all pairs of sources of a language, and of the terms that set each apart.

    docs: lang, source, text. Null text, lang and source are ''. A group without terms, or a language without kept
    terms, has pairs all the same, of the language's other sources. Repeated rows are documents of their own; a very
    long text is read whole, in pieces; values that tie are ranked by item. No documents give no rows. Other columns are
    ignored. A task holds `held` counts, and a dense block `cells` shares of at most about `groups` groups a side;
    memory does not grow with terms or sources. All ordered pairs are the result, so rows grow with the square of a
    language's sources, not of its documents.
    """
    counted, _ = stored(term_counts(docs, held), "terms")
    kept = counted.where(F.col("term").isNotNull() & (F.col("docs") >= LEAST)).select("lang", "term", "source", "n", "total")
    wholes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("all_n"))
    known = counted.where("term is null").select("lang", "source")
    sizes = known.groupBy("lang").agg(F.count("*").alias("g"))
    zero = F.lit(0).cast("long")
    langs = sizes.join(vocabulary, "lang", "left").select("lang", "g", F.coalesce("v", zero).alias("v"), F.coalesce("all_n", zero).alias("all_n"))
    # With half as many groups a block as may be, few blocks that a hash fills unevenly have more.
    langs = langs.select(
        "lang", "v", "all_n", F.ceil(F.col("g") / groups).alias("sides"),
        F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") * F.least("g", F.lit(2 * groups)) / cells)).alias("blocks"),
    )
    side = lambda: F.pmod(F.xxhash64("source"), F.col("sides")).alias("own")
    dealt = F.explode(F.transform(F.sequence(zero, F.col("sides") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("side"), F.greatest(x, F.col("own")).alias("other"))))
    head = known.join(wholes, ["lang", "source"], "left").join(langs, "lang")
    # Without kept terms all shares are 1, whatever the whole is.
    head = head.select("lang", "source", F.greatest(F.coalesce("n", zero) + 2 * F.col("v"), F.lit(2).cast("long")).alias("whole"), "sides", "blocks", side())
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")
    head = head.select("*", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    head = head.select("lang", "source", "own", dealt.alias("d"), "block", none.alias("term"), nothing.alias("n"), "whole", nothing.alias("total"), nothing.alias("lang_whole"))
    # A language has very many terms: they are dealt over parts to meet its sizes.
    many = langs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    body = kept.withColumn("part", F.pmod(F.xxhash64("term", "source"), F.lit(PARTS)).cast("int")).join(many, ["lang", "part"]).select("lang", "source", side(), F.col("sides"), F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "n", "total", (F.col("all_n") + 2 * F.col("v")).alias("lang_whole"))
    body = body.select("lang", "source", "own", dealt.alias("d"), "block", "term", "n", nothing.alias("whole"), "total", "lang_whole")
    rows = head.union(body)
    tile = F.concat_ws(" ", F.col("block").cast("string"), F.col("d.side").cast("string"), F.col("d.other").cast("string"), F.col("lang"))
    rows = rows.select(tile.alias("tile"), "lang", "source", "own", F.col("d.side").alias("side"), F.col("d.other").alias("other"), "term", "n", "whole", "total", "lang_whole")
    partial, _ = stored(run_arrow(rows.repartition("tile").sortWithinPartitions("tile", "source", "term"), _tiles, PARTIAL), "partial")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
    best = ranked(partial.where("part = 'term'")).where(F.col("rank") <= TOP)
    return ranked(pairs).union(best.select(*pairs.columns, "rank")).select("lang", "source", "part", "item", "value", "rank")
