"""Repeats of at least so many bytes across documents, by the common-prefix intervals of enhanced suffix arrays.

Every string of `length` bytes belongs to the anchor that its content picks: the smallest hash of the short
byte strings in it. So equal strings meet under one anchor wherever they are, and only anchors of several
documents need a look. Neighbouring strings of one anchor travel together as one stretch of text.

1. Each task cuts its documents into stretches. Of equal stretches in a slice only those of the smallest
   document travel on; the others are already known to be repeats.
2. Stretches meet by anchor. Anchors of one document are dropped. Equal stretches again leave only those of
   the smallest document; where an anchor has different stretches, their text is fetched. Where it has very many
   (a common line in different surroundings), each of their strings is fetched by itself, and of equal
   strings in a batch only those of the smallest document travel on: the key is the whole string then.
3. For that text a suffix array with common prefixes is built, and a stack scan over it gives the maximal
   repeats: intervals whose left neighbours differ. All their occurrences but those of the smallest document
   are repeats.
4. Repeats meet their documents, which are cut.

Documents meet their stretches in as many parts as their bytes need; no step holds more than one part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, release, run_arrow, stored, text_buffer

SHORT = 20
CHUNK = 1 << 18
#: Bytes of texts among which a task looks for equal stretches before any travels.
SLICE = 12 << 20
#: Bytes of fetched stretches in one suffix array; those of one anchor stay together.
BUNDLE = 1 << 18
#: Repeats that a task gathers before it deals them to the parts of their documents.
FOUND = 1 << 20
#: Different stretches of one anchor that meet in one task; those of a more frequent anchor meet string by string, as many rows as it has strings.
#: At least HOT, and HOT_SHARE for each part, so that no larger share of a larger table is dealt so; at most HOT_MOST, which a task can hold.
HOT, HOT_SHARE, HOT_MOST = 2048, 40, 16384
IS_HOT = 128
DOC = np.dtype([("doc", "<i8"), ("row", "<u8"), ("n", "<u4")])


def short_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the SHORT bytes from each place on."""
    b = raw.astype(np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    eight = four[:-4] | four[4:] << np.uint64(32)
    n = len(raw) - SHORT + 1
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h += eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += four[16 : 16 + n] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def stretches(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, strings, anchor, content hash) of the stretches of texts that begin at starts in raw.

    A stretch holds the strings of `length` bytes from place to place + strings - 1, all of one anchor.
    """
    empty = np.zeros(0, np.int64)
    if len(raw) < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = short_hashes(raw)
    best = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, have = length - SHORT + 1, 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    ok = np.ones(len(best), bool)
    for k in range(1, len(starts)):  # no string crosses a text's end
        ok[max(0, starts[k] - length + 1) : starts[k]] = False
    anchor = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1])])
    first = np.flatnonzero(new)
    many = np.diff(np.concatenate([first, [len(best)]]))
    first, many = first[ok[first]], many[ok[first]]
    end = first + many + length - 1
    content = mixed(h[first] ^ mixed(h[np.minimum(first + SHORT, end - SHORT)] ^ mixed(h[np.maximum(first, end - 2 * SHORT)] ^ mixed(h[end - SHORT] ^ many.astype(np.uint64)))))
    return first, many, h[anchor[first]], content


def _pack(doc: np.ndarray, row: np.ndarray, order: np.ndarray, **columns: np.ndarray) -> bytes:
    """Rows of documents as bytes: a table of documents with counts, then each column; order sorts rows by document."""
    doc, row = doc[order], row[order]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])]))
    table = np.empty(len(cut), DOC)
    table["doc"], table["row"], table["n"] = doc[cut], row[cut], np.diff(np.concatenate([cut, [len(doc)]]))
    return b"".join([len(cut).to_bytes(4, "little"), table.tobytes(), *(c[order].tobytes() for c in columns.values())])


def _unpack(blob: bytes, **kinds: str) -> dict[str, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    table = np.frombuffer(blob, DOC, n, 4)
    total, at = int(table["n"].sum()), 4 + n * DOC.itemsize
    out = {"doc": np.repeat(table["doc"], table["n"]), "row": np.repeat(table["row"], table["n"])}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(blob, kind, total, at)
        at += total * np.dtype(kind).itemsize
    return out


def _joined(blobs: list[bytes], **kinds: str) -> dict[str, np.ndarray]:
    parts = [_unpack(b, **kinds) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {k: np.zeros(0, v) for k, v in {"doc": "<i8", "row": "<u8", **kinds}.items()}


WIDE = {"anchor": "<u8", "content": "<u8", "place": "<u4", "many": "u1"}
SPAN = {"place": "<u4", "many": "<u4"}


def _rows(kind: int, key: np.ndarray, parts: int, doc, row, **columns) -> list[tuple[int, int, bytes]]:
    """(kind, part, blob) rows, dealt by key."""
    if not len(doc):
        return []
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((columns["place"], row, doc, part))
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(kind, p, _pack(doc, row, order[a:b], **columns)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _row_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, part, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["kind", "part", "blob"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches by their anchor's part (kind 0), and those that a smaller document of the slice has too (kind 1)."""
    for batch in batches:
        docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        raw, at = text_buffer(batch.column(2))
        k = 0
        while k < len(docs):
            end = max(k + 1, int(np.searchsorted(at, at[k] + SLICE, side="right")) - 1)
            yield _row_batch(_cut_slice(docs, rows, raw, at, k, end, length, parts))
            k = end


def _cut_slice(docs: np.ndarray, rows: np.ndarray, raw: np.ndarray, at: np.ndarray, k: int, stop: int, length: int, parts: int) -> list[tuple[int, int, bytes]]:
    found: list[tuple] = []
    while k < stop:
        end = k + 1
        while end < stop and at[end + 1] - at[k] <= CHUNK:
            end += 1
        for lo in range(int(at[k]), max(int(at[k]) + 1, int(at[end]) - length + 1), CHUNK):  # a very long text in overlapping pieces
            hi = min(int(at[end]), lo + CHUNK + length - 1)
            first, many, anchor, content = stretches(raw[lo:hi], at[k:end] - lo, length)
            owner = k + np.searchsorted(at[k:end], first + lo, side="right") - 1
            found.append((owner.astype(np.int32), (first + lo - at[owner]).astype("<u4"), many.astype("u1"), anchor, content))
        k = end
    owner, place, many, anchor, content = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    order = np.lexsort((docs[owner], content))
    least = docs[owner[order]]
    same = np.flatnonzero(np.concatenate([[True], content[order][1:] != content[order][:-1]])) if len(order) else order
    least = np.repeat(least[same], np.diff(np.concatenate([same, [len(order)]])))
    later = np.empty(len(order), bool)
    later[order] = docs[owner[order]] > least
    del order, least, same
    go = ~later
    out = _rows(1, rows[owner[later]] >> np.uint64(1), parts, docs[owner[later]], rows[owner[later]], place=place[later], many=many[later].astype("<u4"))
    owner, place, many, anchor, content = owner[go], place[go], many[go], anchor[go], content[go]
    return out + _rows(0, mixed(anchor), parts, docs[owner], rows[owner], anchor=anchor, content=content, place=place, many=many)


def _meet(batches: Iterator[pa.RecordBatch], parts: int, hot: int) -> Iterator[pa.RecordBatch]:
    """By part of anchors: repeats (kind 1), those known before too, and stretches whose anchor has others (kind 2)."""
    held: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        known = []
        for kind, part, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind:
                known.append((kind, part, blob))
            else:
                held[part].append(blob)
        yield _row_batch(known)
    for part in sorted(held):
        x = _joined(held.pop(part), **WIDE)
        order = np.lexsort((x["doc"], x["content"], x["anchor"]))
        x = {k: v[order] for k, v in x.items()}
        new_anchor = np.concatenate([[True], x["anchor"][1:] != x["anchor"][:-1]])
        new = new_anchor | np.concatenate([[True], x["content"][1:] != x["content"][:-1]])
        by_anchor, by_content = np.cumsum(new_anchor) - 1, np.cumsum(new) - 1
        at = np.flatnonzero(new_anchor)
        shared = (np.minimum.reduceat(x["doc"], at) != np.maximum.reduceat(x["doc"], at))[by_anchor]
        different = np.bincount(by_anchor[new])[by_anchor]
        later = x["doc"] > x["doc"][new][by_content]
        fetch = shared & (different > 1) & ~later
        x["many"] = x["many"] | np.where(different > hot, IS_HOT, 0).astype("u1")
        many = (x["many"][later] & (IS_HOT - 1)).astype("<u4")
        out = _rows(1, x["row"][later] >> np.uint64(1), parts, x["doc"][later], x["row"][later], place=x["place"][later], many=many)
        out += _rows(2, x["row"][fetch] >> np.uint64(1), parts, x["doc"][fetch], x["row"][fetch], anchor=x["anchor"][fetch], content=x["content"][fetch], place=x["place"][fetch], many=x["many"][fetch])
        yield _row_batch(out)


def _by_row(x: dict[str, np.ndarray]) -> dict[tuple[int, int], slice]:
    """Rows of each document, after sorting x in place by document and place."""
    order = np.lexsort((x["place"], x["row"], x["doc"]))
    for k in x:
        x[k] = x[k][order]
    n = len(x["doc"])
    cut = np.flatnonzero(np.concatenate([[True], (x["row"][1:] != x["row"][:-1]) | (x["doc"][1:] != x["doc"][:-1])])) if n else np.zeros(0, np.int64)
    end = np.concatenate([cut[1:], [n]]) if n else cut
    return {(d, r): slice(a, b) for d, r, a, b in zip(x["doc"][cut].tolist(), x["row"][cut].tolist(), cut.tolist(), end.tolist(), strict=True)}


def _fetch(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Text of wanted stretches by their anchor, or string by string; with a part, repeats that are known by now.

    Rows come by part, wanted stretches (kind 2) before texts (kind 3).
    """
    wanted, by_row, blobs = None, {}, []
    last = None
    for batch in batches:
        kinds, part, blob = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        doc, row, text = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
        got: list[tuple] = []
        least: dict[bytes, list[tuple[int, int, int]]] = {}  # where the smallest document of the batch has each string
        known: list[tuple[int, int, int]] = []
        for k in range(len(kinds)):
            if part[k] != last:
                wanted, by_row, blobs, last = None, {}, [], part[k]
            if kinds[k] == 2:
                blobs.append(blob[k].as_py())
                continue
            if wanted is None:
                wanted = _joined(blobs, **WIDE)
                by_row = _by_row(wanted)
            own = by_row.get((doc[k], row[k] & 0xFFFFFFFFFFFFFFFF))
            if own is None:
                continue
            raw = text[k].as_py().encode("utf-8", "surrogatepass")
            seen = set()
            for anchor, place, many in zip(wanted["anchor"][own].tolist(), wanted["place"][own].tolist(), wanted["many"][own].tolist(), strict=True):
                if (anchor, place) in seen:  # a repeated row asks once for each of its copies
                    continue
                seen.add((anchor, place))
                if not many & IS_HOT:
                    got.append((anchor - (anchor >> 63 << 64), doc[k], row[k], place, raw[place : place + many + length - 1], None))
                    continue
                for at in range(place, place + (many & (IS_HOT - 1))):
                    own, string = (doc[k], row[k], at), raw[at : at + length]
                    best = least.setdefault(string, [])
                    if best and best[0][0] < doc[k]:
                        known.append(own)
                    elif best and best[0][0] > doc[k]:
                        known += best
                        least[string] = [own]
                    else:
                        best.append(own)
        for string, places in least.items():
            key = int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)
            got += [(key, *own, string, None) for own in places]
        if known:
            d, r, at = (np.array(x, np.int64) for x in zip(*known, strict=True))
            spans = _rows(1, r.view(np.uint64) >> np.uint64(1), parts, d, r.view(np.uint64), place=at.astype("<u4"), many=np.ones(len(at), "<u4"))
            got += [(hash((to, len(b))), None, None, None, b, to) for _, to, b in spans]
        columns = list(zip(*got, strict=True)) if got else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary(), pa.int32()), strict=True)], ["anchor", "doc", "row", "place", "content", "part"])


def suffix_array(text: np.ndarray, top: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before, at most `top`) by prefix doubling; text holds values from 0 up.

    The first order is by as many symbols as one number holds. A suffix's rank is the place of the first one that shares its
    prefix so far, so each round sorts only those that others still share theirs with. Prefixes below `least` may be told as 0.
    """
    n = len(text)
    symbol = text.astype(np.int64) + 1
    bits = int(symbol.max(initial=1)).bit_length()
    ranks, have, key = [symbol], 1, symbol
    while 2 * have * bits <= 62 and have < top:
        key = key << (have * bits)
        key[: max(0, n - have)] |= ranks[-1][have:]
        ranks.append(key)
        have *= 2
    sa = np.argsort(key)
    place, new = np.arange(n), np.ones(n, bool)
    new[1:] = key[sa][1:] != key[sa][:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0)) if n else place
    ranks[-1] = rank
    while have < top:
        shared = ~(new & np.concatenate([new[1:], [True]])) if n else new
        at = np.flatnonzero(shared)
        if not len(at):
            break
        own = sa[at]
        next_ = np.zeros(len(at), np.int64)
        inside = own + have < n
        next_[inside] = rank[own[inside] + have] + 1
        key = rank[own] * (n + 1) + next_
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[at] = own
        first = np.concatenate([[True], key[1:] != key[:-1]])
        new[at] = first
        rank = rank.copy()
        rank[own] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        ranks.append(rank)
        have *= 2
    lcp = np.zeros(n, np.int64)
    low = min(max(least, 1).bit_length() - 1, len(ranks) - 1)
    pairs = np.flatnonzero(ranks[low][sa[1:]] == ranks[low][sa[:-1]]) if low and 1 << low <= least else np.arange(max(0, n - 1))
    a, b = sa[1:][pairs], sa[:-1][pairs]
    long = np.zeros(len(pairs), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        ok = (a + step <= n) & (b + step <= n)
        same = ok.copy()
        same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        long += step * same
        a, b = np.where(same, a + step, a), np.where(same, b + step, b)
    lcp[pairs + 1] = np.minimum(long, top)
    return sa, lcp


def repeat_groups(sa: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(prefix, from, to) of the common-prefix intervals of at least `least` that are maximal repeats, children before parents.

    left: what stands before each suffix, -1 if nothing is known. Where all of an interval's suffixes follow
    the same symbol it is left out: the repeat one symbol to the left holds all its occurrences.
    """
    varied = np.zeros(len(sa), np.int64)  # the last place up to here at which the left neighbour changes
    if len(sa):
        before = left[sa]
        change = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] < 0)])
        varied = np.maximum.accumulate(np.where(change, np.arange(len(sa)), 0))
    heights = lcp.tolist()
    stack: list[tuple[int, int]] = []
    last = -2

    def closed(h: int, lo: int, hi: int) -> list[tuple[int, int, int]]:
        return [(h, lo, hi)] if varied[hi - 1] > lo or left[sa[lo]] < 0 else []

    for i in [*np.flatnonzero(lcp >= least).tolist(), len(sa)]:
        if i != last + 1 or i == len(sa):  # no prefix joins what comes with what was before
            while stack:
                yield from closed(*stack.pop(), last + 1)
        if i == len(sa):
            break
        lo = i - 1
        while stack and stack[-1][0] > heights[i]:
            h, lo = stack.pop()
            yield from closed(h, lo, i)
        if not stack or stack[-1][0] < heights[i]:
            stack.append((heights[i], lo))
        last = i


def _repeats(batches: Iterator[pa.RecordBatch], length: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Repeats among fetched stretches (kind 1), and those that are known. Rows come by anchor, and whole anchors are taken together.

    Repeats are dealt to the parts of their documents once there are FOUND of them: a row for each bundle and part
    would be as many as both multiplied.
    """
    held: list[tuple] = []
    found: list[tuple] = []
    size, last = 0, None

    def dealt() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        found.clear()
        doc, row, place, many = columns or [np.zeros(0, np.uint64)] * 4
        return _row_batch(_rows(1, row >> np.uint64(1), parts, doc, row, place=place.astype("<u4"), many=many.astype("<u4")))

    for batch in batches:
        known = batch.filter(batch.column(5).is_valid())
        yield _row_batch([(1, to, b) for to, b in zip(known.column(5).to_pylist(), known.column(4).to_pylist(), strict=True)])
        batch = batch.filter(batch.column(5).is_null())
        for anchor, *r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if anchor != last and size >= BUNDLE:
                found += _bundle(held, length)
                held, size = [], 0
                if sum(len(f[0]) for f in found) >= FOUND:
                    yield dealt()
            held.append(r)
            size, last = size + len(r[3]), anchor
    if held:
        found += _bundle(held, length)
    yield dealt()


def _bundle(rows: list, length: int) -> list[tuple[np.ndarray, ...]]:
    """Repeats (document, row, place, strings) among rows (document, row, place, content), by one suffix array."""
    doc = np.array([r[0] for r in rows], np.int64)
    row = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    place = np.array([r[2] for r in rows], np.int64)
    size = np.array([len(r[3]) for r in rows], np.int64)
    # A symbol of its own after each stretch: no common prefix goes beyond it.
    start = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[start + size] = False
    text[inside] = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    text[~inside] = 256 + np.arange(len(rows))
    owner = np.repeat(np.arange(len(rows)), size + 1)
    sa, lcp = suffix_array(text, 2 * length, length)
    left = np.concatenate([[-1], np.where(inside[:-1], text[:-1], -1)])
    out: list[tuple[np.ndarray, np.ndarray, int]] = []
    for prefix, lo, hi in repeat_groups(sa, lcp, left, length):
        at = sa[lo:hi]
        later = doc[owner[at]] > doc[owner[at]].min()
        if later.any():
            out.append((owner[at[later]], at[later] - start[owner[at[later]]], prefix))
    if not out:
        return []
    who = np.concatenate([x[0] for x in out])
    begin = place[who] + np.concatenate([x[1] for x in out])
    many = np.repeat([x[2] - length + 1 for x in out], [len(x[0]) for x in out])
    return [(doc[who], row[who], begin, many)]


def _finish(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Documents without their repeats. Rows come by part, repeats (kind 1) before texts (kind 3)."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    spans, by_row, blobs = None, {}, []
    last = None
    for batch in batches:
        kinds, part, blob = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        doc, row, text = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
        out: list[tuple] = []
        for k in range(len(kinds)):
            if part[k] != last:
                spans, by_row, blobs, last = None, {}, [], part[k]
            if kinds[k] == 1:
                blobs.append(blob[k].as_py())
                continue
            if spans is None:
                spans = _joined(blobs, **SPAN)
                by_row = _by_row(spans)
            raw = (text[k].as_py() or "").encode("utf-8", "surrogatepass")
            own = by_row.get((doc[k], row[k] & 0xFFFFFFFFFFFFFFFF)) if doc[k] is not None else None
            if own is None:
                out.append((doc[k], len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            a = spans["place"][own].astype(np.int64)
            b = np.maximum.accumulate(a + spans["many"][own] + length - 1)
            new = np.concatenate([[True], a[1:] > b[:-1]])
            first, end = a[new], b[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(b) - 1]])]
            kept, at, h = 0, 0, hashlib.sha256()
            for x, y in zip(first.tolist(), end.tolist(), strict=True):
                h.update(raw[at:x])
                kept, at = kept + x - at, y
            h.update(raw[at:])
            kept += len(raw) - at
            out.append((doc[k], len(raw), len(raw) - kept, len(first), h.hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], names)


def hot_from(parts: int) -> int:
    """Different stretches above which an anchor's strings meet one by one, in a table of so many parts."""
    return min(HOT_MOST, max(HOT, HOT_SHARE * parts))


def cut_repeats(docs: DataFrame, length: int = 50, part_bytes: int = 16 << 20, hot: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    docs has doc_id and text; other columns are ignored. Each byte is removed that lies in a string of
    `length` bytes that also starts in a document with a smaller doc_id. Null and empty texts have no
    bytes; a very long text is taken in overlapping pieces. Documents of one id (repeated rows) take nothing from each other; one without an id takes
    nothing and loses nothing. No documents give no rows.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text, "doc_id").alias("row"), text.alias("text"))  # copies of a text have rows of their own
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, min(1 << 20, size // part_bytes)))
    hot = hot_from(parts) if hot is None else hot
    blobs = "kind int, part int, blob binary"
    cut = run_arrow(own.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length)), _cut, blobs, length=length, parts=parts)
    met, _ = stored(run_arrow(cut.repartition(parts, "part"), _meet, blobs, parts=parts, hot=hot), "met")
    release(spark)
    none = F.lit(None)
    texts = own.select(F.lit(3).alias("kind"), (F.shiftrightunsigned("row", 1) % parts).cast("int").alias("part"), none.cast("binary").alias("blob"), "doc", "row", "text")

    def beside(rows: DataFrame) -> DataFrame:
        rows = rows.select("kind", "part", "blob", none.cast("long").alias("doc"), none.cast("long").alias("row"), none.cast("string").alias("text"))
        return rows.union(texts).repartition(parts, "part").sortWithinPartitions("part", "kind")

    fetched = run_arrow(beside(met.where("kind = 2")), _fetch, "anchor long, doc long, row long, place long, content binary, part int", length=length, parts=parts)
    more, _ = stored(run_arrow(fetched.repartition(parts, "anchor").sortWithinPartitions("anchor"), _repeats, blobs, length=length, parts=parts), "repeats")
    release(spark)
    return run_arrow(beside(met.where("kind = 1").union(more)), _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length=length)
