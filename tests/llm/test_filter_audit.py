"""The filter audit against each order applied document by document."""

import itertools
import re

from tracery.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """{(part, order, step): counts} by applying each order to each document."""
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, t in labels if d is not None and t == 1}
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs)
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if x[0][f]]
                again = sum(x[0][f] for x in own) - len(gone)
                left = [x for x in left if not x[0][f]]
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                out[part, "".join(order), step + 1] = [len(left), len(gone), again, alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
                shapley[f] += len(gone)
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def got(spark, docs, labels, schema=DOCS, more=()):
    frame = spark.createDataFrame([(*d, *more) for d in docs], schema)
    rows = filter_audit.audit(frame, spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_odd_rows(spark):
    many, shout = " ".join(f"w{i}" for i in range(200)), " ".join(["WORD"] * 250)
    docs = [
        (1, None, "a"), (2, "", "a"), (3, "", None), (None, "", "a"), (None, None, ""), (5, many, "b"), (5, many, "b"), (6, many, "a"), (5, shout, "b"),
        (7, shout + " #", "b"), (8, many.replace(" ", " "), "b"), (9, many + "\x0b\x1fÉ", "c"), (10, "é" * 40 + "A", "c"), (-4, shout, "c"), (11, many, "b"), (11, many, "c"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 1), (5, 1, 1), (7, 0, 1), (99, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)
    assert got(spark, docs, labels, DOCS + ", part int, mask string, good int, n int", (1, "x", 0, 3)) == plain(docs, labels)
    assert got(spark, [], labels) == {}
    assert got(spark, docs, []) == plain(docs, [])


def test_pieces_cut_no_word(monkeypatch):
    text = " ".join(f"word{i}" for i in range(500)).encode()
    for n in (1, 7, 100):
        monkeypatch.setattr(filter_audit, "PIECE", n)
        assert [w for piece in filter_audit.words(text) for w in piece] == text.split()


def test_the_walk_visits_all_orders_by_single_swaps():
    import numpy as np

    orders = [o for o, _ in filter_audit.walk(np.zeros((1, 32, 2, 2), np.int64))]
    assert len(set(orders)) == 120
    for a, b in itertools.pairwise(orders):
        at = [i for i in range(5) if a[i] != b[i]]
        assert len(at) == 2 and at[1] == at[0] + 1
