"""Language identification and the quality classifier: held-out figures, what is learned from, and odd rows."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracery.llm import langid, nbsvm


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_held_out_labels_change_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    spoilt = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(spoilt).collect()))


def test_unseen_words_back_off(spark):
    rows = [(k, "de", "schlüsselbund handschuhe straßenbahn") for k in range(30)] + [(100 + k, "en", "keychain gloves the tramway with") for k in range(30)]
    model = langid.learn(spark.createDataFrame(rows, "key long, lang string, text string"))
    assert model.word("straßenbahnen") == model.word("straßenbahnen") and "straßenbahnen" not in model.words
    assert model.predict("straßenbahnhandschuh")[0] == "de" and model.predict("gloveswith")[0] == "en"
    assert model.predict("12 ?")[0] == "und" and 0 <= model.predict("zzz")[1] <= 1
    assert model.predict("\u00b2 \u2167 \u00bd 7\u00b2") == ("und", 0.0)  # numerals, no letter
    assert model.predict("\u00b2 schlüsselbund")[0] == "de"


def test_counts_are_plain_counts(spark, sf):
    """The model against plain counting of words and n-grams on the driver."""
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.lang is not None]
    model = langid.learn(spark.createDataFrame([(r.doc_id, r.lang, r.text) for r in docs], "key long, lang string, text string"), max_docs=1 << 20)
    for size in range(langid.LONGEST + 1):
        count = {lang: Counter() for lang in model.langs}
        for r in docs:
            for w in langid.WORD.findall((r.text or "").lower()):
                count[r.lang].update([w] if size == 0 else langid.grams(w, size))
        kept = sorted(x for x in set().union(*count.values()) if sum(c[x] for c in count.values()) >= 2)
        assert sorted(model.grams[size].at) == kept
        for j, lang in enumerate(model.langs):
            want = np.log((np.array([count[lang][x] for x in kept]) + 0.5) / (sum(count[lang].values()) + 0.5 * len(kept) + 1))
            assert np.allclose(model.grams[size].rows[[model.grams[size].at[x] for x in kept], j], want)
    text = max((r.text or "" for r in docs), key=len)
    rows = np.array([model.word(w) for w in langid.WORD.findall(text.lower())])
    assert model.predict(text)[0] == model.langs[int(rows.mean(0).argmax())]


def test_language_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !", None), (None, "the house", "en"), (5, "the house", "en"), (5, "the house", "en"), (7, "das haus " * 40_000, "de"), (9, "das haus", "de"), (12, "the house", "en")]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}


def auc(score, label):
    score, label = np.array(score), np.array(label)
    good, bad = score[label == 1], score[label == 0]
    return float(np.mean((good[:, None] > bad[None]) + 0.5 * (good[:, None] == bad[None])))


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = nbsvm.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.85
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_learns_from_its_fold_alone(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    spoilt = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, nbsvm.quality(d, x).collect())) for d, x in ((docs, labels), (docs.withColumn("source", F.lit("?")), spoilt)))
    assert a == b


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    y = (np.arange(200) % 2).astype(float)
    texts = [np.unique(np.concatenate([rng.integers(0, 5000, 40), 10_000 + rng.integers(0, 30, 3) + 100 * int(c)])) for c in y]
    weight, square, bias, a, b = nbsvm.fit(texts, y)
    margin = np.array([bias + weight[t].sum() / np.sqrt(square[t].sum()) for t in texts])
    assert auc(margin, y) > 0.97 and a > 0


def test_features_are_the_same_in_chunks():
    f = nbsvm.Features()
    long = "ab cd " * 400_000
    assert set(f("ab cd ab cd ab cd").tolist()) <= set(f(long).tolist()) and len(f("")) == len(f(None)) == 0


def test_words_are_whole_whatever_the_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(30):
        words = ["".join(rng.choice(list("abé"), rng.integers(1, 40 if rng.random() < 0.9 else 900))) for _ in range(rng.integers(1, 200))]
        text = "".join(w + ("" if rng.random() < 0.02 else " " * int(rng.integers(1, 90))) + (w + " ") * int(rng.random() < 0.2) for w in words)
        whole = nbsvm.Features()(text)
        monkeypatch.setattr(nbsvm, "CHUNK", 64)
        assert (nbsvm.Features()(text) == whole).all()
        monkeypatch.undo()
    assert len(nbsvm.Features()("word " * 700_000)) and len(nbsvm.Features()("y" * 3_000_000))


def test_quality_cases(spark):
    rows = [(k, "clean words of a text" if k % 2 else "buy buy buy now") for k in range(60)] + [(60, None), (61, ""), (None, "x"), (3, "again"), (62, "y" * 300_000)]
    docs = spark.createDataFrame([(*r, 1.0, 0) for r in rows], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (5, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = nbsvm.quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert nbsvm.quality(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in nbsvm.quality(docs, labels.limit(0)).collect()} == {1}  # an even share
