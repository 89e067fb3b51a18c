"""Every stage of the pipeline on its own input, against plain Python."""

import re
from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_simhash import plain_groups
from tests.llm.test_tokens import check_pieces
from tracery.llm import surrogates
from tracery.llm.queries import QUERIES, word_tokenizer


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage kept, the documents first."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    assert all(f.columns == kept[0].columns and f.dtypes == kept[0].dtypes for f in kept)


def test_language(kept):
    before, after = rows(kept[0]), rows(kept[1])
    assert all(after[k] == before[k] for k in after)
    for k in before.keys() - after.keys():
        assert sum(c.isalpha() for c in before[k].text or "") < 0.5 * len(before[k].text or "x") or len((before[k].text or "").split()) < 20
    assert len(after) > 0.9 * len(before)


def test_short_documents_stay(spark, sf):
    """Words that several languages share, alone in a document: no language is likely, but none of them is junk."""
    shared = ["in", "la", "de", "so", "an", "es", "der", "me", "Andththwhes.", "Aononeaat. Tioningen.", "xq"]
    docs = [(k, w, None, "a", len(w)) for k, w in enumerate(shared)] + [(98, "12 ² 7", None, "a", 6)]
    frame = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    frame = frame.withColumn("doc_id", frame.doc_id + 1000).union(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, frame, sf).where("doc_id < 1000").collect()}
    assert got == set(range(len(shared)))


def test_near_duplicates(kept):
    before, after = rows(kept[1]), rows(kept[2])
    firsts = {c for _, _, c in plain_groups({k: r.text for k, r in before.items()})}
    assert after == {k: before[k] for k in firsts}


def test_benchmark(kept, spark, sf):
    before, after = rows(kept[2]), rows(kept[3])
    split = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(after[k] == before[k] for k in after) and len(after) < len(before)
    assert not any(i in split(r.text) for r in after.values() for i in items if i)
    for k in before.keys() - after.keys():  # whatever went shares a run of words with an item
        words = split(before[k].text).split()
        runs = {" ".join(words[i : i + 4]) for i in range(len(words))}
        assert any(" ".join(i.split()[j : j + 4]) in runs for i in items for j in range(len(i.split())))


def test_personal_data(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert before.keys() == after.keys()
    for k, r in before.items():
        if surrogates.find(r.text):
            assert after[k].text != r.text and after[k].n_chars == len(after[k].text)
        else:
            assert after[k].text == r.text


def test_packing(kept, spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in kept[4].collect()], lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1], 4096)


def test_run(kept, spark, sf):
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == rows(kept[4]).keys()


def test_odd_documents(spark, sf):
    schema = kept_schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "the house of the man", "en", "a", 1), (3, "the house of the man", "en", "a", 1), (4, "das haus " * 20_000, "de", "b", 2)], schema)
    for frame in (odd, odd.limit(0), odd.withColumn("fp", odd.n_chars).withColumn("component", odd.text)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, frame, sf)
            assert got.columns == [c.split()[0] for c in kept_schema.split(", ")]
            got.collect()
        corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()


def test_no_text_without_a_near_copy_is_lost(spark, sf):
    """One id with several texts, and null ids: only near copies go."""
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(5)]
    rows = [(1, texts[0]), (3, texts[0]), (3, texts[1]), (3, texts[2]), (3, texts[2]), (None, texts[0]), (None, texts[3]), (None, texts[3]), (4, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[3]), (4, texts[4])], key=str)


def test_contaminated_documents_go_whatever_their_ids(spark, sf):
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()), key=len)
    rows = [(1, "clean words only"), (1, f"before {item} after"), (None, item), (None, "more clean words"), (2, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()), key=str)
    assert got == sorted([(1, "clean words only"), (None, "more clean words"), (2, None), (3, "")], key=str)


def test_scratch_tables_go(spark, sf):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    assert corpus_pipeline.run(spark, sf).count() > 100
    left = {p.name.split("-")[1] for p in shared.iterdir() if p.name not in before}
    assert left == {"pii_surrogates", "pieces"}  # what the result reads


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from tracery.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert common.shared_dir(session) == common.shared_dir(session)


def test_thirteen_queries():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
