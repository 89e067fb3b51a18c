"""A training corpus from documents: language, near-duplicates, benchmark copies, personal data, packing.

Every stage takes any rows with the columns of documents and ignores others, so a clash of names does no
harm; each states below what it does with nulls, empty and very long texts, ties and repeated rows. No
documents give no rows in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracery.llm import decontaminate, langid, packing, simhash, surrogates
from tracery.llm.common import drop_path, kept_table, stored, table
from tracery.llm.queries import word_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, so no other column's name can clash with what a stage adds."""
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from docs; only those without a letter go.

    A null or empty text has no letter and goes; a null id, and a null lang, does not matter; a very long text
    is read whole; repeated rows stay as often as they are; languages that tie keep the document. Where no
    row has a lang nothing can be learned, and all documents go.
    """
    docs = _documents(docs)
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = langid.learn(known.select(F.col("doc_id").alias("key"), "lang", "text"))
    scored = langid.predict(docs, model)
    return scored.where(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id, and of ids that tie that of the smallest hash of its text.

    A null id comes after all others, so its document stays only where no other is in the group. Texts that
    share an id are documents of their own: none goes that has no near copy. Repeated rows are copies. Null
    and empty texts are one group; a very long text is read whole.
    """
    return simhash.without_copies(_documents(docs)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of an item of the benchmark.

    A document is known by a hash of its text, so ids, null or repeated, do not matter, and repeated rows stay or
    go together. Null and empty texts hold nothing and stay; a very long text is searched whole; a score that
    ties with the threshold is a copy.
    """
    keyed = _documents(docs).withColumn("_key", F.xxhash64("text"))
    found = decontaminate.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad, _ = stored(found.select(F.col("doc_id").alias("_key")).distinct(), "contaminated")
    return keyed.join(bad, "_key", "left_anti").select(*COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced and their characters counted anew.

    The secret is the session's spark.tracery.surrogates.key, or one of this call's own. A null text stays null,
    and so does its count; an empty one has 0 characters; a very long one is searched whole; null ids do not
    matter; repeated rows get the same text. Of kinds that tie for a place the surest one takes it.
    """
    new = surrogates.surrogates(_documents(docs), surrogates.session_key(spark))
    return new.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null or empty text is the end id alone; a very long one is cut into pieces; a null id stays null; repeated
    rows are packed as often as they are; pieces that tie in length are placed by id, piece and checksum.
    """
    return packing.pack(_documents(docs), word_tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Tokens, fingerprints and alignments have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result a table in the shared folder that goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = kept_table(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
