"""Queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def word_tokenizer() -> str:
    """The public vocabulary that the token queries use; its file stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flat_graph import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).drop("audited_recall")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import session_key, surrogates

    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import token_files

    return token_files(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_main_text, op2_flat_graph, op3_language_id, op4_surrogates, op5_suffix_dedup, op6_simhash, op7_decontaminate, op8_best_fit_packing, op9_token_files, op10_quality, op11_top_k, op12_filter_audit, op13_divergence)}
SQL: dict[str, str] = {
    "op2_flat_graph": """
WITH RECURSIVE v AS (
 SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
 SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
 WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = e.vec_id""",
    "op11_top_k": """
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) GROUP BY vec_id),
w AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(CASE WHEN len(a.e) = 0 THEN 0 ELSE list_inner_product(a.e, b.e) END AS BIGINT) AS score FROM w a JOIN w b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op12_filter_audit": r"""
WITH lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT d.part, coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic, (len(w) < 200)::INT AS a, (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
  (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c, regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce((d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT, 0) AS e
 FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
cells AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(l, bit)),
orders AS (SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, f1.bit AS b1, f2.bit AS b2, f3.bit AS b3, f4.bit AS b4, f5.bit AS b5 FROM f f1, f f2, f f3, f f4, f f5
 WHERE f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
steps AS (SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM orders UNION ALL SELECT filter_order, 2, b2, b1 FROM orders UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM orders
 UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM orders UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM orders),
counts AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND good = 1), 0) AS good_lost, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic = 1), 0) AS toxic_lost
 FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counts""",
    "op13_divergence": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
o AS (SELECT lang, source, row, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * v.v) AS HUGEINT) AS p,
  CAST(1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS HUGEINT) AS q
 FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS i, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) x
  ON x.lang = a.lang AND x.s = a.source AND x.i = b.source),
apart AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM apart))
WHERE part = 'pair' OR rank <= 10""",
}
