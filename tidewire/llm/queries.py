"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dual_tree, exact_topk, hard_negatives, language_id, licenses, line_dedup, lm_scoring, pii, sentencepieces, simhash, small_world, suffix_dedup
from .common import table

#: A file of the machine, the same on every executor.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.digests(docs, PIECES).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.annotate(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.annotate(table(spark, sf_dir, "documents")).drop("spans")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.annotate(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.annotate(docs).drop("text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.predict(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.annotate(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.annotate(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_world.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_pii,
        op3_decontaminate,
        op4_suffix_dedup,
        op5_simhash,
        op6_license_scan,
        op7_language_id,
        op8_line_dedup,
        op9_exact_topk,
        op10_lm_scoring,
        op11_hard_negatives,
        op12_small_world,
        op13_dual_tree,
    )
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = f"regexp_extract_all({LOWER.format('text')}, '{WORD}')"

ORACLES: dict[str, str] = {
    "op3_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, len(w) AS n, least(13, len(w)) AS k, w FROM (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) x WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item_id, k, w, unnest(range(1, n - k + 2)) AS i FROM b) y),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) ks WHERE len(w) >= k) z),
hit AS (SELECT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.gram = bw.gram),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) u GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) v GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op8_line_dedup": f"""WITH d AS (SELECT doc_id, coalesce(source, '-') AS host, text, string_split(text, chr(10)) AS parts FROM documents),
total AS (SELECT host, count(*) AS n FROM d GROUP BY host),
bad AS (SELECT c.host, c.line FROM (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT doc_id, host, line FROM (SELECT doc_id, host, unnest(parts) AS line FROM d) a WHERE trim(line) <> '') b GROUP BY host, line) c
  JOIN total t ON c.host = t.host WHERE c.n >= {line_dedup.REPEATED} AND c.n > {line_dedup.RATIO}::DOUBLE * t.n),
flat AS (SELECT doc_id, host, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i FROM d),
kept AS (SELECT f.doc_id, count(*) AS n_kept, string_agg(f.line, chr(10) ORDER BY f.i) AS t FROM flat f LEFT JOIN bad b ON f.host = b.host AND f.line = b.line WHERE b.line IS NULL GROUP BY f.doc_id)
SELECT d.doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, (coalesce(len(parts), 0) - coalesce(n_kept, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op9_exact_topk": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) t WHERE rank <= 10""",
    "op13_dual_tree": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS}, []) AS w FROM documents),
total AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) a GROUP BY r, term),
df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, total GROUP BY term),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * docs) // words AS m FROM d, total WHERE len(w) > 0),
b AS (SELECT row_number() OVER () AS i, item_id, list_distinct(coalesce({WORDS}, [])) AS w FROM benchmark),
s AS (SELECT i, item_id, doc_id, m.r AS r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT i, item_id, unnest(w) AS term FROM b) q JOIN df USING (term) JOIN tf USING (term) JOIN m ON tf.r = m.r GROUP BY i, item_id, doc_id, m.r)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) t WHERE rank <= 10""",
    "op11_hard_negatives": f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place FROM s WHERE same) t WHERE place <= 5),
w AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND {hard_negatives.LOW} * p.positive_score <= {hard_negatives.OF} * s.score AND s.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5""",
    "op10_lm_scoring": f"""WITH d AS (SELECT doc_id, list_concat(['<'], coalesce(regexp_extract_all(lower(text), '{WORD}'), []), ['>']) AS w FROM documents),
t AS (SELECT doc_id, w[i] AS c, w[i + 1] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) a),
total AS (SELECT count(*) AS n FROM t),
both_ AS (SELECT c, x, count(*) AS n FROM t GROUP BY c, x),
ctx AS (SELECT c, count(*) AS n FROM t GROUP BY c),
uni AS (SELECT x, count(*) AS n FROM t GROUP BY x),
v AS (SELECT b.c, b.x, b.n < {lm_scoring.MIN_COUNT} AS off, CASE WHEN b.n >= {lm_scoring.MIN_COUNT} THEN log10(b.n::DOUBLE / ctx.n) ELSE log10({lm_scoring.ALPHA}::DOUBLE) + log10(uni.n::DOUBLE / total.n) END AS bits
  FROM both_ b JOIN ctx ON b.c = ctx.c JOIN uni ON b.x = uni.x, total)
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(CASE WHEN off THEN 1 ELSE 0 END)::BIGINT AS n_backoff, round(sum(bits) / count(*), 6) AS score FROM t JOIN v ON t.c = v.c AND t.x = v.x GROUP BY doc_id""",
}
