"""The registered queries of these operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, toxicity
from .brown import score_texts
from .common import fold, table
from .html_text import extract_main_text
from .media import text_media_features
from .mixing import Mix, mixture
from .packing import pack
from .simhash import near_duplicates
from .token_counts import token_counts
from .topk import top_k


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op3_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), Mix(entropy=0.95, repeats=4.0, budget=1.0))


def op5_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = language.train(docs.where(fold("doc_id", 5) != 0))
    found = language.identify(docs, network)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.PuModel:
    """Learned from the training fold of ``docs`` (doc_id, text) and its labels."""
    learn = docs.select("doc_id", "text").where(fold("doc_id", 3) != 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null").where(fold("doc_id", 3) != 1)
    return toxicity.train(learn, labels)


def op6_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media_features(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {
        "op1_vector_packing": op1_vector_packing,
        "op2_brown_classes": op2_brown_classes,
        "op3_threshold_topk": op3_threshold_topk,
        "op4_source_mixing": op4_source_mixing,
        "op5_language_gru": op5_language_gru,
        "op6_toxicity_pu": op6_toxicity_pu,
        "op7_media_sniffing": op7_media_sniffing,
        "op8_simhash": op8_simhash,
        "op9_token_counts": op9_token_counts,
        "op10_html_text": op10_html_text,
    }


ORACLES = {
    "op4_source_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS name,
                md5(CASE WHEN doc_id IS NULL THEN 'mix' ELSE 'mix|' || doc_id END) AS key,
                CAST(1 + coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens
            FROM documents
        ), s AS (
            SELECT name, tokens, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS p, sum(tokens) OVER () AS total, count(*) OVER () AS n
            FROM (SELECT name, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY name)
        ), by_entropy AS (
            SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
            UNION ALL
            SELECT step + 1, CASE WHEN h >= goal THEN (low + high) / 2 ELSE low END, CASE WHEN h >= goal THEN high ELSE (low + high) / 2 END
            FROM (
                SELECT b.step, b.low, b.high, 0.95 * ln(max(s.n)) AS goal,
                    ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) AS h
                FROM by_entropy b, s WHERE b.step < 32 GROUP BY b.step, b.low, b.high
            )
        ), by_repeats AS (
            SELECT 0 AS step, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
            UNION ALL
            SELECT step + 1, CASE WHEN r <= 4 THEN low ELSE (low + high) / 2 END, CASE WHEN r <= 4 THEN (low + high) / 2 ELSE high END
            FROM (
                SELECT b.step, b.low, b.high, max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) AS r
                FROM by_repeats b, s WHERE b.step < 32 GROUP BY b.step, b.low, b.high
            )
        ), first_t AS (
            SELECT CASE WHEN -sum(p * ln(p)) >= 0.95 * ln(max(n)) - 1e-12 THEN 1 ELSE (SELECT low FROM by_entropy WHERE step = 32) END AS t FROM s
        ), t AS (
            SELECT CASE WHEN max(pow(p, t - 1)) / sum(pow(p, t)) <= 4 THEN max(t) WHEN max(1) > 4 THEN 1 ELSE (SELECT high FROM by_repeats WHERE step = 32) END AS t FROM s, first_t
        ), q AS (
            SELECT name, tokens, pow(p, t) / (sum(pow(p, t)) OVER ()) AS weight, CAST(floor(pow(p, t) / (sum(pow(p, t)) OVER ()) * total + 1e-6) AS BIGINT) AS quota FROM s, t
        ), w AS (
            SELECT name, weight, CAST(quota // tokens AS INTEGER) AS passes, quota % tokens AS rest FROM q
        ), placed AS (
            SELECT d.*, w.weight, w.passes, w.rest, md5('mix|' || w.passes || '|' || d.name || '|' || substr(d.key, 1, 3)) || d.key AS place FROM d JOIN w USING (name)
        ), upto AS (
            SELECT *, sum(tokens) OVER (PARTITION BY name ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto FROM placed
        ), times AS (
            SELECT doc_id, source, name, key, weight, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS n FROM upto
        )
        SELECT doc_id, source, CAST(g.e AS INTEGER) AS pass, substr(key, 1, 3) AS block,
            md5('mix|' || g.e || '|' || name || '|' || substr(key, 1, 3)) || key AS place, round(weight, 6) AS weight FROM times, (SELECT unnest(range(0, 5)) AS e) g WHERE g.e < times.n
    """,
    "op3_threshold_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}


def oracle_sql() -> dict:
    return dict(ORACLES)
