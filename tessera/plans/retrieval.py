"""Queries over vectors: search, evaluation, and the whole similar-project question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import confidence, coverage, lacks_evidence, pass_rates
from tessera.operators.vectors import nearest, nearest_to_each
from tessera.sources.tables import table


def _vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _neighbours(spark: SparkSession, d: str, k: int) -> DataFrame:
    return nearest_to_each(table(spark, d, "embeddings"), _queries(spark, d), k)


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    got = nearest(table(spark, d, "embeddings"), _vector(spark, d), 10)
    return got.select("vec_id", "label", F.round(1 - F.col("distance"), 4).alias("similarity"))


def l2_clamped(spark: SparkSession, d: str) -> DataFrame:
    got = nearest(table(spark, d, "embeddings"), _vector(spark, d), 10, "l2")
    return got.select("vec_id", F.round("distance", 4).alias("distance"), "score")


def filter_modes(spark: SparkSession, d: str) -> DataFrame:
    e, v = table(spark, d, "embeddings"), _vector(spark, d)
    wanted = F.col("label").isin(1, 3, 5)
    before, after = nearest(e, v, 20, where=wanted), nearest(e, v, 20, then=wanted)
    return before.select(F.lit("before").alias("mode"), "vec_id", "label").union(after.select(F.lit("after"), "vec_id", "label"))


def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d, 3).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"), "rank")


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    got = _neighbours(spark, d, 3).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected")), "query_id")
    each = got.groupBy("query_id").agg(F.max((F.col("label") == F.col("expected")).cast("int")).alias("hit"))
    return pass_rates(each, pass_rate=F.col("hit") == 1).select("n", F.round("pass_rate", 6).alias("pass_rate"))


def confidence_bucket(spark: SparkSession, d: str) -> DataFrame:
    got = _neighbours(spark, d, 5).withColumn("score", F.round((1 + F.col("similarity")) / 2, 3))
    each = got.groupBy("query_id").agg(F.count("*").alias("n_scores"), F.max("score").alias("max_score"))
    return each.select("query_id", "n_scores", "max_score", confidence(F.col("n_scores"), F.col("max_score")).alias("confidence"))


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    each = _neighbours(spark, d, 5).groupBy("query_id").agg(F.count("*").alias("n"), F.max("similarity").alias("top"))
    return each.select("query_id", lacks_evidence(F.col("n"), F.round("top", 4)).alias("insufficient"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each query vector its five most similar projects: how sure, which functions they cover, and the sources to read."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    hits = _neighbours(spark, d, 5).withColumn("score", F.round((1 + F.col("similarity")) / 2, 3)).join(docs, "vec_id", "left").persist()
    each = hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.max("score").alias("max_score"),
        F.max(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("best_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("rank") <= 2) & F.col("source").isNotNull(), F.struct("rank", "source")))), lambda s: s["source"]), ",").alias("sources"),
    )
    covered = coverage(hits.withColumn("functions", F.array("lang")), "query_id", "functions")
    return each.join(covered, "query_id", "left").select(
        "query_id", "n_hits", "max_score", "best_id", "sources", F.coalesce(F.array_join("covered", ","), F.lit("")).alias("covered"),
        confidence(F.col("n_hits"), F.col("max_score")).alias("confidence"),
    )


_Q0 = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_NEAR = """near AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM near)"""
_CONFIDENCE = "CASE WHEN {n} >= 3 AND {top} >= 0.85 THEN '高' WHEN {n} >= 1 AND {top} >= 0.70 THEN '中' ELSE '低' END"

QUERIES = {
    "knn_topk_cosine": topk_cosine,
    "knn_l2_clamped": l2_clamped,
    "knn_postfilter": filter_modes,
    "knn_join_each": knn_join,
    "retrieval_eval_pass_rate": evaluation,
    "confidence_bucket": confidence_bucket,
    "insufficient_evidence_gate": evidence_gate,
    "similar_project_flagship": flagship,
}
ORACLE = {
    "knn_topk_cosine": f"SELECT vec_id, label, round(s, 4) AS similarity FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {_Q0} ORDER BY s DESC, vec_id LIMIT 10)",
    "knn_l2_clamped": f"SELECT vec_id, round(dd, 4) AS distance, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - dd)), 2) AS score FROM (SELECT vec_id, pow(list_distance(embedding::DOUBLE[], q), 2) AS dd FROM embeddings, {_Q0} ORDER BY dd, vec_id LIMIT 10)",
    "knn_postfilter": f"""WITH s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, {_Q0})
        SELECT 'before' AS mode, vec_id, label FROM (SELECT * FROM s WHERE label IN (1, 3, 5) ORDER BY s DESC, vec_id LIMIT 20)
        UNION ALL SELECT 'after', vec_id, label FROM (SELECT * FROM s ORDER BY s DESC, vec_id LIMIT 20) WHERE label IN (1, 3, 5)""",
    "knn_join_each": f"WITH {_NEAR} SELECT query_id, vec_id, round(similarity, 4) AS similarity, rank FROM ranked WHERE rank <= 3",
    "retrieval_eval_pass_rate": f"""WITH {_NEAR}, hit AS (SELECT query_id, max(CASE WHEN e.label = x.label THEN 1 ELSE 0 END) AS hit FROM ranked
        JOIN embeddings e USING (vec_id) JOIN embeddings x ON x.vec_id = query_id WHERE rank <= 3 GROUP BY query_id)
        SELECT count(*) AS n, round(avg(hit), 6) AS pass_rate FROM hit""",
    "confidence_bucket": f"""WITH {_NEAR}, e AS (SELECT query_id, count(*) AS n_scores, max(round((1 + similarity) / 2, 3)) AS max_score FROM ranked WHERE rank <= 5 GROUP BY query_id)
        SELECT *, {_CONFIDENCE.format(n='n_scores', top='max_score')} AS confidence FROM e""",
    "insufficient_evidence_gate": f"WITH {_NEAR} SELECT query_id, round(max(similarity), 4) < 0.65 AS insufficient FROM ranked WHERE rank <= 5 GROUP BY query_id",
    "similar_project_flagship": f"""WITH {_NEAR}, h AS (SELECT r.*, round((1 + similarity) / 2, 3) AS score, lang, source FROM ranked r LEFT JOIN documents ON doc_id = vec_id WHERE rank <= 5),
        e AS (SELECT query_id, count(*) AS n_hits, max(score) AS max_score, max(CASE WHEN rank = 1 THEN vec_id END) AS best_id,
          coalesce(string_agg(source, ',' ORDER BY rank) FILTER (WHERE rank <= 2), '') AS sources,
          coalesce(array_to_string(list_sort(list_distinct(list(lang) FILTER (WHERE lang IS NOT NULL))), ','), '') AS covered FROM h GROUP BY query_id)
        SELECT *, {_CONFIDENCE.format(n='n_hits', top='max_score')} AS confidence FROM e""",
}
