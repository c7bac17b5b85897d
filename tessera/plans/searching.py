"""Queries that search texts, alone and together with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as K
from tessera.operators import text_search
from tessera.operators.vectors import nearest_to_each
from tessera.sources.tables import table, written


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20, with the first line of its document, as far as a query may be long."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "source", F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(K.QUERY_CHARS)).alias("text"))
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").join(docs, "vec_id").select(F.col("vec_id").alias("query_id"), "text", "embedding", "source")


def lexical(spark: SparkSession, d: str) -> DataFrame:
    found = text_search.search(text_search.index(table(spark, d, "documents")), _queries(spark, d), 20)
    return found.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Twenty hits by words and by vectors as one list, of which the pairs themselves leave five."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    queries, _ = written(_queries(spark, d), "queries")
    by_words = text_search.search(text_search.index(docs), queries, 20)
    near = nearest_to_each(vectors, queries.select("query_id", "embedding"), 20).withColumnRenamed("vec_id", "doc_id")
    pool, _ = written(text_search.fused(by_words, near, 20), "pool")
    rows = docs.select("doc_id", "text", "source").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    best = text_search.reranked(pool, queries, rows, 5, 0.1, "source")
    return best.join(pool.select("query_id", "doc_id", "fused"), ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.round("fused", 6).alias("fused"), "rank")


QUERIES = {"text_search_bm25": lexical, "hybrid_search": hybrid}

_BM25 = r"""q AS (SELECT vec_id AS query_id, left(split_part(text, chr(10), 1), 500) AS text, embedding::DOUBLE[] AS v, source FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 20 = 0),
  w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
  tf AS (SELECT doc_id, term, len(w) AS n, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  sizes AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM w),
  qt AS (SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM q),
  bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 9) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term), sizes GROUP BY ALL),
  text_ranks AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 20)"""

ORACLE = {
    "text_search_bm25": f"WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM text_ranks",
    "hybrid_search": f"""WITH {_BM25},
  near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, embedding::DOUBLE[]) DESC, vec_id) AS rank FROM q JOIN embeddings ON vec_id <> query_id QUALIFY rank <= 20),
  sums AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank::DOUBLE)), 12) AS fused FROM (SELECT query_id, doc_id, rank FROM text_ranks UNION ALL SELECT query_id, doc_id, rank FROM near) GROUP BY query_id, doc_id),
  pool AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) <= 20),
  terms AS (SELECT query_id, list(term) FILTER (term <> '') AS t FROM qt GROUP BY query_id),
  pairs AS (SELECT p.query_id, p.doc_id, fused, round(coalesce(len(list_intersect(t, w.w)) / len(t), 0) + coalesce(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 0) + CASE WHEN q.source = d.source THEN 0.1::DOUBLE ELSE 0 END, 6) AS score
    FROM pool p JOIN q USING (query_id) JOIN terms USING (query_id) JOIN documents d USING (doc_id) JOIN w USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = p.doc_id)
  SELECT query_id, doc_id, round(score, 4) AS score, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5""",
}
