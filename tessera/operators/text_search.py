"""Lexical search by an inverted index with BM25, its fusion with vector hits, and reranking.

The index is two tables: postings (a term's weight in a document) and terms (their idf and the largest weight any document
has). Top-k search is exact and makes no table of pairs: documents are dealt into blocks by their ids and queries into blocks of their own, and a task
scores one block of queries against one block of documents, of which each query keeps its best. Within a block the postings of a query's terms are
summed at once, and common terms are rows of all documents of the block that are added: that is less work than finding out which could be left.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from tessera.operators.ranking import top_of_each
from tessera.operators.vectors import cosine
from tessera.sources.tables import written

K1, B = 1.2, 0.75
FUSION = 60  # of reciprocal rank fusion
SEED_DOCUMENTS, DENSE = 200, 3  # a term of more documents of a block, and of more than one in so many, is a row of all of them; any numbers are right
BLOCK_POSTINGS, BLOCK_QUERIES = 4_000_000, 65536  # about so many meet in a task
SLACK = 1e-6  # sums of doubles may differ by their order; nothing is left out for less than this


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order, with repeats; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


class Index(NamedTuple):
    """``postings(term, doc_id, weight)`` and ``terms(term, df, idf, most)``."""

    postings: DataFrame
    terms: DataFrame


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> Index:
    """The index of ``docs``, written to the shared folder. Rows without an id are left out; rows that share one are one document of all their terms."""
    # texts move once, by their ids, and words are counted where they then are; a given number of parts, as small texts are much
    # work; an outer explode, as the filter that a plain one implies would split every text once more before the move
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition(parts, "doc_id")
    words = texts.select("doc_id", terms_of(F.col("text")).alias("w")).select("doc_id", "w", F.size("w").alias("n"))
    rows, n = docs.where(F.col(id_col).isNotNull()).agg(F.count("*"), F.countDistinct(id_col)).first()
    if rows == n:  # a row is a document: its length goes with its words, and no text is split twice
        counted = words.select("doc_id", "n", F.explode_outer("w").alias("term")).where("term is not null").groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    else:
        lengths = words.groupBy("doc_id").agg(F.sum("n").alias("n")).hint("shuffle_hash")  # else all postings are sorted
        counted = words.select("doc_id", F.explode_outer("w").alias("term")).where("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(lengths, "doc_id")
    counts, _ = written(counted.select("term", "doc_id", "tf", "n"), "postings")
    total = counts.agg(F.sum("tf")).first()[0]
    mean = total / n if total else 1.0
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / mean))
    postings = counts.select("term", "doc_id", weight.alias("weight"))
    known = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("weight").alias("top"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms, _ = written(known.select("term", "df", idf.alias("idf"), (idf * F.col("top")).alias("most")), "terms")
    return Index(postings, terms)


def _best_of_block(asked: pa.Table, postings: pa.Table, k: int, seed: int) -> pa.Table:
    """``query_id, doc_id, score``: of ``asked(query_id, tid, idf)`` and ``postings(tid, doc_id, weight)`` each query's documents that reach its ``k``-th best score."""
    column = lambda t, c: t.column(c).to_numpy()
    ids, place = np.unique(column(postings, "doc_id"), return_inverse=True)
    tids, term = np.unique(column(postings, "tid"), return_inverse=True)
    order = np.argsort(term * len(ids) + place, kind="stable")  # each term's documents ascending
    wanted, one = np.unique(column(asked, "tid"), return_index=True)
    idf = np.zeros(len(tids))
    at = np.searchsorted(tids, wanted)
    here = (at < len(tids)) & (tids[np.minimum(at, len(tids) - 1)] == wanted) if len(tids) else np.zeros(len(at), bool)
    idf[at[here]] = column(asked, "idf")[one[here]]
    place, part = place[order], column(postings, "weight")[order] * idf[term[order]]
    ends = np.cumsum(np.bincount(term, minlength=len(tids)))
    starts = np.concatenate([ends[:0], [0], ends[:-1]]).astype(int) if len(tids) else ends
    sizes = ends - starts
    heavy = np.flatnonzero(sizes > max(seed, len(ids) / DENSE))
    dense, row = np.zeros((len(heavy), len(ids))), np.full(len(tids), -1)
    row[heavy] = np.arange(len(heavy))
    for t in heavy:
        dense[row[t], place[starts[t] : ends[t]]] = part[starts[t] : ends[t]]
    at = np.searchsorted(tids, column(asked, "tid"))
    known = (at < len(tids)) & (tids[np.minimum(at, len(tids) - 1)] == column(asked, "tid")) if len(tids) else np.zeros(len(at), bool)
    queries, at = column(asked, "query_id")[known], at[known]
    by_query = np.lexsort((at, queries))
    queries, at = queries[by_query], at[by_query]
    each, first = np.unique(queries, return_index=True)
    out = []
    for q, lo, hi in zip(each, first, np.append(first[1:], len(queries))[: len(each)], strict=True):
        own = at[lo:hi]
        some, full = own[row[own] < 0], row[own[row[own] >= 0]]
        spans = list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))
        score = np.bincount(np.concatenate([place[s:e] for s, e in spans]), np.concatenate([part[s:e] for s, e in spans]), len(ids)) if spans else np.zeros(len(ids))
        for r in full:
            score += dense[r]
        least = np.partition(score, -k)[-k] - SLACK if len(ids) > k else 0.0
        kept = np.flatnonzero((score >= least) & (score > 0))
        out.append((np.full(len(kept), q), ids[kept], score[kept]))
    columns = [np.concatenate(c) for c in zip((each[:0], ids[:0], part[:0]), *out, strict=True)]
    return pa.table(dict(zip(("query_id", "doc_id", "score"), map(pa.array, columns), strict=True)))


def search(found: Index, queries: DataFrame, k: int, text_col: str = "text") -> DataFrame:
    """``query_id, doc_id, score, rank`` of the ``k`` best documents of each of ``queries(query_id, text)`` (whole numbers as ids), by the sum of BM25 over its different
    terms, rounded to nine decimals, ties to the smaller ``doc_id``. Queries without a known term, or without an id, have no row."""
    asked = queries.where("query_id is not null").select("query_id", F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct()
    asked, _ = written(asked, "asked")
    terms, _ = written(asked.select("term").distinct().join(found.terms.select("term", "idf"), "term").withColumn("tid", F.monotonically_increasing_id()), "terms-asked")
    held, _ = written(found.postings.join(terms, "term").select("tid", "doc_id", "weight"), "held")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    blocks, parts = held.count() // BLOCK_POSTINGS + 1, queries.count() // BLOCK_QUERIES + 1
    wanted = asked.join(terms, "term").select("query_id", "tid", "idf", deal("query_id", parts).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = held.select("*", deal("doc_id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"))
    seed = SEED_DOCUMENTS

    shape = to_arrow_schema(T.StructType([T.StructField(c, t.schema[c].dataType) for c, t in (("query_id", asked), ("doc_id", held))] + [T.StructField("score", T.DoubleType())]))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_of_block(left, right, k, seed) if len(left) and len(right) else shape.empty_table()

    keys = ("slice", "block")
    scored = wanted.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(best, from_arrow_schema(shape))
    scored, _ = written(scored.withColumn("score", F.round("score", 9)), "candidates")
    return top_of_each(scored, "query_id", [F.desc("score"), "doc_id"], k)


def fused(text_hits: DataFrame, vector_hits: DataFrame, k: int, c: int = FUSION) -> DataFrame:
    """``query_id, doc_id, fused, rank``: two ranked lists ``(query_id, doc_id, rank)`` as one, by the sum of ``1 / (c + rank)``, ties to the smaller ``doc_id``."""
    one = lambda hits: hits.select("query_id", "doc_id", (1 / (F.lit(float(c)) + F.col("rank"))).alias("part"))
    both = one(text_hits).unionAll(one(vector_hits)).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("fused"))
    return top_of_each(both, "query_id", [F.desc("fused"), "doc_id"], k)


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int, boost: float = 0.0, field: str | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: of ``hits(query_id, doc_id)`` the ``k`` best by what the pair itself shows: the share of the query's
    different terms that the whole document has, plus the cosine of their vectors (0 without one), plus ``boost`` where both have the same ``field``.

    ``queries(query_id, text, embedding[, field])``, ``docs(doc_id, text, embedding[, field])``, one row an id.
    """
    extra = [field] if field else []
    q = queries.select("query_id", F.array_distinct(terms_of(F.col("text"))).alias("q_terms"), F.col("embedding").alias("q_vector"), *(F.col(f).alias("q_field") for f in extra))
    d = docs.join(hits.select("doc_id").distinct(), "doc_id").select("doc_id", terms_of(F.col("text")).alias("d_terms"), F.col("embedding").alias("d_vector"), *(F.col(f).alias("d_field") for f in extra))
    both = hits.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id")
    size = F.size("q_terms")
    share = F.when(size > 0, F.size(F.array_intersect("q_terms", "d_terms")) / size).otherwise(0.0)
    score = share + F.coalesce(cosine(F.col("q_vector"), F.col("d_vector")), F.lit(0.0))
    if field:
        score = score + F.when(F.col("q_field") == F.col("d_field"), F.lit(boost)).otherwise(0.0)
    return top_of_each(both.select("query_id", "doc_id", F.round(score, 6).alias("score")), "query_id", [F.desc("score"), "doc_id"], k)
