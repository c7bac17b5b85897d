"""BM25 by the index against a plain computation, rank fusion and reranking."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.operators import text_search

DOCS = "doc_id long, text string"


def plain(docs, queries, k):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    words = {}
    for i, t in docs:
        if i is not None:
            words.setdefault(i, []).extend(split(t))
    mean = sum(map(len, words.values())) / max(1, len(words)) or 1.0
    counts = {i: Counter(w) for i, w in words.items()}
    df = Counter(t for c in counts.values() for t in c)
    out = set()
    for q, text in queries:
        scores = []
        for i, c in counts.items():
            found = [t for t in {*split(text)} if t in c]
            if found:
                scores.append((-round(sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(words[i]) / mean)) for t in found), 9), i))
        out |= {(q, i, round(-s, 6), r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.fixture(scope="module")
def corpus():
    """Texts with common and rare words, copies among them, and one word in nearly all."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(["the", *rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randrange(1, 40))]) for _ in range(250)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[k]) for k in range(5)]
    queries = [(q, " ".join(["The", *rng.sample(words[: 5 + 20 * q], k=5)])) for q in range(14)]
    return docs, queries


@pytest.mark.parametrize("k,seed", [(1, 200), (5, 3), (5, 200), (20, 0)])
def test_search_equals_all_scores(spark, corpus, monkeypatch, k, seed):
    monkeypatch.setattr(text_search, "SEED_DOCUMENTS", seed)
    docs, queries = corpus
    got = text_search.search(text_search.index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(queries, "query_id long, text string"), k).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got} == plain(docs, queries, k)


def test_common_terms_are_not_followed(spark, corpus, monkeypatch):
    """What the floor is for: few of the pairs that share any term become candidates."""
    kept = {}
    real = text_search.written
    monkeypatch.setattr(text_search, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    docs, queries = corpus
    rare = [(q, f"the {t.split()[-1]}") for q, t in docs[:40]]
    text_search.search(text_search.index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(rare, "query_id long, text string"), 1).collect()
    assert kept["candidates"][0].count() < 0.5 * len(rare) * len(docs)


def test_odd_rows(spark):
    docs = [(1, "Größe — BMW_X5 中文"), (2, None), (3, ""), (None, "größe"), (4, "groesse größe"), (4, "more"), (5, "größe " * 3000)]
    queries = [(1, "GRÖSSE größe?"), (2, None), (3, "unknown"), (None, "größe"), (4, "x5 x5")]
    one = text_search.search(text_search.index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    assert {(r.query_id, r.doc_id) for r in one} == {(1, 1), (1, 4), (1, 5), (4, 1)}
    empty = spark.createDataFrame([], DOCS)
    assert text_search.search(text_search.index(empty), spark.createDataFrame(queries, "query_id long, text string"), 3).count() == 0


def test_fusion_and_reranking(spark):
    hits = "query_id long, doc_id long, rank int"
    text, vector = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], hits), spark.createDataFrame([(1, 11, 1), (1, 12, 2)], hits)
    got = [(r.query_id, r.doc_id, round(r.fused, 6), r.rank) for r in text_search.fused(text, vector, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, round(1 / 61 + 1 / 62, 6), 1), (1, 10, round(1 / 61, 6), 2), (2, 10, round(1 / 61, 6), 1)]
    shape = "text string, embedding array<float>, source string"
    queries = spark.createDataFrame([(1, "a b", [1.0, 0.0], "s"), (2, None, None, None)], f"query_id long, {shape}")
    docs = spark.createDataFrame([(10, "a a c", [0.0, 1.0], "s"), (11, "a b", None, None), (12, None, [1.0, 0.0], "t")], f"doc_id long, {shape}")
    pool = text.unionAll(vector)
    best = [(r.query_id, r.doc_id, r.score) for r in text_search.reranked(pool.select("query_id", "doc_id").distinct(), queries, docs, 3, 0.7, "source").orderBy("query_id", "rank").collect()]
    assert best == [(1, 10, 1.2), (1, 11, 1.0), (1, 12, 1.0), (2, 10, 0.0)]


@pytest.mark.parametrize("postings,asked", [(300, 8192), (2_000_000, 3), (300, 3)])
def test_blocks_of_queries_and_documents(spark, corpus, monkeypatch, postings, asked):
    """Whatever the blocks, the result is that of all scores, and a query leaves no more than its best documents of each block."""
    kept, real = {}, text_search.written
    monkeypatch.setattr(text_search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(text_search, "BLOCK_QUERIES", asked)
    monkeypatch.setattr(text_search, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    docs, queries = corpus
    common = [(q, f"the {text}") for q, text in queries]
    got = text_search.search(text_search.index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(common, "query_id long, text string"), 2).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got} == plain(docs, common, 2)
    blocks = kept["held"][0].count() // postings + 1
    assert kept["candidates"][0].count() < 3 * len(common) * blocks < len(common) * len(docs)


def test_queries_without_a_term_in_a_block(spark, monkeypatch):
    """Blocks of a document or so and queries by themselves: most have nothing in common."""
    monkeypatch.setattr(text_search, "BLOCK_POSTINGS", 2)
    monkeypatch.setattr(text_search, "BLOCK_QUERIES", 1)
    docs = [(k, f"own{k} own{k + 1} all") for k in range(12)]
    queries = [(q, f"own{q}") for q in range(4)] + [(9, "all own3")]
    got = text_search.search(text_search.index(spark.createDataFrame(docs, DOCS)), spark.createDataFrame(queries, "query_id long, text string"), 3).collect()
    assert {(r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got} == plain(docs, queries, 3)


def test_texts_are_split_once_where_a_row_is_a_document(spark, monkeypatch):
    plans, real = {}, text_search.written
    monkeypatch.setattr(text_search, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    text_search.index(spark.createDataFrame([(1, "a b"), (2, "b")], DOCS))
    assert plans["postings"].count("split(") == 1
