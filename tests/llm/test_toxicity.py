"""Held-out accuracy of the toxicity field and what its spans say."""

import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import toxicity


@pytest.fixture(scope="module")
def labelled():
    rows = duckdb.sql("SELECT d.doc_id, text, toxic FROM '/root/testdata/sf0.1/documents.parquet' d JOIN '/root/testdata/sf0.1/labels.parquet' USING (doc_id) WHERE length(text) BETWEEN 1 AND 20000 ORDER BY ALL").fetchall()
    part = lambda held: [(t, y) for i, t, y in rows if (zlib.crc32(str(i).encode()) % 3 == 1) == held]
    known = dict(part(False))
    return toxicity.fit(list(known), list(known.values())), part(True)


def test_held_out_documents(labelled):
    model, held = labelled
    power, scores = toxicity._powers(model), toxicity.Scores(model)
    words = [toxicity.tokens(t) for t, _ in held]
    score = np.array([toxicity.score_of(model, toxicity.expected(model, w, power, scores)[0], len(w)) for w in words])
    y = np.array([y for _, y in held])
    assert (score[y == 1] >= toxicity.THRESHOLD).mean() > 0.9 and (score[y == 0] >= toxicity.THRESHOLD).mean() < 0.005


def test_spans_are_words_of_the_field(spark, labelled):
    model, held = labelled
    texts = [t for t, y in held if y][:40] + [None, "", "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("text", toxicity.scorer(model)("text").alias("t")).collect()
    spans = 0
    for r in rows:
        for s in r.t.spans:
            word = r.text[s.start : s.end]
            assert s.p > 0.5 and toxicity.tokens(word) == [toxicity.lowered(word)] and any(f in model.words for f in toxicity.features(toxicity.lowered(word)))
            spans += 1
    assert spans > 30
