"""The pipeline's stages against brute force, each on its own input."""

import pytest

import corpus_pipeline
from tessera.llm import decontam
from test_contracts import ODD, base_spans, plain_fingerprint


def five(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups(texts):
    """Component of each text: five-word similarity of 0.8 or more, or at most three differing fingerprint bits."""
    sets, prints, root = [five(t) for t in texts], [plain_fingerprint(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if (both and both >= 0.8 * len(sets[a] | sets[b])) or (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(b)] = find(a)
    return [find(i) for i in range(len(texts))]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.toPandas()
        kept = {*after.doc_id}
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert len(after) > 0.85 * len(before)
        if name == "near_duplicates":
            least = {}
            for i, g in zip(before.doc_id, groups(list(before.text))):
                least[g] = min(i, least.get(g, i))
            assert kept == {*least.values()}
        if name == "decontamination":
            norm = [decontam.normalise(t) for t in items.text]
            for i, t in zip(before.doc_id, before.text):
                if any(x in decontam.normalise(t) for x in norm if len(x) >= decontam.LEAST_BYTES):
                    assert i not in kept
            assert len(after) > 0.9 * len(before)
        if name == "pii":
            assert len(after) == len(before) and not any(base_spans(t) for t in after.text)
            assert (after.n_chars == after.text.str.len()).all()
        if name == "packing":
            assert kept == {*before.doc_id}


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, two texts under one id, and columns named as operators name theirs."""
    base = str(tmp_path_factory.mktemp("odd_pipeline"))
    rows = [*ODD, (1, "another text under this id, quite unlike the first", "en"), (None, "no id here", "en")]
    clash = [f"'keep' AS {c}" for c in ("toxicity", "pii", "_row", "_hash", "_label", "fp", "root", "language", "listed", "s", "minima", "key", "item_id", "start")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars", *clash)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "number 999 of nothing at all that anyone holds"), (2, None), (3, ""), (4, "ring +49 170 1234567, later 170 1234567 or 1701234567"), (5, "xyzzy")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        found = out.collect()
        assert all(r.toxicity == r.pii == r._row == r.fp == "keep" for r in found)
        got[name] = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in found)
    every = sorted(((i is None, i or 0), t or "") for i, t in rows)
    assert got["toxicity"] == every  # nothing to learn from such labels
    first = {}
    for (i, t), g in zip(rows, groups([t for _, t in rows])):
        first[g] = min(first.get(g, (True, 1 << 60)), (i is None, i or 0))
    assert sorted(i for i, _ in got["near_duplicates"]) == sorted(first.values())
    assert [x for x in every if x not in got["decontamination"]] == [((False, 10), ODD[-2][1])]
    assert [i for i, _ in got["pii"]] == [i for i, _ in every] and not any(base_spans(t) for _, t in got["pii"])
    pieces = corpus_pipeline.packing(spark, docs, odd).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in rows}


def test_run_on_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
