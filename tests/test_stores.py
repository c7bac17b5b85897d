"""Bucketed tables and moved timelines."""

import os

import pytest

from tessera.operators import ingest, planning


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    store = ingest.Buckets(spark, root, 8)
    assert store.read() is None
    rows = spark.range(200).selectExpr("id AS doc_id", "'old' AS text")
    assert store.upsert(rows) == list(range(8))
    before = files(root)
    touched = store.upsert(spark.createDataFrame([(7, "new", 1), (7_000, "more", 2)], "doc_id long, text string, extra int").where("doc_id = 7"))
    after = files(root)
    assert len(touched) == 1 and all(f"bucket={touched[0]}/" in f for f in before ^ after) and before != after
    got = {r.doc_id: (r.text, r.extra) for r in spark.read.option("mergeSchema", True).parquet(f"{root}/data").collect()}
    assert len(got) == 200 and got[7] == ("new", 1) and got[8] == ("old", None)
    assert store.upsert(rows.limit(0)) == []


def test_keys_leave_and_buckets_empty(spark, tmp_path):
    store = ingest.Buckets(spark, str(tmp_path / "t"), 4)
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "doc_id long, text string"))
    store.upsert(spark.createDataFrame([(3, "c")], "doc_id long, text string"), spark.createDataFrame([(1,), (2,), (99,)], "doc_id long"))
    assert {(r.doc_id, r.text) for r in store.read().collect()} == {(3, "c"), (None, "n")}


def test_an_interrupted_batch_is_put_in_place(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    store = ingest.Buckets(spark, root, 4)
    store.upsert(spark.range(40).selectExpr("id AS doc_id", "'old' AS text"))
    with monkeypatch.context() as m:
        m.setattr(ingest.Buckets, "_put", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.upsert(spark.createDataFrame([(3, "new")], "doc_id long, text string"))
    assert {r.text for r in store.read().collect()} == {"old"}
    again = ingest.Buckets(spark, root, 4)
    assert [(r.doc_id) for r in again.read().where("text = 'new'").collect()] == [3] and again.read().count() == 40
    assert not os.path.exists(f"{root}/aside")


def moved(spark, cells, segments):
    got = planning.remapped(spark.createDataFrame(cells, "p long, r string, month int, fte double"), spark.createDataFrame(segments, "p long, old_from double, old_to double, new_from double, new_to double"), "p", ["p", "r"])
    return {(r.p, r.r, r.month): r.fte for r in got.collect()}


def test_totals_are_kept(spark):
    cells = [(1, "a", m, 0.7) for m in range(1, 8)] + [(1, "b", 3, 1.0), (1, "b", 4, 0.0), (2, "a", 1, 2.0)]
    got = moved(spark, cells, [(1, 0.0, 2.0, 0.0, 5.0), (1, 2.0, 7.0, 5.0, 6.5), (2, 0.0, 1.0, 0.0, 1.0)])
    assert round(sum(v for (p, r, _), v in got.items() if (p, r) == (1, "a")), 1) == 4.9 and got[2, "a", 1] == 2.0
    assert got[1, "a", 1] == 0.3 and got[1, "a", 6] > got[1, "a", 1] and {m for p, r, m in got if (p, r) == (1, "b")} == {6}


def test_stretches_without_length_and_uncovered_months(spark):
    got = moved(spark, [(1, "a", 1, 1.0), (1, "a", 2, 3.0), (1, "a", 3, 5.0), (9, "a", 1, 1.0)], [(1, 0.0, 1.0, 0.0, 0.0), (1, 1.0, 2.0, 2.0, 2.0)])
    assert got == {(1, "a", 1): 1.0, (1, "a", 2): 3.0}
    assert moved(spark, [], [(1, 0.0, 1.0, 0.0, 1.0)]) == {}
