"""Keywords inside texts: the index against looking for each in each."""

import random

from tessera.operators import joins, keywords


def words(rng, n):
    return ["".join(rng.choices("abcAé中", k=rng.randrange(1, 7))) for _ in range(n)]


def test_contained_equals_all_pairs(spark):
    rng = random.Random(8)
    keys = [*words(rng, 300), "", None, "a.b*", "ab", "AB"]
    texts = [(k, " ".join(words(rng, rng.randrange(0, 9)))) for k in range(120)] + [(900, None), (901, ""), (902, "x a.b* y"), (903, "a" * 20_000 + "é中a")]
    got = keywords.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(k,) for k in keys], "keyword string"), "id", "text").collect()
    want = {(i, k) for i, t in texts for k in keys if k and t is not None and k.lower() in t.lower()}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "keyword string")
    assert keywords.contained(spark.createDataFrame(texts, "id long, text string"), none, "id", "text").count() == 0


def test_longest_keyword_wins_and_the_rest_is_reported(spark):
    items = spark.createDataFrame([(1, "Front chassis and BIW"), (2, "Chassis"), (3, "Seats"), (4, None)], "id long, item string").selectExpr("*", "'old' AS target")
    mapping = spark.createDataFrame([("chassis", "5"), ("Front Chassis", "6"), ("BIW", "2"), ("biw", "1"), ("chassis", "7"), (None, "9")], "keyword string, target string")
    got = keywords.mapped(items, mapping, "id", "item")
    assert {(r.id, r.keyword, r.target) for r in got.collect()} == {(1, "Front Chassis", "6"), (2, "chassis", "5"), (3, None, None), (4, None, None)}
    assert {r.id for r in keywords.unmapped(got).collect()} == {3, 4}


def test_long_lists_give_what_short_ones_do(spark, monkeypatch):
    rng = random.Random(9)
    names = [(k, " ".join(words(rng, 3))) for k in range(60)] + [(99, None), (100, "")]
    projects = spark.createDataFrame(names, "id long, project_name string")
    baselines = spark.createDataFrame([(k, w) for k, w in enumerate(words(rng, 40))] + [(99, "default")], "key_ord int, key string")
    texts = spark.createDataFrame([(f"d{k % 4}", w) for k, w in enumerate(words(rng, 40))], "dimension string, keyword string")
    rows = lambda: (sorted(map(tuple, joins.baseline_of(projects, baselines).collect()), key=str), sorted(((r.id, r.project_name, tuple(r.dimensions)) for r in joins.mentions(projects, projects.project_name, texts).collect()), key=str))
    short = rows()
    monkeypatch.setattr(joins, "LIST_ROWS", 5)
    assert rows()[0] == short[0]
    empty = lambda r: [(i, n or "", d) for i, n, d in r]
    assert empty(rows()[1]) == [(i, n, d or ()) for i, n, d in empty(short[1])]
