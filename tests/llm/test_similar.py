"""Near copies of the pipeline's stage against brute force over five-word shingles."""

import random

import corpus_pipeline
from tessera.llm import similar
from test_pipeline import groups


def five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_near_copies_beyond_three_bits(spark, sf_dir):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (60, 90, 140, 250, 400) * 6:
        base = rng.choices(words, k=n)
        texts.append(" ".join(base))
        for share in (0.005, 0.012, 0.018, 0.03, 0.08):
            copy = list(base)
            for at in rng.sample(range(n), max(1, int(share * n))):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    sets = list(map(five, texts))
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 50 and not [p for p in alike if kept.issuperset(p)]
    assert all(kept.intersection(range(i, i + 6)) for i in range(0, len(texts), 6))


def test_rows_with_shared_or_missing_ids(spark, sf_dir):
    text = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(None, text["a"])] * 3 + [(1, text["b"])] * 3 + [(5, text["c"]), (7, text["c"]), (7, text["d"]), (None, text["d"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "a"), (1, "b"), (5, "c"), (7, "d")]


def smallest(texts):
    """The smallest number of each group."""
    return set({g: i for i, g in reversed(list(enumerate(groups(texts))))}.values())


def edited(rng, words, base, edits):
    copy = list(base)
    for at in rng.sample(range(len(base)), edits):
        copy[at] = rng.choice(words)
    return copy


def test_a_large_group_of_near_copies_gives_few_pairs(spark, sf_dir, monkeypatch):
    """400 copies of one text, of which some are within 0.8 of it and some are not: the pairs left for the join follow the copies, not their square."""
    rng, met = random.Random(5), []
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=144)
    texts = [" ".join(edited(rng, words, base, rng.choice((0, 1, 2, 3, 4, 5, 6)))) for _ in range(400)]

    def counted(left, right, t, plain=similar.meeting):
        pairs = plain(left, right, t)
        met.append(pairs.where("a < b and a_top <> b_top").select("a", "b").distinct().count())
        return pairs

    monkeypatch.setattr(similar, "meeting", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert sum(met) <= len(texts)
    assert kept == smallest(texts) and 5 < len(kept) < 300


def test_keys_of_few_sets_need_no_join_of_shingles(spark, sf_dir, monkeypatch):
    """Groups of three whose likeness is near 0.7 are compared pair by pair, though nothing connects them."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(9000)]
    texts = [" ".join(edited(rng, words, base, edits)) for base in (rng.choices(words, k=140) for _ in range(20)) for edits in (0, 5, 5)]
    monkeypatch.setattr(similar, "meeting", None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == smallest(texts)
