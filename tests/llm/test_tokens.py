"""Byte-level BPE, alignment and n-gram features against their definitions."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import alignment, bpe, common, langid, resampling


@pytest.fixture(scope="module")
def coder():
    return bpe.coder()


def test_pieces_equal_the_merges(coder):
    rng = random.Random(3)
    for alphabet in ("ab", "aeinorst", "the ", "=-", "\u4e2d\u6587\u00e9", "xyz0129'"):
        for n in (1, 2, 3, 7, 30, 120):
            raw = "".join(rng.choices(alphabet, k=n)).encode()
            assert coder.encode_piece(raw) == coder.merged(raw)


def test_a_vocabulary_of_few_tokens():
    ranks = {bytes([b]): b for b in range(256)} | {x: 256 + k for k, x in enumerate((b"ab", b"bc", b"abc", b"cd", b"abcd", b"bcd", b"aa", b"aaaa"))}
    own = bpe.Coder(ranks)
    rng = random.Random(4)
    for _ in range(3000):
        raw = bytes(rng.choices(b"abcd", k=rng.randrange(1, 14)))
        # a whole token is taken as it is, as the library does; only reachable ones are in real vocabularies
        assert own.encode_piece(raw) == own.merged(raw)


def test_a_forgetful_coder_gives_the_same(coder, monkeypatch):
    texts = ["one two  three\n four", "one two", "", "zwei drei\tvier"]
    want = [coder.encode_whole(t) for t in texts]
    monkeypatch.setattr(bpe, "PAIRS", 2)
    monkeypatch.setattr("tessera.llm.units.CACHE_BYTES", 1)
    assert [coder.encode([t])[0] for t in texts] == want


def test_long_pieces_take_linear_time(coder):
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.perf_counter()
        ids = coder.encode_piece(b"ab" * (n // 2))
        took.append(time.perf_counter() - began)
        assert coder.decode(np.array(ids, "<u4").tobytes()) == b"ab" * (n // 2)
    assert took[1] < 20 * took[0] + 0.2


def test_decode_keeps_columns_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    coded = bpe.encode(docs)
    back = bpe.decode(coded.selectExpr("*", "'x' AS decoded")).collect()
    assert {(r.doc_id, r.decoded, bytes(r["_decoded"])) for r in back} == {(1, "x", b"a b"), (None, "x", b"")}
    assert bpe.decode(spark.createDataFrame([(1, None)], "k long, ids binary")).first().decoded is None


def test_links_laid_out_in_parts(monkeypatch):
    own = alignment.both()
    texts = ["the cat sat on the mat " * 5, "", "aaaa" * 50, "a\u0301b\u4e2d\U0001f600 " * 9, "the cat"]
    whole = alignment.Aligned(own.encode(texts), own.a_sizes, own.b_sizes)
    monkeypatch.setattr(alignment, "LINKS", 3)
    parts = alignment.Aligned(own.encode(texts), own.a_sizes, own.b_sizes)
    for name in ("doc", "pair", "times", "n_links"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_counts_do_not_depend_on_blocks_or_salts(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = sorted(map(tuple, alignment.align(docs).collect()))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(alignment, "SALTS", 2)
    assert sorted(map(tuple, alignment.align(docs.repartition(5)).collect())) == want


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_features_equal_all_runs_of_words(longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choices(["a", "b", "c", "\u00e9A"], k=rng.randrange(0, 12))) for _ in range(60)] + [None, "", "-"]
    text, bucket, n_words = resampling.features(texts, longest, 977)
    got = sorted(zip(text.tolist(), bucket.tolist()))
    want = []
    for k, t in enumerate(texts):
        words = resampling.words_of(t)
        assert n_words[k] == len(words)
        want += [(k, zlib.crc32(b" ".join(words[i : i + n])) % 977) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    assert got == sorted(want)


def test_resample_returns_whole_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resampling.resample(docs, target, longest=2, percent=20, buckets=500)
    ranks = resampling.ranked(docs, target, longest=2, percent=20, buckets=500).where("rank is not null")
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in ranks.collect()}


def test_a_sample_keeps_languages_of_few_texts(spark):
    many = spark.range(60_000).selectExpr("'fr' AS lang", "concat('bonjour ', id % 40) AS text")
    rows = many.union(spark.range(2000).selectExpr("'en'", "concat('hello ', id)"))
    got = common.sample_by(rows, "lang", langid.FIT_ROWS, langid.FIT_CHARS, langid.FIT_LANGS).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"fr": 40, "en": langid.FIT_ROWS}
