"""Cascade at its edges (shards, equal hashes, lists of hosts) and scripts of languages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, urls


@pytest.fixture
def keys(spark):
    return spark.range(3000).select(F.concat(F.lit("h"), (F.col("id") % 1500).cast("string"), F.lit(".example.org")).alias("key"))


def marked(keys):
    listed = keys.where(F.crc32("key") % 5 == 0).union(keys.select(F.lit("elsewhere.net").alias("key")))
    return [(r.key, r.listed, r.want) for r in urls.mark_listed(keys, "key", keys, listed).withColumn("want", F.crc32("key") % 5 == 0).collect()]


@pytest.mark.parametrize("shard", [4_000_000, 40])
def test_cascade_is_exact(keys, shard, monkeypatch):
    monkeypatch.setattr(urls, "SHARD_KEYS", shard)
    got = marked(keys)
    assert len(got) == 3000 and all(a == b for _, a, b in got)


def test_equal_hashes_are_told_apart(keys, monkeypatch):
    monkeypatch.setattr(urls, "MOST_LEVELS", 6)
    monkeypatch.setattr(urls, "hashes_of", lambda key: (F.length(key).cast("long"), F.lit(1).cast("long")))
    assert all(a == b for _, a, b in marked(keys.where("key < 'h12'")))


def test_lists_of_hosts_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.bad.net/x", "keep"), (2, "http://bad.net", "keep"), (3, "http://notbad.net", "keep"), (4, "http://one.org2", None), (5, None, "")], "page_id long, url string, listed string")
    listed = spark.createDataFrame([(".bad.net",), ("one.org2",), (None,), (".",), ("",)], "key string")
    got = urls.judge(pages, listed).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "block", "block"] and [r.listed for r in got] == ["keep", "keep", "keep", None, ""]
    assert {r.verdict for r in urls.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_scripts():
    names = lambda text: [langid.SCRIPTS[k] for k in langid.script_of(np.frombuffer(text.encode(), np.uint8)) if k]
    assert names("aß1") == ["Latin", "Latin"] and names("дѣ") == ["Cyrillic"] * 2 and names("ไท") == ["Thai"] * 2
    assert names("कか漢한გខع𠀀") == ["Devanagari", "Kana", "Han", "Hangul", "Georgian", "Khmer", "Arabic", "Han"]


def test_a_second_script_narrows_the_languages():
    en, de = "the cat and the dog of the house with this thing that they have", "der Hund und die Katze im Haus mit dem Ding das nicht ist"
    ru, uk, th = "кошка и собака в доме с этой вещью которую они имеют", "кішка і собака в хаті з цією річчю яку вони мають", "แมวและสุนัขในบ้านกับสิ่งนี้ที่พวกเขามี"
    model = langid.fit([x for x in (en, de, ru, uk, th) for _ in range(3)], [x for x in ("en", "de", "ru", "uk", "th") for _ in range(3)])
    latin = model.scripts[langid.SCRIPTS.index("Latin")]
    assert [model.langs[k] for k in np.flatnonzero(latin)] == ["de", "en"]
    for text, lang in ((en, "en"), (de, "de"), (ru, "ru"), (uk, "uk"), (th, "th")):
        assert langid.identify(model, text)[0] == lang
    _, _, scores = langid.word_scores(model, langid._bytes("qzx собака แมว"))
    allowed = [{model.langs[k] for k in np.flatnonzero(row > row.max() + langid.RULED_OUT)} for row in scores]
    assert allowed[0] <= {"de", "en"} and allowed[1] <= {"ru", "uk"} and allowed[2] <= {"th"}
    text = f"{en} {ru}. {en}"
    assert [(s, text[a:b].strip(" .")) for s, a, b in langid.identify(model, text)[2]] == [("en", en), ("ru", ru), ("en", en)]


def test_long_rows_are_learned_from(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_CHARS", 60)
    docs = spark.createDataFrame([(1, "der Hund und die Katze " * 40, "de"), (2, "the cat and the dog", "en"), (2, "the cat and the dog", "en"), (None, None, "fr"), (4, "", "es"), (5, "lost", None)], "doc_id long, text string, lang string")
    assert langid.train(docs).langs == ["de", "en"]
