"""Pages as sequences: order, captions and text of well-formed and broken pages; what is stored and its feature."""

import hashlib
import re

import numpy as np
import pytest

from tessera.llm import media, queries


def plain(html):
    return [(x["text"] if x["kind"] == "text" else f"<{x['ref']}|{x['caption']}>") for x in media.sequence(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<p>b<img src=x alt=t>c", ["a", "b", "<x|t>", "c"]),
        ("<figure><figcaption>cap</figcaption><img src=x alt=t></figure>z", ["<x|cap>", "z"]),
        ("<figure><img src=x><figcaption>cap</figure><p>z", ["<x|cap>", "z"]),
        ("<figure><img src=x><figcaption>cap", ["<x|cap>"]),
        ("<div><figure><img src=x><figcaption>cap</div><p>rest of the page", ["<x|cap>", "rest of the page"]),
        ("<figure><img src=x><figcaption><p>one</p> two</figcaption></figure>", ["<x|one two>"]),
        ("<figure><img src=x></figure><img src=y alt=t><figure><img src=z><figcaption>c</figcaption></figure>", ["<x|None>", "<y|t>", "<z|c>"]),
        ("<figure>in<figure><img src=x><figcaption>inner</figcaption></figure><img src=y><figcaption>outer</figcaption></figure>", ["in", "<x|inner>", "<y|outer>"]),
        ("<figure><figcaption>no picture</figcaption></figure>", ["no picture"]),
        ("<figcaption>stray</figcaption><img src=x>", ["stray", "<x|None>"]),
        ("<title>open <p>page text", ["open", "page text"]),
        ("<title>gone</title><p>page text", ["page text"]),
        ("<div><template><p>gone</p></template>kept</div>", ["kept"]),
        ("<div><template>open</div><p>rest", ["open", "rest"]),
        ("<p>a<script>var x = '<p>';</script>b<style>p{}</style>", ["ab"]),
        ("<img alt=none><video src=v></video>&amp;", ["<v|None>", "&"]),
        ("", []), (None, []), ("<figure></figure></figure></figcaption></p>", []),
    ],
)
def test_sequences(html, want):
    assert plain(html) == want
    assert [x["position"] for x in media.sequence(html)] == list(range(len(want)))


def test_no_word_of_a_supplied_page_is_lost(spark, sf_dir):
    got = {}
    for r in queries.QUERIES["page_items"](spark, sf_dir).collect():
        got.setdefault(r.page_id, []).append((r.position, r.text))
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub(r"<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html, flags=re.S)
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        own = sorted(got[r.page_id])
        assert [p for p, _ in own] == list(range(len(own)))
        assert "".join(" ".join(t for _, t in own if t).split()) == "".join(words)


def test_stored_form_and_feature(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op2_media"](spark, sf_dir).collect():
        raw = docs[r.doc_id].encode()
        samples = np.frombuffer(raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw)), np.uint8).reshape(-1, 192)
        stored = b"P5\n192 %d\n255\n" % len(samples) + samples.tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = samples.astype(np.int64)
        parts = dict(p.split("=") for p in r.feature.split(";")[1:])
        assert r.feature.startswith(f"192x{len(samples)};") and int(parts["mean"]) == int(x.sum()) * 1000 // x.size
        assert int(parts["var"]) == (int((x * x).sum()) * x.size - int(x.sum()) ** 2) // x.size**2
        assert int(parts["step"]) == int(np.abs(np.diff(x, axis=1)).sum()) * 1000 // x.size
        assert [int(v) for v in parts["levels"].split("/")] == [int((x // 32 == k).sum()) * 1000 // x.size for k in range(8)]
        assert (r.position, r.caption) == (1, f"document {r.doc_id}")


def test_references_keep_their_place_whether_or_not_resolved(spark):
    from pyspark.sql import functions as F

    known = hashlib.sha256(b"text").hexdigest()
    pages = spark.createDataFrame([(1, f'a<figure><img src="sha256:{known}"><figcaption>c</figcaption></figure><img src="http://x">'), (1, None), (None, "t")], "page_id long, html string")
    stored = media.media_table(spark.createDataFrame([("text",), ("text",), (None,)], "text string"))
    got = media.interleave(pages, "page_id", F.col("html"), stored).orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.kind, r.caption, r.n_bytes) for r in got] == [(None, 0, "text", None, None), (1, 0, "text", None, None), (1, 1, "media", "c", 4), (1, 2, "media", None, None)]
