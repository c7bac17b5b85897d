"""The parts of the operators: bounds, exactness of shortcuts, and behaviour on made-up cases."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, decontam, langid, licenses, media, packing, pii, simhash, toxicity, urls
from tessera.operators import graph as components


def test_golay_keys_reach_every_link_of_three_bits():
    rng = np.random.default_rng(5)
    one = rng.integers(-(1 << 62), 1 << 62, 400)
    two = one.copy()
    for k in range(len(two)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            two[k] = np.int64(np.uint64(two[k]) ^ (np.uint64(1) << np.uint64(bit)))
    row, key = simhash.golay_keys(one, False)
    row2, key2 = simhash.golay_keys(two, True)
    own, near = {}, {}
    for r, k in zip(row, key):
        own.setdefault(int(r), set()).add(int(k))
    for r, k in zip(row2, key2):
        near.setdefault(int(r), set()).add(int(k))
    assert all(own[k] & near[k] for k in range(len(one)))


def test_components(spark):
    pairs = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (5, 5), (1000, 1001)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len({got[k] for k in range(201)}) == 1 and got[1000] == got[1002] != got[0]


def test_a_large_group_of_near_copies(spark):
    from pyspark.sql import functions as F

    base = 0x123456789ABCDEF
    values = [base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(40), 2)] + [7]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    links = simhash.links(fps)
    assert links.where(F.expr("bit_count(a ^ b) > 3")).count() == 0
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert len({roots[v] for v in values[:-1]}) == 1 and 7 not in roots


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.sampled_from([64, 128]))
@settings(max_examples=60, deadline=None)
def test_windows_are_the_cheapest(lengths, size):
    ends = [np.arange(3, n, 7) for n in lengths]
    places, penalties = packing.cuts(lengths, ends, size)
    chain = packing.best_windows(places, penalties, size)

    def cost(a, b):
        n = int(places[b] - places[a])
        return (0 if n & (n - 1) == 0 and n >= packing.LEAST_POWER else size - n) + int(penalties[b])

    best = [0] + [math.inf] * (len(places) - 1)
    for j in range(1, len(places)):
        best[j] = min((best[i] + cost(i, j) for i in range(j) if places[j] - places[i] <= size), default=math.inf)
    assert sum(cost(a, b) for a, b in zip(chain, chain[1:])) == best[-1]


@given(st.text(alphabet=st.sampled_from("ab é\n\t .,'1😀ß"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _coder
    if "_coder" not in globals():
        _coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.tokens().ids([text])[0].tolist() == _coder.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab.@-+ 1234()%_"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_patterns_equal_the_contract(text):
    from test_contracts import base_spans

    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_spans(text)


def test_loopy_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    own, edges, potentials = rng.normal(size=(4, 5)), np.array([(0, 1), (1, 2), (1, 3)]), rng.normal(size=(3, 5, 5))
    total = np.zeros((4, 5))
    for labels in itertools.product(range(5), repeat=4):
        w = math.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(potentials[e, labels[a], labels[b]] for e, (a, b) in enumerate(edges)))
        for i, x in enumerate(labels):
            total[i, x] += w
    assert np.allclose(pii.propagate(own, edges, potentials), total / total.sum(1, keepdims=True), atol=1e-3)


def test_repeated_numbers_share_their_label():
    field = pii.fit(["call +49 170 1234567 now", "mail anna.b@c.de or 12 apples", "number 1234567890123456 is none"] * 5)
    text = "call +49 170 1234567 now and 1701234567 then; 42 apples"
    assert [(text[a:b], base) for _, a, b, base in pii.all_spans(field, text)] == [("+49 170 1234567", True), ("1701234567", False)]
    assert pii.redact(text, pii.all_spans(field, text)) == "call [PHONE] now and [PHONE] then; 42 apples"


def test_the_field_runs_on_every_document_with_open_units():
    field = pii.Field()
    field.unit[2] = [0, 3.0, 0, 0, 0]  # an @ speaks for an address
    assert pii.all_spans(field, "ask @alice99 now") == [(0, 4, 12, False)]  # neither a base span nor a repeated key


def test_forward_backward_is_exact():
    model = toxicity.Model(bias=-0.7, transitions=np.array([[0.3, -0.2], [0.1, 0.5]]))
    places, scores, n = [1, 4], [2.0, -0.5], 6
    total = np.zeros(2)
    whole = 0.0
    for tags in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(model.bias * t + (scores[places.index(i)] * t if i in places else 0) for i, t in enumerate(tags)) + sum(model.transitions[a, b] for a, b in zip(tags, tags[1:])))
        whole += w
        for k, place in enumerate(places):
            total[k] += w * tags[place]
    assert np.allclose(toxicity.marginals(model, places, scores, n), total / whole)


def test_toxic_stems_are_learned():
    rng = random.Random(3)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "so", "pe", "vi")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [f"{say(20)} zorgl{rng.choice(words)} {say(5)} zorgl{rng.choice(words)}" for _ in range(60)] + [say(30) for _ in range(240)]
    model = toxicity.fit(texts, [1] * 60 + [0] * 240)
    score = lambda t: toxicity.score_of(model, toxicity.expected(model, toxicity.tokens(t))[0], len(toxicity.tokens(t)))
    assert score(f"{say(10)} zorglunseen {say(4)} zorglnever") > 0.7
    assert score(say(200)) < 0.2 and score("") < 0.5


def test_toxic_spans_hold_where_lower_case_is_longer(spark):
    model = toxicity.Model(words={toxicity.features("grubsnort")[0]: 0}, weights=np.array([9.0]), bias=-4.0)
    model.logistic = np.array([0.0, 1.0, 0.0])
    held = ["\u0130stanbul: you are a GRUBSNORT and no more", "Istanbul: you are a GRUBSNORT and no more"]
    got = spark.createDataFrame(list(enumerate(held)), "k int, text string").coalesce(1).select("k", toxicity.scorer(model)("text").alias("t")).orderBy("k").collect()
    spans = [[(s.start, s.end) for s in r.t.spans] for r in got]
    assert spans[0] == spans[1] and any(held[0][a:b] == "GRUBSNORT" for a, b in spans[0]) and got[0].t.score == got[1].t.score


def test_samples_stay_bounded_where_rows_share_an_id(spark):
    from pyspark.sql import functions as F

    from tessera.llm.common import sample_texts

    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert sample_texts(docs, 50, 100).count() == 50
    labels = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).words == {}  # one label only: the base rate is all there is to learn
    assert langid.train(docs).langs == ["en"]


def test_best_path_shortcut_changes_nothing():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.normal(scale=rng.choice([0.5, 5, 12]), size=(rng.integers(1, 12), 3))
        path = langid.best_path(scores)

        def value(p, scores=scores):
            return sum(scores[i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))

        n = len(scores)
        best = max((value(p) for p in itertools.product(range(3), repeat=n)), default=0) if n <= 7 else None
        assert best is None or abs(value(path) - best) < 1e-9


def test_mixed_languages_have_spans():
    en, de = "the cat and the dog of the house with this thing that they have", "der Hund und die Katze im Haus mit dem Ding das nicht ist"
    model = langid.fit([en] * 3 + [de] * 3, ["en"] * 3 + ["de"] * 3)
    lang, score, spans = langid.identify(model, f"{en} {de}. {en}")
    assert lang == "en" and [s[0] for s in spans] == ["en", "de", "en"] and spans[0][1] == 0 and spans[-1][2] == len(f"{en} {de}. {en}")


def test_items_with_edits_are_found():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    item = " ".join(word() for _ in range(30))
    index = decontam.build([(1, item)])
    other = " ".join(word() for _ in range(400))
    changed = list(item)
    for k in (20, 80, 130):
        changed[k] = "z"
    held = f"{other} {''.join(changed).upper()}, {other}"
    (edits, a, b), = decontam.matches(index, decontam.normalise(held)).values()
    assert edits == 3 and abs((b - a) - len(item)) <= 3
    assert decontam.matches(index, decontam.normalise(other)) == {}
    assert decontam.matches(index, decontam.normalise(" ".join(item.split()[:10]) + other)) == {}


def test_items_with_all_edits_allowed_are_found():
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    around = letters(500)
    for m in (24, 25, 50, 75, 120, 226, 600):
        item = letters(m)
        index, k = decontam.build([(1, item)]), 8 * m // 100
        assert index.budgets.tolist() == [k] and index.needs[0] >= 1
        places = [(i + 1) * m // (k + 1) for i in range(k)]
        for kind in ("change", "drop", "add"):
            held = list(item)
            for at in places:
                held[at] = {"change": "0", "drop": "", "add": held[at] + "0"}[kind]
            (edits, _, _), = decontam.matches(index, decontam.normalise(f"{around} {''.join(held)} {around}")).values()
            assert edits <= k and (edits == k or kind == "drop")
        held = list(item)
        for at in range(3, 3 + 2 * (k + 1), 2):
            held[at] = "0"
        assert decontam.matches(index, decontam.normalise(f"{around} {''.join(held)} {around}")) == {}


def test_leaks_of_a_long_text_are_found_at_slice_edges(monkeypatch):
    monkeypatch.setattr(decontam, "SLICE", 500)
    item = "an item of quite some words that nobody would write twice by chance alone"
    index = decontam.build([(1, item)])
    for n in range(440, 520, 7):
        assert len(decontam.matches(index, decontam.normalise("x y " * (n // 4) + "q" * (n % 4) + " " + item + " tail " * 50))) == 1


@given(st.text(alphabet=st.sampled_from("\\<#blhn/turn>\n: "), max_size=30), st.text(alphabet=st.sampled_from("\\<#\n:ab"), max_size=8))
@settings(max_examples=25, deadline=None)
def test_escapes_are_reversible(text, role):
    def put(s):
        return s.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")

    def back(s):
        return s.replace("\\h", "#").replace("\\l", "<").replace("\\b", "\\")

    assert back(put(text)) == text and "</turn>" not in put(text)


def test_windows_keep_the_system_turn_and_target_once(spark):
    rows = [(1, 0, "system", "rules")] + [(1, k, "user" if k % 2 else "assistant", f"turn {k} " * 40) for k in range(1, 40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.windows(frame).orderBy("window").collect()
    assert len(got) > 3 and all(r["formatted"].startswith("### system:\nrules") for r in got)
    assert sum(len(r["mask"]) for r in got) == sum(r[2] == "assistant" for r in rows)
    assert sum(r["formatted"].count("### user") for r in got) > 20  # history is repeated


def test_interleaving(spark):
    from pyspark.sql import functions as F

    digest = "a" * 64
    html = f"<p>one</p><figure><img src='sha256:{digest}' alt='x'><figcaption>cap &amp; more</figcaption></figure><p>two<script>no</script>"
    got = media.sequence(html)
    assert [(i["position"], i["kind"], i["text"], i["caption"]) for i in got] == [(0, "text", "one", None), (1, "media", None, "cap & more"), (2, "text", "two", None)]
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<img src='sha256:zz'>")], "page_id long, html string")
    known = spark.createDataFrame([(digest, 5)], "digest string, size int")
    rows = media.interleave(pages, "page_id", F.col("html"), known).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["size"]) for r in rows] == [(1, 0, None), (1, 1, 5), (1, 2, None), (3, 0, None)]


def test_cascade_is_exact(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false positives, so several levels
    monkeypatch.setattr(urls, "LEAST_BITS", 64)
    monkeypatch.setattr(urls, "SHARD_KEYS", 150)
    rows = spark.range(3000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("want"))
    got = urls.mark_listed(rows, "key", rows, rows.where("want"))
    assert got.where("listed <> want").count() == 0


def test_needed_words_lose_no_licence():
    for _, text in licenses.TEMPLATES:
        grams, sets = licenses.bigrams_of(text), licenses.needed(text)
        assert sets and len({w for s in sets for w in s}) == sum(map(len, sets))
        for words in sets:
            left = [g for g in grams if not {*g.split(" ")} & {*words}]
            assert 2 * len(left) < licenses.THRESHOLD * (len(left) + len(grams))


def test_short_creative_commons_lines_and_the_whole_mit_paragraph_are_met(spark):
    mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    texts = ["Some prose.\nLicensed under CC BY-NC 4.0.\nMore.", "Licensed under CC BY-SA 4.0.", "Copyright (c) 2020 X\n\n" + mit.replace("including", "\nincluding").replace("publish,", "\npublish,") + "\n\nThe end."]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(0, "CC-BY-NC-4.0"), (1, "CC-BY-SA-4.0"), (2, "MIT")]
