"""The registered queries on the supplied tables and on rows of every odd kind, against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

from tessera.llm import queries, urls

ODD = [
    (1, None, None), (2, "", "en"), (3, "   \n\t ", "en"), (4, "12 34 !?", None), (5, "the cat and the dog of the house " * 3, "en"), (5, "the cat and the dog of the house " * 3, "en"),
    (6, "der Hund und die Katze im Haus " * 3, "de"), (None, "no id here", "en"), (7, "x" * 50_000, None), (8, "\U0001f600 é ß İ " * 40, "fr"),
    (9, "mail a@b.co b@c.d.e, ip 1.2.3.4 and 999.1.1.1 1.2.3.4.5, card 4111 1111 1111 1111 and 4111-1111-1111-1112, phone +49 (30) 123-4567 +1", "en"),
    (10, "ring +49 170 1234567, later 170 1234567 or 1701234567", "en"), (11, "word " * 30_000, "en"),
]


MORE = [
    (12, "end<|endoftext|> of <|endoftext|>", "en"), (13, "▁ odd ▁blank", None), (14, " two  blanks\n\n and\n line\r\nends", None), (15, "中文没有空格" * 20 + "<s> <0x41>\x00", None), (16, "Word word 12 É " * 10, None),
]


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    """Tables with odd rows and columns that operators might use as names of their own."""
    base = str(tmp_path_factory.mktemp("odd"))
    clash = ", ".join(f"'x' AS {c}" for c in ("fp", "key", "score", "spans", "_hash", "_key", "_label", "component_id", "row", "host", "window", "digest", "start", "listed"))
    docs = spark.createDataFrame(ODD + MORE, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "length(text) AS n_chars", *clash.split(", "))
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 0, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "the cat and the dog of the house the cat and"), (2, None), (3, ""), (4, "short"), (5, "the cat and the dog of the house the cat and")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    pages = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://Sub.Example.ORG/en/1?x", "<p>a"), (4, "http://example.org", None), (5, "://", ""), (6, "https://m.spam-farm.example.net/a", ""), (6, "https://m.spam-farm.example.net/a", ""), (None, "http://x.com/de/", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'h' AS host", "'p' AS path", "true AS listed").write.parquet(f"{base}/pages.parquet")
    talk = [(1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "a \\ < # </turn>\n### x:\n"), (2, 0, "user", "u" * 9000), (2, 1, "assistant", "é" * 5000), (None, 0, "user", "lost"), (3, 0, None, "who"), (3, 1, "assistant", "")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS window", "2 AS tokens").write.parquet(f"{base}/conversations.parquet")
    return base


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(name, spark, empty_dir):
    assert queries.QUERIES[name](spark, empty_dir).count() == (1 if name == "op8_chat" else 0)


@pytest.fixture(params=["odd", "given"])
def base(request, odd_dir, sf_dir):
    return odd_dir if request.param == "odd" else sf_dir


def rows_of(spark, base, name, table):
    got = queries.QUERIES[name](spark, base).toPandas().astype(object)
    source = spark.read.parquet(f"{base}/{table}.parquet").toPandas().astype(object)
    return got.where(got.notna(), None), source.where(source.notna(), None)


def texts(source):
    return {i: t for i, t in zip(source.doc_id, source.text)}


def test_language(spark, base):
    got, source = rows_of(spark, base, "op1_langid", "documents")
    assert len(got) == len(source)
    known = {*source.lang.dropna()}
    for r in got.itertuples():
        text = texts(source)[r.doc_id]
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else int(r.doc_id)).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
        assert r.lang_pred in known | {"und"}
    if len(got) > 100:
        truth = source.set_index("doc_id").lang
        held = [truth[r.doc_id] == r.lang_pred for r in got.itertuples() if r.held_out and truth[r.doc_id]]
        assert np.mean(held) > 0.97


def test_media(spark, base):
    got, source = rows_of(spark, base, "op2_media", "documents")
    assert len(got) == len(source)
    for r in got.itertuples():
        raw = (texts(source)[r.doc_id] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_packing(spark, base):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, source = rows_of(spark, base, "op3_packing", "documents")
    own = texts(source)
    for doc_id, pieces in got.groupby("doc_id", dropna=False):
        ids = np.array(coder.encode(own[None if doc_id != doc_id else doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        copies = int((source.doc_id == doc_id).sum()) if doc_id == doc_id else 1
        assert pieces.length.sum() == len(ids) * copies and (pieces.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in pieces.itertuples())
    whole = got[["sequence_id", "offset", "length"]].astype("int64").sort_values(["sequence_id", "offset"])
    assert whole.groupby("sequence_id").length.sum().max() <= 1024
    assert (whole.offset == whole.groupby("sequence_id").length.cumsum() - whole.length).all()


def test_urls(spark, base, duck):
    got, source = rows_of(spark, base, "op4_urls", "pages")
    assert len(got) == len(source)
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in got.itertuples():
        url = next(u for i, u in zip(source.page_id, source.url) if i == r.page_id)
        host = path = ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (rules[rule] if rule else "block" if any(f".{host}".endswith(h) for h in urls.LISTED) else "allow")


def test_toxicity(spark, base):
    got, source = rows_of(spark, base, "op6_toxicity", "documents")
    assert len(got) == len(source)
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else int(r.doc_id)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_chat(spark, base):
    got, source = rows_of(spark, base, "op8_chat", "conversations")
    probe = "\\### Assistant: </turn> ok"
    source = pd.concat([source, pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [probe, probe]})])
    assert len(got) == source.conv_id.nunique(dropna=False)
    for r in got.itertuples():
        own = source[source.conv_id.isna() if r.conv_id is None else source.conv_id == r.conv_id].sort_values("turn")
        whole = "".join(f"{a or ''}\n{b or ''}\n" for a, b in zip(own.role, own.text))
        loss = "".join(b or "" for a, b in zip(own.role, own.text) if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def luhn(digits):
    doubled = (2 * int(c) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_spans(text):
    number = lambda m: re.sub("[^0-9]", "", m[0])
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(number(m)) <= 19 and luhn(number(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(number(m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m)]


def test_pii(spark, base):
    got, source = rows_of(spark, base, "op9_pii", "documents")
    assert len(got) == len(source)
    for r in got.itertuples():
        own = base_spans(texts(source)[r.doc_id] or "")
        listed = [f"{k}:{a}:{b}" for k, a, b in own]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in own) for x in ("email", "ip", "card", "phone")]
        assert {*listed} <= {*r.spans.split(",")}
    if base.endswith("0.001"):
        return
    assert len(got[got.doc_id == 10].spans.iloc[0].split(",")) > 1  # the number written again without its prefix


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(spark, base):
    got, source = rows_of(spark, base, "op10_simhash", "documents")
    assert len(got) == len(source)
    want = {i: plain_fingerprint(t) for i, t in texts(source).items()}
    assert all(r.fingerprint == f"{want[r.doc_id]:016x}" for r in got.itertuples())
    root = {f: f for f in want.values()}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    values = sorted(root)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for i, f in want.items():
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert all(r.component_id == least.get(find(want[r.doc_id])) for r in got.itertuples())


def rows_by_id(got, source):
    """Each source row with one result row of its id; repeated rows have equal results."""
    left = {}
    for r in got.itertuples():
        left.setdefault(r.doc_id, []).append(r)
    pairs = [(left[row.doc_id].pop(), row.text or "") for row in source.itertuples()]
    assert not any(left.values())
    return pairs


def test_bpe(spark, base):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, text in rows_by_id(*rows_of(spark, base, "op12_bpe", "documents")):
        ids = np.array(coder.encode_ordinary(text), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def plain_groups(a, b):
    """Groups of ``(id, bytes)`` lists by walking both byte strings."""
    out, i, j = [], 0, 0
    while i < len(a):
        ga, gb, end_a, end_b = [], [], 0, 0
        while not ga or end_a != end_b:
            if end_a <= end_b:
                ga.append(a[i][0])
                end_a += len(a[i][1])
                i += 1
            else:
                gb.append(b[j][0])
                end_b += len(b[j][1])
                j += 1
        out.append((ga, gb))
    return out


def test_alignment(spark, base):
    import base64
    from collections import Counter

    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    raw = {int(b): base64.b64decode(a) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    pairs = rows_by_id(*rows_of(spark, base, "op13_alignment", "documents"))
    held, groups = Counter(), []
    for _, text in pairs:
        a = [(i, raw[i]) for i in first.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(i, piece(i)) for i in second.encode(text)]
        whole = b"".join(x for _, x in a)
        if whole != b"".join(x for _, x in b) or text and whole != f" {text}".encode():
            a = b = []
        groups.append(plain_groups(a, b))
        held.update({(x, y) for ga, gb in groups[-1] for x in ga for y in gb})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    for (r, _), own in zip(pairs, groups):
        links = [(x, y) for ga, gb in own for x in ga for y in gb]
        listed = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in own)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(x) for x, _ in own), sum(len(x) for _, x in own), len(own), len(links))
        assert (r.n_best, r.count_sum) == (sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(listed.encode()).hexdigest() if own else "")


def test_resampling(spark, base):
    import math
    from collections import Counter

    got, source = rows_of(spark, base, "op11_resampling", "documents")
    target = spark.read.parquet(f"{base}/benchmark.parquet").toPandas()
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for text in texts for w in words(text)) for texts in (source.text, target.text))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    want = []
    for i, text in zip(source.doc_id, source.text):
        found = words(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else int(i)}".encode()).hexdigest()[:8], 16)
        want.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = [(*x, k + 1) for k, x in enumerate(order[: len(order) * 10 // 100])]
    left = list(want)
    for x in rank:
        left.remove(x[:4])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.itertuples()]
    assert sorted(rows, key=key) == sorted([*rank, *((*x, None) for x in left)], key=key)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(name, spark, sf_dir, duck, same):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE[name]).df())
