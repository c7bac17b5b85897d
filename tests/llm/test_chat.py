"""Windows of the chat operator: budget, history and targets, against plain Python."""

import random

import pytest

from tessera.llm import chat


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def check(got, rows, budget, history, count):
    """Every window within the budget, its new turns consecutive, its history the turns right before them."""
    ends = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        ends.setdefault(r[0], []).append((r[2], count(r[2], r[3])))
    new = {}
    for w in sorted(got, key=lambda w: (w.conv_id, w.window)):
        own = ends[w.conv_id]
        pieces = [p for p in w.formatted.split("</turn>\n") if p]
        fresh = [p for p, n in zip(pieces, w.is_new) if n]
        roles = [p.split(":\n", 1)[0].removeprefix("### ") for p in pieces]
        assert sum(r == "system" for r in roles) == sum(r == "system" for r, _ in own)
        places = [p for p in w.places if own[p - 1][0] != "system"]
        plain = [k + 1 for k, (r, _) in enumerate(own) if r != "system"]
        assert places == plain[plain.index(places[0]) : plain.index(places[-1]) + 1] and len(fresh) == len(w.places)
        head = sum(n for r, n in own if r == "system")
        assert w.n_tokens <= budget or (len(places) == 1 and head + own[places[0] - 1][1] == w.n_tokens > budget)
        repeated = len(pieces) - len(places) - sum(r == "system" for r in roles)
        before = [own[k - 1] for k in plain[: plain.index(places[0])]]
        assert sum(n for _, n in before[len(before) - repeated :]) <= history
        new.setdefault(w.conv_id, []).extend(w.places)
        masked = sum(r == "assistant" for p, r, n in zip(pieces, roles, w.is_new) if n)
        assert len(w.mask) == masked
        for m in w.mask:
            assert w.formatted[m.start + m.length :].startswith("</turn>") and w.formatted[: m.start].endswith("### assistant:\n")
    assert all(sorted(p) == list(range(1, len(ends[c]) + 1)) for c, p in new.items()) and new.keys() == ends.keys()


@pytest.mark.parametrize("budget,history", [(512, 96), (60, 20), (30, 0), (200, 150)])
def test_windows_keep_the_budget(spark, budget, history):
    rng = random.Random(budget)
    rows = []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " * rng.randrange(1, 8)))
        n = rng.choice([1, 2, 5, 40, 700 if c == 4 else 9])
        rows += [(c, k + 1, ("user", "assistant")[k % 2], "word " * rng.choice([1, 3, 8, 20, 60, 300])) for k in range(n)]
        if c % 7 == 0:
            rows.append((c, 900, "system", "and brief"))
    rows.append((99, 0, "system", "alone"))
    got = [w for w in chat.windows(turns_of(spark, rows), budget, history).collect() if w.conv_id != 99]
    import regex

    count = lambda role, text: len(regex.findall(chat.TOKEN, f"### {role}:\n{chat_escape(text)}</turn>\n"))
    check(got, [r for r in rows if r[0] != 99], budget, history, count)


def chat_escape(text):
    return text.replace("\\", "\\b").replace("<", "\\l").replace("#", "\\h")


def test_counts_given_by_the_caller(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(600)]
    docs = turns_of(spark, rows).selectExpr("*", "1 + turn % 50 AS n")
    got = chat.windows(docs, 100, 30, tokens="n").collect()
    check(got, rows, 100, 30, lambda role, text: 1 + int(text[1:]) % 50)


def test_budget_of_the_supplied_conversations(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    got = chat.windows(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).collect()
    over = [w for w in got if w.n_tokens > chat.BUDGET]
    assert len(got) > 1000 and all(len([p for p in w.formatted.split("</turn>\n") if p and not p.startswith("### system")]) == 1 for w in over)
    real = [len(e.ids) for e in coder.encode_batch([w.formatted for w in got], add_special_tokens=False)]
    assert not any(n > chat.BUDGET for n, w in zip(real, got) if w.n_tokens <= chat.BUDGET)
