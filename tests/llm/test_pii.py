"""The skip-chain field: planted repeats found again, look-alikes left alone, trained from supplied texts."""

import random

import duckdb
import pytest

from tessera.llm import pii


@pytest.fixture(scope="module")
def field():
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE regexp_matches(text, '[0-9]') AND length(text) <= 20000 ORDER BY hash(text) LIMIT 2000").fetchall()]
    return pii.fit(texts)


def planted(n):
    """(text, the places of items written again, whether the item itself stands elsewhere in the text)"""
    rng = random.Random(n)
    word = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randrange(2, 9)))
    fill = lambda: " ".join(word() for _ in range(rng.randrange(3, 25)))
    for k in range(n):
        number = "".join(rng.choices("123456789", k=9))
        card = "4" + "".join(rng.choices("0123456789", k=14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        name = f"{word()}.{word()}{rng.randrange(10, 99)}x"
        slip = card[:-2] + str((int(card[-2]) + 5) % 10) + card[-1]
        item, again = [(f"+49 {number}", number), (card, slip), (f"{name}@mail.example.org", name), (f"{name}@mail.example.org", f"@{name}"), (f"{name}@mail.example.org", name.replace(".", ""))][k % 5]
        other = k % 2 == 1
        shown = item if not other else f"{word()}.{word()}{rng.randrange(10, 99)}y@mail.example.org"
        yield f"{fill()} {shown} {fill()} {again}, {fill()} {rng.randrange(1, 99)} {fill()}", again, not other


def test_precision_and_recall_on_planted_repeats(field):
    assert field.skip > 1 and field.similar > 0.5
    caught = missed = false = clean = 0
    for text, again, there in planted(400):
        added = [text[a:b] for _, a, b, base in pii.all_spans(field, text) if not base]
        hit = again in added
        if there:
            caught, missed = caught + hit, missed + (not hit)
        else:
            false, clean = false + hit, clean + (not hit)
        assert not {*added} - {again}
    assert caught / (caught + missed) > 0.95 and false / (false + clean) < 0.05


def test_supplied_texts_are_left_alone(field):
    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    added = sum(not base for t in texts for *_, base in pii.all_spans(field, t))
    assert added <= 0.05 * len(texts)


def test_plain_words_are_no_names():
    assert pii.names_of("contact@x.org", pii.base_spans("contact@x.org")) == set()
    assert pii.names_of("j.doe@x.org", pii.base_spans("j.doe@x.org")) == {"j.doe"}


def test_skip_edges():
    same, similar = pii.skip_edges(["123456789", "123456780", "123456789", "987654321"])
    assert same == [(0, 2)] and similar == [(0, 1)]


def test_user_names_without_digits_share_their_label(field):
    text = "write to Alice.Jones@x.org; then alice.jones, or @alice.jones. 42 apples"
    assert [(text[a:b], base) for _, a, b, base in pii.all_spans(field, text)] == [("Alice.Jones@x.org", True), ("alice.jones", False), ("@alice.jones", False)]
    assert pii.key("@alice99") == pii.key("alice99@x.org") == "alice99"
