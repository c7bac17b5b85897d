"""Decontamination against plain edit distance, on random and on repetitive texts."""

import random
import time

import pytest

from tessera.llm import decontam


def least_edits(item, doc):
    """(edits, end) of ``item`` against any part of ``doc`` by the plain table."""
    row = [0] * (len(doc) + 1)
    for i, ch in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(doc, 1):
            new.append(min(row[j - 1] + (ch != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min((v, j) for j, v in enumerate(row))


def whole_edits(a, b):
    row = list(range(len(b) + 1))
    for i, ch in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (ch != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def check(items, text):
    index, raw = decontam.build(list(enumerate(items))), decontam.normalise(text)
    got = decontam.matches(index, raw)
    for i, item in zip(index.ids, index.items):
        own, k = index.ids.index(i), int(decontam.EDIT_SHARE * len(item) + 1e-9)
        best = least_edits(item, raw)[0]
        assert (own in got) == (best <= k), (item, best, k)
        if own in got:
            edits, a, b = got[own]
            assert best <= edits <= k and whole_edits(item, raw[a:b]) == edits
    assert bool(decontam.matches(index, raw, any_one=True)) == bool(got)
    return got


@pytest.mark.parametrize("seed", range(12))
def test_against_edit_distance(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 3 == 1:
        monkeypatch.setattr(decontam, "PAIRS", 50)
        monkeypatch.setattr(decontam, "MOST_POSTINGS", 3)
    if seed % 3 == 2:
        monkeypatch.setattr(decontam, "SLICE", 200)
    letters = "ab" if seed % 2 else "abcdefghij"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(2, 7)))
    items = [" ".join(word() for _ in range(rng.randrange(8, 20))) for _ in range(6)]
    items += [items[0][:-6] + word(), "a" * 40, "ab" * 30]
    parts = []
    for item in items:
        held = list(item)
        for _ in range(rng.randrange(0, int(0.12 * len(item)))):
            at = rng.randrange(len(held))
            held[at] = rng.choice(["", "x", held[at] + "y"])
        parts += [word() for _ in range(rng.randrange(5, 30))] + ["".join(held)] * rng.choice([1, 1, 4])
    check(items, " ".join(parts))


def test_runs_and_templates():
    base = "every unit of this form is the same but for one word in the middle of it and so on"
    items = [base.replace("middle", w) for w in ("start", "centre", "endless")] + ["z" * 60]
    check(items, (base + ". ") * 30 + "z" * 500)


def test_a_template_of_one_megabyte_takes_seconds():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(2000)]
    base = words[:40]
    items = [" ".join(base[: i % 40] + [words[100 + i]] + base[i % 40 + 1 :]) for i in range(200)]
    began = time.perf_counter()
    index = decontam.build(list(enumerate(items)))
    assert len(decontam.matches(index, decontam.normalise((" ".join(base) + ". ") * 4000))) == 200
    assert time.perf_counter() - began < 60


def test_short_items_are_found_between_word_ends():
    index = decontam.build([(7, "The Red fox!"), (8, "ox"), (9, "...")])
    assert {index.ids[k] for k in decontam.matches(index, decontam.normalise("see the red, fox run"))} == {7}
    assert {index.ids[k]: v for k, v in decontam.matches(index, decontam.normalise("an ox")).items()} == {8: (0, 3, 5)}
    assert decontam.matches(index, decontam.normalise("the red foxes boxed")) == {}


def test_letters_beyond_ascii_stay_whole():
    assert decontam.normalise("Voilà, ŠÅ!").decode() == "voilà šå"
    assert decontam.normalise("a  b").decode() == "a b"
    for text in ("Voilà àİx . b", "  Å  b!"):
        assert len(decontam.places(text)) == len(decontam.normalise(text))


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x " * 50 + "one two three four five six seven eight nine ten"), (None, "nothing"), (3, None), (1, "twelve monkeys went up the hill to fetch some water, twice")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "twelve monkeys went up the hill to fetch some water"), (3, None), (4, "nothing")], "item_id long, text string")
    rows = lambda: sorted((r.doc_id or 0, r.item_id, r.start, r.end, r.edits) for r in decontam.find_leaks(docs, items).collect())
    one = rows()
    assert one == [(0, 4, 0, 7, 0), (1, 1, 100, 148, 0), (1, 2, 0, 51, 0)]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)
    assert rows() == one
    assert [r.doc_id for r in decontam.remove_leaky(docs, items).collect()] == [3]
