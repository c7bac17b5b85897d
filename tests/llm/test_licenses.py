"""Whole licence texts in the forms in which files hold them, and the scan against plain Python and SQL on a fixture."""

import textwrap

import duckdb
import pytest

from tessera.llm import licenses
from tessera.llm.license_texts import TEMPLATES

LONG = [(k, name, text) for k, (name, text) in enumerate(TEMPLATES) if len(text.split()) > 25]


def forms(text):
    wrapped = textwrap.wrap(text, 70)
    yield text
    yield "Copyright (c) 2020 Someone\n\n" + "\n".join(wrapped) + "\n\nmore text follows here"
    yield "int a;\n" + "\n".join(f" * {line}" for line in wrapped) + "\n */\nint b;"
    yield "# head\n" + "\n".join(f"# {line}" for line in wrapped) + "\nand a line of the same paragraph"
    yield f"Some words come first. {text} And others come behind it."
    yield text.upper()


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k * 100 + j, form) for k, _, text in LONG for j, form in enumerate(forms(text))]
    rows += [(-1, None), (-2, ""), (-3, "the license of the software is provided under terms"), (None, "Released under the MIT License."), (-4, "Released under the MIT License.\nReleased under the  MIT License!"), (-4, "Released under the MIT License.\nReleased under the  MIT License!")]
    rows += [(-5, " ".join(LONG[0][2].split()[::-1])), (-6, "license " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS t", "2 AS own").repartition(8)
    return docs, licenses.scan(docs).toPandas()


def test_long_texts_are_found_in_every_form(found):
    got = {(r.doc_id, r.license) for r in found[1].itertuples()}
    missed = [(k, name, j) for k, name, text in LONG for j in range(6) if (k * 100 + j, name) not in got]
    assert not missed
    assert not {i for i, _ in got if i in (-1, -2, -3, -5, -6)}
    assert len(found[1][found[1].doc_id == -4]) == 2 and found[1].doc_id.isna().sum() == 1


def test_scan_equals_sql_and_plain_python(found, same):
    docs, got = found
    con = duckdb.connect()
    frame = docs.select("doc_id", "text").toPandas()
    con.register("documents", frame)
    same(got, con.execute(licenses.ORACLE).df())
    for r in frame[(frame.doc_id % 7 == 0) & (frame.doc_id < 5000)].itertuples():
        best = {}
        for segment, size in segments(r.text):
            own = set(licenses.bigrams_of(segment))
            for name, text in TEMPLATES:
                want = set(licenses.bigrams_of(text))
                if own and size in (0, len(licenses.words_of(text))):
                    dice = 2 * len(own & want) / (len(own) + len(want))
                    if dice >= licenses.THRESHOLD:
                        best[name] = max(dice, best.get(name, 0))
        assert {x.license: round(x.dice, 9) for x in got[got.doc_id == r.doc_id].itertuples()} == {k: round(v, 9) for k, v in best.items()}


def segments(text):
    """(segment, 0) of lines, sentences and paragraphs, (window, words of its template) of windows."""
    import re

    pieces = re.sub(r"([.!?]) +", r"\1\n", text).split("\n")
    yield from ((x, 0) for x in [*text.split("\n"), *pieces, *re.split(r"\n\n+", text)])
    split = [w for p in pieces if (w := [x for x in licenses.words_of(p) if x])]
    words, starts = [w for p in split for w in p], [sum(map(len, split[:k])) for k in range(len(split))]
    for n in {len(licenses.words_of(t)) for _, t in TEMPLATES}:
        yield from ((" ".join(words[a : a + n]), n) for a in starts)
