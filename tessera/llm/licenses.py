"""Licence notices and texts found by the Dice coefficient over word bigrams, on DataFrame functions alone.

A document is compared in segments: its lines, its sentences, its paragraphs, and for each template the windows of as many
words as the template has, from the beginning of each line and sentence on; so a text is found whether it stands on one
line, is wrapped, or follows comment marks, which are blanks in the comparison. A segment's size bounds its best
coefficient, so only sizes that can reach the threshold are compared.

Before any segment is cut, the words of the whole text that stand in any template are taken out of it, and of each
template some must be there: a set of words without whose bigrams the rest
is too little to reach the threshold must be met by one word at least, and so must each of several such sets without
a common word. A text that fails one of them cannot be near, so this loses nothing; a long template is only compared
to texts that hold much of it, however many templates there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.license_texts import TEMPLATES

THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9.]+", " ", text.lower()).replace(". ", " ").strip(" .").split(" ")


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def needed(text: str, threshold: float = THRESHOLD) -> list[list[str]]:
    """Sets of words without a common one; a text without any word of one of them cannot reach the threshold."""
    grams = bigrams_of(text)
    left = sorted({*words_of(text)}, key=lambda w: (-len(w), w))
    sets = []
    while True:
        rest, chosen = grams, []
        for word in left:
            if 2 * len(rest) < threshold * (len(rest) + len(grams)):
                break
            chosen.append(word)
            rest = [g for g in rest if word not in g.split(" ")]
        if 2 * len(rest) >= threshold * (len(rest) + len(grams)):
            return sets
        sets.append(chosen)
        left = [w for w in left if w not in chosen]


def normalise(c: Column) -> Column:
    return F.btrim(F.replace(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", " "), F.lit(". "), F.lit(" ")), F.lit(" ."))


def words_in(text: Column, threshold: float = THRESHOLD) -> Column:
    """The different words of a text that some template needs. Dots at the edges of a word are left out, as template words have none."""
    known = sorted({w for _, t in TEMPLATES for words in needed(t, threshold) for w in words})
    whole = F.regexp_replace(F.lower(text), "[^a-z0-9.]+|[.]+(?![a-z0-9])|(?<![a-z0-9])[.]+", " ")
    return F.array_intersect(F.split(whole, " +"), F.array(*map(F.lit, known)))


def candidates(words: Column, threshold: float = THRESHOLD) -> Column:
    """Places (from 1) in ``TEMPLATES`` of those that a text with these words may hold."""
    found = []
    for k, (_, template) in enumerate(TEMPLATES, 1):
        near = F.lit(True)
        for one_of in needed(template, threshold):
            near = near & F.arrays_overlap(words, F.array(*map(F.lit, one_of)))
        found.append(F.when(near, F.lit(k)))
    return F.array_compact(F.array(*found))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, license, dice, n_segments``: per row and licence met, the best coefficient and how many different segments
    (as sets of bigrams) reach the threshold.

    Null or empty texts meet nothing; repeated rows are reported each (with equal values); a null id is reported as null.
    Other columns are not looked at.
    """
    # a generator of one row: the words are computed once, not again in the filter behind it
    held = docs.select("doc_id", "text", F.inline_outer(F.array(F.struct(words_in(F.col("text"), threshold).alias("words")))))
    held = held.where(F.size("words") >= min(len(needed(t, threshold)) for _, t in TEMPLATES))
    kept = held.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), candidates(F.col("words"), threshold).alias("near"))
    grams_of = F.array(*(F.array(*map(F.lit, bigrams_of(t))) for _, t in TEMPLATES))
    names = F.array(*(F.lit(n) for n, _ in TEMPLATES))
    sizes = F.array(*(F.lit(len(words_of(t))) for _, t in TEMPLATES))
    pairs = kept.select("row", "doc_id", "text", F.explode_outer("near").alias("t")).where("t is not null")  # an outer one, so that no filter repeats what it explodes
    pieces = F.split(F.regexp_replace("text", "([.!?]) +", "$1\n"), "\n")
    whole = F.concat(F.lit("\n"), F.array_join(F.filter(F.transform(pieces, normalise), lambda p: p != ""), "\n"))
    window = F.concat(F.lit("\\n(?=((?:[^ \\n]+[ \\n]){0,"), (F.element_at(sizes, F.col("t")) - 1).cast("string"), F.lit("}[^ \\n]+))"))
    windows = F.transform(F.regexp_extract_all(whole, window, F.lit(1)), lambda w: F.replace(w, F.lit("\n"), F.lit(" ")))
    parts = F.array_union(F.array_union(F.split("text", "\n"), pieces), F.split("text", "\n\n+"))
    segments = F.array_union(F.transform(parts, normalise), windows)
    lines = pairs.select("row", "doc_id", "t", F.explode_outer(segments).alias("line"))
    words = F.split("line", " ")
    next_to = F.greatest(F.size("words") - 1, F.lit(0))
    grams = F.array_distinct(F.zip_with(F.slice("words", F.lit(1), next_to), F.slice("words", F.lit(2), next_to), lambda a, b: F.concat_ws(" ", a, b)))
    n, own = F.size("grams"), F.size("own")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    count = F.size(F.element_at(grams_of, F.col("t")))
    long = F.size(words).between(count * low, count * high * 4 + 8)  # repeated words make fewer bigrams, never more
    lines = lines.where(long).select("row", "doc_id", "t", words.alias("words")).where(F.size("words") > 1)
    own_grams = F.element_at(grams_of, F.col("t")).alias("own")
    lines = lines.select("row", "doc_id", "t", F.inline_outer(F.array(F.struct(grams.alias("grams"), own_grams))))
    met = lines.where(n.between(own * low, own * high)).withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "own")) / (n + own)).where(F.col("dice") >= threshold)
    return (
        met.groupBy("row", "doc_id", F.element_at(names, F.col("t")).alias("license"))
        .agg(F.max("dice").alias("dice"), F.count_distinct("grams").alias("n_segments")).drop("row")
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"('{name}', {len(words_of(text))}, [{', '.join(repr(g) for g in bigrams_of(text))}])" for name, text in TEMPLATES)
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    clean = lambda x: f"trim(replace(regexp_replace(lower({x}), '[^a-z0-9.]+', ' ', 'g'), '. ', ' '), ' .')"
    common = sorted({w for _, t in TEMPLATES for w in needed(t)[0]}, key=len)
    common = [w for w in common if not any(o != w and o in w for o in common)]
    return rf"""
WITH templates(license, n_words, own) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents WHERE regexp_matches(lower(text), '{"|".join(re.escape(w) for w in common)}')),
cut AS (SELECT row_id, doc_id, text, string_split(regexp_replace(text, '([.!?]) +', '' || chr(10), 'g'), chr(10)) AS pieces FROM docs),
segments AS (SELECT row_id, doc_id, unnest(list_concat(list_concat(string_split(text, chr(10)), pieces), string_split_regex(text, '

+'))) AS part FROM cut),
numbered AS (SELECT row_id, doc_id, place, string_split(line, ' ') AS w FROM (
  SELECT row_id, doc_id, place, {clean("part")} AS line FROM (SELECT row_id, doc_id, unnest(pieces) AS part, generate_subscripts(pieces, 1) AS place FROM cut)) WHERE line <> ''),
starts AS (SELECT row_id, doc_id, coalesce(sum(len(w)) OVER (PARTITION BY row_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM numbered),
whole AS (SELECT row_id, flatten(list(w ORDER BY place)) AS w FROM numbered GROUP BY row_id),
windows AS (SELECT DISTINCT row_id, doc_id, license, own, list_slice(w, CAST(start AS BIGINT) + 1, CAST(start AS BIGINT) + n_words) AS w
  FROM starts JOIN whole USING (row_id), templates),
lines AS (SELECT DISTINCT row_id, doc_id, {clean("part")} AS line FROM segments),
every AS (
  SELECT row_id, doc_id, license, own, string_split(line, ' ') AS w FROM lines, templates
  WHERE contains(line, ' ') AND len(string_split(line, ' ')) BETWEEN len(own) * {low} AND len(own) * {high} * 4 + 8
  UNION ALL SELECT row_id, doc_id, license, own, w FROM windows WHERE len(w) > 1 AND len(w) >= len(own) * {low}
), grams AS (SELECT row_id, doc_id, license, own, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM every
), met AS (SELECT row_id, doc_id, license, g, 2.0::DOUBLE * len(list_intersect(g, own)) / (len(g) + len(own)) AS dice FROM grams
  WHERE len(g) BETWEEN len(own) * {low} AND len(own) * {high})
SELECT doc_id, license, max(dice) AS dice, count(DISTINCT list_sort(g)) AS n_segments FROM met WHERE dice >= {THRESHOLD} GROUP BY row_id, doc_id, license
"""


ORACLE = _sql()
