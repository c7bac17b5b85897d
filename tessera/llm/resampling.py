"""Importance resampling towards a target distribution, by hashed n-gram features.

Texts become sequences of word ids, block by block in each partition. The suffixes of a block's sequence are put in order
(prefix doubling, as deep as the longest n-gram; a suffix ends with its text), and the lengths of the common prefixes of
neighbours are taken. For each n, a run of neighbours that share n words is all occurrences of one n-gram: it is hashed
once, and its bucket is written back to the places where its suffixes begin. Counts of buckets, in the corpus and in the
target texts, give each bucket a gain; a text's weight is the sum over its features. A draw without replacement takes
the highest sums of weight and Gumbel noise, the noise from a hash of the id, so that it is the same on every run.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import slices
from tessera.llm.common import free_name, table, written
from tessera.operators.ranking import numbered

BUCKETS = 10_000
BLOCK_BYTES = 4 << 20
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes of words stay (A-Z lower-cased, digits, all beyond ASCII), others become blanks.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def suffix_order(words: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, compared by at most ``depth`` words (up to the next power of two). ``left``: how many words of its text
    are left at each place; a suffix that has ended comes first."""
    rank, step = words + 1, 1
    while step < depth:
        behind = np.zeros_like(rank)
        behind[:-step] = rank[step:]
        behind[left <= step] = 0
        rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + behind, return_inverse=True)[1] + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(words: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many words (at most ``depth``) each suffix shares with the one before it in the order; 0 for the first."""
    shared = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    alive = np.ones(len(b), bool)
    for k in range(depth):
        alive = alive & (left[a] > k) & (left[b] > k)
        alive[alive] = words[a[alive] + k] == words[b[alive] + k]
        shared[1:] += alive
    return shared


def features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and bucket of every feature (n-grams of 1 to ``longest`` words), and the words of each text."""
    split = [words_of(text) for text in texts]
    n_words = np.array([len(x) for x in split], np.int64)
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for x in split for w in x], np.int64)
    names = list(known)
    text = np.repeat(np.arange(len(texts)), n_words)
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(words))
    order = suffix_order(words, left, longest)
    shared = common_prefixes(words, left, order, longest)
    out_text, out_bucket = [], []
    for n in range(1, longest + 1):
        long_enough = left[order] >= n
        places = order[long_enough]
        first = shared[long_enough] < n  # where the run of an n-gram begins
        heads = places[first]
        hashed = np.array([zlib.crc32(b" ".join([names[i] for i in gram])) % buckets for gram in words[heads[:, None] + np.arange(n)].tolist()], np.int64)
        bucket = np.empty(len(words), np.int64)
        bucket[places] = hashed[np.cumsum(first) - 1]
        kept = left >= n
        out_text.append(text[kept])
        out_bucket.append(bucket[kept])
    return np.concatenate(out_text), np.concatenate(out_bucket), n_words


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts in each bucket that has any; each task hands on at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, 0, BLOCK_BYTES):
            total += np.bincount(features(part.column(0).to_pylist(), longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths, from two tables of counts of ``buckets`` rows at most (the driver's bound)."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, counts in ((s, source), (t, target)):
        for r in counts.collect():
            held[r["bucket"]] = r["n"]
    all_s, all_t = int(s.sum()) + buckets, int(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((x + 1) * all_s / ((y + 1) * all_t))) for x, y in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: str) -> int:
    """Gumbel noise of an id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_words, n_features, weight, score`` of every row; without words the weight is 0. A null id counts as the empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2, BLOCK_BYTES):
            text, bucket, n_words = features(part.column(2).to_pylist(), longest, len(gain))
            n = np.bincount(text, minlength=part.num_rows)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, text, gain[bucket])
            score = weight + np.array([noise(seed, i or "") for i in part.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight, score))], [id_col, "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_features long, weight long, score long")


def ranked(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """``<id_col>, n_words, n_features, weight, score, rank`` of every row: of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded
    down) are drawn, those with the highest scores, ties to the smaller id (null ids first); their ``rank`` counts from 1,
    the others' is null.

    Null and empty texts have no features and are never drawn; without target texts, or with empty ones, the gains follow from the smoothed
    counts alone. Every row stands for itself, also repeated rows, whose order among themselves does not show; an empty
    table gives none. Other columns are not looked at. Ranks come from ranges of the order, so no task sees more than its range.
    """
    gain = gains(bucket_counts(docs, longest, buckets, text_col), bucket_counts(target, longest, buckets, target_text), buckets)
    scored, _ = written(weigh(docs, gain, longest, seed, id_col, text_col), "weights")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = numbered(scored, [fit.desc(), F.desc("score"), F.asc_nulls_first(id_col)], name="rank")
    return placed.withColumn("rank", F.when(fit & (F.col("rank") <= drawn), F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows that share an id go together: where one is drawn, all are."""
    chosen = ranked(docs, target, id_col=id_col, text_col=text_col, **settings).where("rank is not null")
    key = free_name(docs, "drawn_id")
    return docs.join(chosen.select(F.col(id_col).alias(key)).distinct(), F.col(id_col).eqNullSafe(F.col(key)), "left_semi")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    got = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: crc32 is written out: a table of 256 values, then one step for each byte of a word's UTF-8 form.
ORACLE = r"""
WITH RECURSIVE bits(b, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
words AS (SELECT 0 AS kind, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
kinds AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
hashed AS (SELECT w, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
    FROM kinds, steps),
placed AS (SELECT kind, doc_id, bucket FROM words JOIN hashed USING (w)),
counts AS (SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed GROUP BY bucket),
sums AS (SELECT sum(s) + 10000 AS s_all, sum(t) + 10000 AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * t1.s_all)::DOUBLE / ((s + 1) * t1.t_all)::DOUBLE))::BIGINT AS gain FROM counts, sums t1),
weights AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || d.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents d LEFT JOIN weights USING (doc_id)),
placed_ranks AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight::BIGINT AS weight, score::BIGINT AS score,
    CASE WHEN n_features >= 20 AND r <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100 THEN r END AS rank
FROM placed_ranks"""
