"""Near copies for the pipeline: five-word shingles with a Jaccard coefficient of 0.8 or more, or linked fingerprints.

Candidates share a key: ``BANDS`` keys of ``ROWS`` minima each of the hashed shingle set. Two sets of coefficient J have
no key in common with probability ``(1 - J ** ROWS) ** BANDS``, 3.2e-6 at 0.8 and less above. Candidates of which fewer than
``AGREE`` minima agree are left (at 0.8 that is 4.3 standard deviations off); the others are verified on their whole texts.

A key that many sets share would give a pair for each two. So each set is first compared to one hub: of the key's hubs, the one it shares most
keys with (a star, linear in the rows). The hub of a key is the set whose keys are shared by most others; in a group of near copies this is the text
that the others were made from, or one close to it, so this connects nearly all that can be connected. Then, of the keys whose sets are not all
connected, those of up to ``FEW`` sets are compared pair by pair (linear in the rows, too), and in the others each set is compared to the hub of every key.
Sets of such larger keys that are still apart meet by the engine's prefix-filtered join of their shingles: on an early rare shingle and a band of
sizes. In a group whose likeness is mostly near 0.7 the first shingles of each text are its own, so hardly any pair meets, however large the group;
and no pair of 0.8 is left out. The texts of sets that share a key move once; what follows reads those alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, free_name, saved, written
from tessera.llm.simhash import gram_hashes, links, vote
from tessera.operators.graph import components
from tessera.operators.similarity import fraction, frequent_items, meeting, prefixes
from tessera.sources.tables import remove

SIMILAR = 0.8
BANDS, ROWS = 24, 4
AGREE = 54  # of all minima; at 0.8 fewer agree once in ten million
FEW = 8  # sets of a key that are compared pair by pair
SLICE = 256
_STEP = 4096
_RANDOM = np.random.default_rng(42)
_FACTOR = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ a >> np.uint64(31)) * _A + (b ^ b >> np.uint64(29)) * _B
    x = (x ^ x >> np.uint64(32)) * _C
    return x ^ x >> np.uint64(29)


def shingles(three: np.ndarray) -> np.ndarray:
    """The different five-word shingles as hashes, ascending, from the hashes of the three-word ones (two of them make one of five words)."""
    if len(three) > 2:
        three = _mix(three[:-2], three[2:])
    elif len(three) == 2:  # four words: one shingle of them all
        three = _mix(three[:1], three[1:])
    return np.unique(three)


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), _STEP):
        part = found[at : at + _STEP, None] * _FACTOR + _SHIFT
        out = np.minimum(out, (part >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def similar(a: bytes | None, b: bytes | None) -> bool:
    x, y = shingles(gram_hashes(a)), shingles(gram_hashes(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return bool(both) and both >= SIMILAR * (len(x) + len(y) - both)


SKETCH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("s", T.LongType()), T.StructField("minima", T.BinaryType())])


@F.arrow_udf(SKETCH)
def sketch_udf(raw: pa.Array) -> pa.Array:
    """Fingerprint, a number for the shingle set (null without a word) and the minima."""
    fp, ids, low = [], [], []
    for text in (t for at in range(0, len(raw), SLICE) for t in raw.slice(at, SLICE).to_pylist()):
        three = gram_hashes(text)
        found = shingles(three)
        fp.append(vote(three))
        ids.append(int(_mix(found, found).sum(dtype=np.uint64).view(np.int64)) if len(found) else None)
        low.append(minima(found).tobytes() if len(found) else None)
    return pa.StructArray.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(low, pa.binary())], ["fp", "s", "minima"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingles_udf(raw: pa.Array) -> pa.Array:
    found = [shingles(gram_hashes(t)).view(np.int64) for t in raw.to_pylist()]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


@F.arrow_udf(T.IntegerType())
def agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(T.BooleanType())
def similar_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    parts = ((a.slice(at, SLICE), b.slice(at, SLICE)) for at in range(0, len(a), SLICE))
    return pa.array([similar(x, y) for p, q in parts for x, y in zip(p.to_pylist(), q.to_pylist(), strict=True)], pa.bool_())


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        low, ids = batch.column(1).to_pylist(), batch.column(0).to_numpy()
        for at in range(0, len(low), 1024):
            part = np.frombuffer(b"".join(low[at : at + 1024]), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(band, part.shape[:2])
            for r in range(ROWS):
                key = _mix(key, part[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[at : at + 1024], BANDS))], ["key", "s"])


def similar_sets(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct ``sets(s, minima, _row)`` and their ``texts(_row, text)`` -> links ``(a, b)`` that connect what similarity connects."""
    paths: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        paths.append(path)
        return df

    def final(links: DataFrame) -> DataFrame:
        """Links as a table of their own; all other tables go."""
        links = saved(links, "similar-links")
        for path in paths:
            remove(sets.sparkSession, path)
        return links

    index = sets.select("s", "minima").mapInArrow(_band_keys, "key long, s long")
    often = cut(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = kept(index.join(often, "key"), "shared")
    weight = kept(shared.groupBy("s").agg(F.sum("n").alias("w")), "weights")
    heads = cut(shared.join(weight, "s").groupBy("key").agg(F.max(F.struct("w", "s"))["s"].alias("b")))
    led = kept(shared.join(heads, "key"), "led")
    nodes = kept(weight.join(sets.select("s", "_row", "minima"), "s").select("s", "_row", "minima"), "nodes")
    # always moved, once: the cost follows the input, and nothing of its size is sent to every task
    held = kept(texts.select("_row", F.col("text").cast("binary").alias("text")).join(nodes.select("s", "_row").hint("merge"), "_row").select("s", "text"), "texts")
    low = nodes.select("s", "minima")

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.join(low.toDF("a", "ma").hint("merge"), "a").join(low.toDF("b", "mb").hint("merge"), "b")  # too wide to pass the driver
        return both.select("a", "b", agreeing("ma", "mb").alias("n")).where(F.col("n") >= AGREE).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(held.toDF("a", "ta").hint("merge"), "a").join(held.toDF("b", "tb").hint("merge"), "b")
        return kept(both.where(similar_udf("ta", "tb")).select("a", "b"), "similar-links")

    first = led.where("s <> b").groupBy(F.col("s").alias("a"), "b").agg(F.count("*").alias("n"))
    first = cut(first.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b"))
    links = verified(cut(close(first)))
    tops = components(links).toDF("s", "top")
    open_ = kept(_open(led.join(tops, "s", "left").select("key", "s", "n", "b", F.coalesce("top", "s").alias("top"))), "open")
    if open_.isEmpty():
        return final(links)
    few, many = open_.where(F.col("n") <= FEW).select("key", "s", "top"), open_.where(F.col("n") > FEW).select("key", "s", "b", "top")
    every = few.toDF("key", "a", "ta").join(few.toDF("key", "b", "tb"), "key").where("a < b and ta <> tb").select("a", "b")
    hubs = many.where("s = b").select("key", "b", F.col("top").alias("tb"))
    star = many.select("key", F.col("s").alias("a"), "top").join(hubs, "key").where("top <> tb").select("a", "b")
    new = verified(cut(close(cut(every.union(star).distinct()))))
    if not new.isEmpty():
        links = links.union(new)
        of = open_.select("s", "top").distinct()
        moved = new.join(of.toDF("a", "ta"), "a").join(of.toDF("b", "tb"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        roots = components(moved).toDF("top", "root")
        many = many.join(roots, "top", "left").select("key", "s", F.coalesce("root", "top").alias("top"))
    apart = kept(_open(many).select("s", "top").distinct(), "apart")
    if apart.isEmpty():
        return final(links)
    t = fraction(SIMILAR)
    found = held.join(apart, "s").select(F.col("s").alias("id"), F.lit("").alias("area"), shingles_udf("text").alias("items"), F.col("top").alias("_top"))
    found = kept(found, "open-sets")
    index = prefixes(found, kept(frequent_items(found), "frequent"), t).join(found.select("id", "_top"), "id")
    index = kept(index, "prefixes")
    pairs = meeting(index, index, t).where("a < b and a_top <> b_top").select("a", "b").distinct()
    return final(links.union(verified(cut(pairs))))


def _open(marked: DataFrame) -> DataFrame:
    """The rows ``key, s, top`` (and what else they have) of keys whose sets are not all connected."""
    mixed = marked.groupBy("key").agg(F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo < hi").select("key")
    return marked.join(mixed, "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near copies in ``docs`` one row: the one with the smallest id, null ids last.

    Groups are connected by five-word similarity of ``SIMILAR`` or more and by fingerprints of the SimHash rule; texts
    without a word (also null ones) have fingerprint 0 and are one group. Rows are told apart by a number that is written with
    them, so rows that repeat, share an id or have none count one by one. All columns stay, whatever their names.
    """
    number = free_name(docs, "_row")
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "similar")
    texts = rows.select(F.col(number).alias("_row"), "doc_id", "text")
    known = cut(texts.select("_row", "doc_id", sketch_udf(F.col("text").cast("binary")).alias("k")).select("_row", "doc_id", "k.*"))
    sets = cut(known.where("s is not null").groupBy("s").agg(F.min("fp").alias("fp"), F.min("_row").alias("_row"), F.first("minima").alias("minima")))
    of = sets.select("s", "fp")
    same = cut(known.where("s is not null").select("s", F.col("fp").alias("a")).distinct()).join(of, "s").where("a <> fp").select("a", F.col("fp").alias("b"))
    near = similar_sets(sets, texts).join(of.toDF("a", "fa"), "a").join(of.toDF("b", "fb"), "b").select("fa", "fb")
    every = cut(known.select("fp").distinct())
    roots = components(links(every).union(same).union(near)).toDF("fp", "root")
    rooted = cut(known.select("_row", "doc_id", "fp").join(roots, "fp", "left").select("_row", "doc_id", F.coalesce("root", "fp").alias("root")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    least = cut(rooted.groupBy("root").agg(F.min(order)["_row"].alias("_row")))
    return rows.join(least.select(F.col("_row").alias(number)), number, "left_semi").select(docs.columns)
