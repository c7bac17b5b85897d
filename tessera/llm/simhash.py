"""SimHash near-duplicates found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word of the perfect
binary Golay code (length 23, distance 7). A word has one codeword within distance 3 and, where that distance is 3,
five more at distance 4. If two words differ in at most one bit, the codeword of the one is among these up to six
codewords of the other; that makes codeword indices (12 bits) keys that survive one wrong bit.

Pigeonhole over at most three differing bits in three segments:

* some segment agrees: the other two hold three errors at most, so one of them holds at most one. The key
  (agreeing segment, codeword of the other one), six ordered pairs of segments, catches the link;
* no segment agrees: each holds exactly one error, and one half of the last segment agrees. The key (codeword of
  the first, codeword of the second, half), two of them, catches the link.

The indexed side gives its own codeword (8 keys a fingerprint), the probing side all nearby ones (at most 108),
so a chance meeting needs 33 equal bits. Candidates are verified by counting the differing bits.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut
from tessera.operators.graph import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
_CHUNK = 1 << 15


def gram_hashes(raw: bytes | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word k-grams of one text given as UTF-8 bytes, in their order; of fewer words one of all of them."""
    words = (raw or b"").lower().split()  # on bytes both know A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.dtype("<u8"))


def fingerprint(raw: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of one text given as UTF-8 bytes; no word (also null): 0."""
    return vote(gram_hashes(raw, k))


def vote(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255  # so many ones still fit one byte
        ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += np.add.reduce(bits[whole:], axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_udf(raw: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in raw.to_pylist()], np.uint64).view(np.int64))


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, error patterns by syndrome (2048, 6), how many of the six differ).

    The generator polynomial is x^11+x^10+x^6+x^5+x^4+x^2+1. Row s of the patterns has the coset leader first;
    leaders of weight 3 are followed by the five patterns of weight 4 of the same syndrome.
    """
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= 0xC75 << (bit - 11)
        parity[m] = r
    patterns, filled = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = (e & 0x7FF) ^ parity[e >> 11]
            if weight < 4 or int(patterns[s, 0]).bit_count() == 3:
                patterns[s, filled[s]] = e
                filled[s] += 1
    return parity, patterns, filled


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords near each 23-bit word, (n, 6), the nearest first; and which of the six are given."""
    parity, patterns, filled = golay()
    s = (words & 0x7FF) ^ parity[words >> 11]
    return (words[:, None] ^ patterns[s]) >> 11, np.arange(6) < filled[s][:, None]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    u = fp.view(np.uint64)
    return [(u & np.uint64(0x3FFFFF)).astype(np.int64), (u >> np.uint64(22) & np.uint64(0x1FFFFF)).astype(np.int64), (u >> np.uint64(43)).astype(np.int64)]


def golay_keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of the fingerprints (int64); ``probe``: of all nearby codewords, else the nearest alone."""
    seg = segments(fp)
    near = [codewords(s) for s in seg]
    rows, keys = [], []
    n, width = np.arange(len(fp)), 6 if probe else 1
    tag = 0
    for exact in range(3):
        for other in range(3):
            if exact != other:
                index, given = near[other][0][:, :width], near[other][1][:, :width]
                key = (tag << 56) | (seg[exact][:, None] << 12) | index
                rows.append(np.broadcast_to(n[:, None], key.shape)[given])
                keys.append(key[given])
                tag += 1
    (a, has_a), (b, has_b) = near[0], near[1]
    pair = (a[:, :width, None] << 12 | b[:, None, :width]).reshape(len(fp), -1)
    given = (has_a[:, :width, None] & has_b[:, None, :width]).reshape(len(fp), -1)
    for half in (seg[2] & 0x3FF, seg[2] >> 10):
        key = (tag << 56) | (half[:, None] << 24) | pair
        rows.append(np.broadcast_to(n[:, None], key.shape)[given])
        keys.append(key[given])
        tag += 1
    return np.concatenate(rows), np.concatenate(keys)


def _keys_of(probe: bool):
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                row, key = golay_keys(part, probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct ``fps(fp)`` -> links ``(a, b)`` that connect exactly what the rule "at most ``max_bits`` (up to 3)
    differing bits" connects.

    A key that many different fingerprints share would give a link for each pair. So each fingerprint is first
    linked to the smallest of its key if the rule allows that (a star, linear in the rows), and the join then
    gives only those pairs whose stars have not met; the rule is still tested on every pair of a key.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("Golay keys reach three differing bits")
    width = max(8, fps.sparkSession.sparkContext.defaultParallelism)
    spread = fps.repartition(width, "fp")
    near = f"bit_count(a ^ b) <= {max_bits}"
    index = spread.mapInArrow(_keys_of(False), "key long, fp long")
    heads = cut(index.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b"))
    star = cut(index.withColumnRenamed("fp", "a").join(heads, "key").where("a <> b").where(near).groupBy("a").agg(F.min("b").alias("b")))
    up = star.select(F.col("a").alias("b"), F.col("b").alias("c"))
    tops = cut(star.join(up, "b", "left").select(F.col("a").alias("fp"), F.coalesce("c", "b").alias("top")))
    marked = spread.join(tops, "fp", "left").select("fp", F.coalesce("top", "fp").alias("top")).repartition(width, "fp")
    one = marked.mapInArrow(_marked_keys(False), "key long, a long, ta long")
    many = marked.mapInArrow(_marked_keys(True), "key long, b long, tb long")
    met = one.hint("merge").join(many, "key").where("ta <> tb and a < b").where(near)
    return met.select("a", "b").union(star)


def _marked_keys(probe: bool):
    names = ["key", "b", "tb"] if probe else ["key", "a", "ta"]

    def run(batches):
        for batch in batches:
            fp, top = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(fp), 2048):
                row, key = golay_keys(fp[at : at + 2048], probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row + at]), pa.array(top[row + at])], names)

    return run


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (long), ``component_id``: the smallest id reachable by links.

    Nulls: a null text counts as empty (fingerprint 0, linked like any other); a null id gets its group's
    component id, null if no id is known there. Repeated rows stay. Other columns are not looked at.
    """
    fps = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col).cast("binary")).alias("fp")))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(classes.select("fp"), max_bits))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = cut(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
