"""URL filtering with a cascade of Bloom filters.

A Bloom filter of the listed keys has false positives. Here the complete key universe (every host of the corpus) is
known, so the false positives among it are known too: level 1 holds the listed keys, level 2 those other keys that
level 1 lets through, level 3 those listed keys that level 2 lets through, and so on until a level lets nothing
through. A key's first level that says no tells whether it is listed, exactly, for every key of the universe;
rows are judged without a join.

The levels are built from aggregates of set bits. Keys are dealt into shards by hash so that a shard's first level (listed
keys) and second level (false positives, about one in a hundred of the universe) hold ``SHARD_KEYS`` keys at most, in
expectation. Rows go to the branch of their shard, and only that branch gets the shard's levels, a broadcast of known size.
Keys that two independent 64-bit hashes cannot tell apart come out of the last level; the listed ones of them are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ascii_lower, cut, free_name, table

SHARD_KEYS = 4_000_000  # about 5 MB of bits
BITS_PER_KEY, HASHES, LEAST_BITS, MOST_LEVELS = 10, 5, 512, 64
FALSE_POSITIVES = 0.0095  # of a level with BITS_PER_KEY and HASHES

# The rules of the contract, host and path prefix, and the verdict of each.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# The block list of the query; a dot in front stands for the host and all its subdomains.
LISTED = (
    ".cheap-pills.example.com", ".cheap-pills.example.net", ".cheap-pills.example.org",
    ".spam-farm.example.com", ".spam-farm.example.net", ".spam-farm.example.org",
)


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


@dataclass
class Cascade:
    levels: list[np.ndarray]  # the bits of each level, packed
    rest: frozenset | None = None  # listed keys that no level tells from others

    def listed(self, h1: np.ndarray, h2: np.ndarray, keys: list) -> np.ndarray:
        """For keys of the universe and their two hashes: whether they are listed."""
        out = np.zeros(len(h1), bool)
        left = np.arange(len(h1))
        for turn, bits in enumerate(self.levels):
            inside = _inside(bits, h1[left], h2[left], turn)
            out[left[~inside]] = turn % 2 == 1
            left = left[inside]
        if self.rest is None:
            out[left] = len(self.levels) % 2 == 1  # through all levels: what the last one holds
        else:
            out[left] = [keys[i] in self.rest for i in left.tolist()]
        return out


def _places(h1: np.ndarray, h2: np.ndarray, turn: int, size: int) -> Iterator[np.ndarray]:
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    for k in range(HASHES):
        yield ((a + np.uint64(turn * HASHES + k) * b) >> np.uint64(8)) % np.uint64(size)


def _inside(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray, turn: int) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for place in _places(h1, h2, turn, len(bits) * 8):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _setter(turn: int, size: int):
    def run(batches):
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place = np.unique(np.concatenate([*_places(h1, h2, turn, size)])) if len(h1) else np.zeros(0, np.uint64)
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    return run


def _through(bits: np.ndarray, turn: int, spark):
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf(T.BooleanType())
    def test(h1: pa.Array, h2: pa.Array) -> pa.Array:
        return pa.array(_inside(shared.value, h1.to_numpy(), h2.to_numpy(), turn))

    return test


def _tester(cascade: Cascade, spark):
    shared = spark.sparkContext.broadcast(cascade)

    @F.arrow_udf(T.BooleanType())
    def test(h1: pa.Array, h2: pa.Array, keys: pa.Array) -> pa.Array:
        exact = shared.value.rest is not None
        return pa.array(shared.value.listed(h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), keys.to_pylist() if exact else []))

    return test


def hashes_of(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes from different seeds: a hash over two values takes the first one's as the seed of the second."""
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def build_cascade(keys: DataFrame) -> Cascade:
    """``keys(key, h1, h2, listed)``: the universe, once each -> the levels that tell the listed keys from the others."""
    spark, levels = keys.sparkSession, []
    left = keys
    for turn in range(MOST_LEVELS):
        holds = F.col("listed") if turn % 2 == 0 else ~F.col("listed")
        left = cut(left)
        held = left.where(holds)
        n = held.count()
        if not n:
            return Cascade(levels)  # the last level let none of these through, so what passed it is what it holds
        size = -(-max(LEAST_BITS, n * BITS_PER_KEY) // 64) * 64
        bits = np.zeros(size // 64, np.uint64)
        words = held.select("h1", "h2").mapInArrow(_setter(turn, size), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        got = words.toArrow()
        bits[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        levels.append(bits.view(np.uint8))
        passed = _through(levels[-1], turn, spark)("h1", "h2")
        left = left.where(holds | passed)  # the keys it holds all pass; of the others, the false positives stay
    # what is left are keys with both hashes alike (levels otherwise end long before): so few that they are listed one by one
    return Cascade(levels, frozenset(r["key"] for r in left.where("listed").select("key").collect()))


def mark_listed(rows: DataFrame, key: str, universe: DataFrame, listed: DataFrame, name: str = "listed") -> DataFrame:
    """``rows`` and a boolean column ``name``: whether ``key`` is among ``listed(key)``.

    ``universe(key)`` must hold every key of ``rows`` (repeats do no harm). Null keys are not listed; listed keys that are not
    in the universe do no harm. Repeated rows stay.
    """
    marks = universe.select("key", F.lit(0).alias("l")).union(listed.select("key", F.lit(1).alias("l"))).where("key is not null")
    h1, h2 = hashes_of(F.col("key"))
    keys = cut(marks.groupBy("key").agg(F.max("l").alias("l")).select("key", h1.alias("h1"), h2.alias("h2"), (F.col("l") == 1).alias("listed")))
    n = keys.agg(F.count_if("listed"), F.count("*")).first()
    shards = int(max(n[0], FALSE_POSITIVES * n[1])) // SHARD_KEYS + 1
    of = lambda h: F.pmod(F.shiftrightunsigned(h, 3), F.lit(shards))
    h1, h2 = hashes_of(F.col(key))
    branches = []
    for k in range(shards):
        test = _tester(build_cascade(keys.where(of(F.col("h1")) == k)), rows.sparkSession)
        own = rows if shards == 1 else rows.where(of(h1) == k)  # a null key is hashed as well
        branches.append(own.withColumn(name, F.col(key).isNotNull() & test(h1, h2, F.col(key))))
    return reduce(DataFrame.unionAll, branches)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` and ``host, path, rule, verdict`` (in place of columns of these names). A host of ``listed(key)`` is blocked
    by the list, with its subdomains if the key begins with a dot, unless a rule says otherwise.

    A null url, or one without ``://``, has an empty host and path; the empty host is a key like any other.
    Repeated rows and null ids stay.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*names, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    mark = free_name(split, "listed")
    hosts = split.select(F.col("host").alias("key"))
    marked = mark_listed(split, "host", hosts, expand(listed, hosts.distinct()), mark)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return marked.select(*names, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col(mark), "block").otherwise("allow")).alias("verdict"))


def expand(listed: DataFrame, hosts: DataFrame) -> DataFrame:
    """The keys of ``listed`` and, for those that begin with a dot, the ``hosts`` that end with them, by their endings."""
    plain = listed.where(~F.startswith("key", F.lit(".")))
    labels = F.split("key", "[.]")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    under = hosts.select("key", F.explode(endings).alias("ending")).join(listed.select(F.col("key").alias("ending")).distinct(), "ending", "left_semi")
    return plain.select("key").union(under.select("key")).distinct()


def op4_urls(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = spark.createDataFrame([(h,) for h in LISTED], "key string")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH listed(key) AS (VALUES {", ".join(f"('{h}')" for h in LISTED)}),
split AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN EXISTS (SELECT 1 FROM listed WHERE ends_with('.' || host, key)) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
