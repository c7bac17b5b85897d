"""Benchmark passages inside documents, by the q-gram lemma over diagonal bands and banded alignment.

Texts are compared lower-cased, without ASCII punctuation and with single blanks. If an item of ``m`` bytes occurs in
a document with at most ``k`` edits, at least ``m - q + 1 - k q`` of its q-grams occur there on diagonals (place in the
document minus place in the item) that differ by at most ``k``. So:

1. places of the document that hold any item's q-gram are marked; a document without one window dense enough
   for the least demanding item is done (the bound is a necessary condition, nothing is lost);
2. places whose surroundings repeat an earlier part of the document byte by byte are left out: what is found there is found
   at the first such place as well. So repetitive text costs what its different parts cost;
3. shared q-grams are counted by item and diagonal band; bands are ``2 k + 1`` diagonals apart and twice as wide, so
   each set of diagonals no more than ``2 k`` apart is inside one band. Pairs are counted in pieces of ``PAIRS``;
4. bands that reach the item's count, neighbours put together, are verified by an alignment of the item restricted to
   them, those that share most first, until one is within the budget.

q-grams that stand in more than ``MOST_POSTINGS`` places of the items are not counted but taken as shared; an item that
has nothing else is verified everywhere. Items shorter than ``LEAST_BYTES`` are searched as they are, between word ends.

Items are the stated query set: they go to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the documents
for each block, and a pass is written before the next block is fetched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import saved, table

Q = 8
EDIT_SHARE = 0.08
LEAST_BYTES = 24  # shorter items (normalised) are searched without edits
BLOCK_BYTES = 2 << 20
SLICE = 1 << 20
PAIRS = 1 << 20
MOST_POSTINGS = 512
WIDE, APART = 1 << 15, 1024  # diagonals of one alignment; bands no further apart are aligned together
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = bytes(32 if i < 128 and chr(i).isspace() else i for i in range(256))
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").replace(b"\xc2\xa0", b" ").translate(_TABLE, _PUNCTUATION)  # also the no-break space


def normalise(text: str) -> bytes:
    raw = _plain(text)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw.strip(b" ")


def places(text: str) -> np.ndarray:
    """For each byte of ``normalise(text)`` the code point of ``text`` that it comes from."""
    out, blank = [], True
    for i, ch in enumerate(text):
        for b in _plain(ch):
            if b != 32 or not blank:
                out.append(i)
            blank = b == 32
    if blank and out:
        out.pop()
    return np.array(out, np.int64)


def codes(raw: bytes) -> np.ndarray:
    """The q-grams of ``raw`` as 64-bit numbers, one for each place."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(raw, np.uint8)
    two = a[:-1].astype(np.uint16) | a[1:].astype(np.uint16) << 8
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << 16
    return four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32)


def slots(c: np.ndarray) -> np.ndarray:
    return (c * _MIX >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class Index:
    """The q-grams of one block of items, and its short items."""

    ids: list
    items: list[bytes]
    budgets: np.ndarray  # edits allowed
    needs: np.ndarray  # q-grams to share, without those that are not counted; 0 or less: verified everywhere
    marked: np.ndarray  # slot of the hash -> some item has such a q-gram
    grams: np.ndarray  # different q-grams that are counted, ascending
    first: np.ndarray  # of each, its first posting; one more at the end
    post_item: np.ndarray
    post_at: np.ndarray
    window: int
    least: int  # marked places in some window of a document that holds an item
    reach: int  # bytes that a band of any item can touch
    short: object  # automaton of the short items, or None


def build(pairs: list[tuple[object, str]]) -> Index | None:
    known = [(item_id, raw) for item_id, text in pairs if (raw := normalise(text or ""))]
    long = [x for x in known if len(x[1]) >= LEAST_BYTES]
    ids, items = [x[0] for x in long], [x[1] for x in long]
    short = None
    for item_id, raw in known:
        if len(raw) < LEAST_BYTES:
            short = short or ahocorasick.Automaton()
            short.add_word(f" {raw.decode('latin-1')} ", (len(ids), len(raw)))
            ids.append(item_id)
    if short:
        short.make_automaton()
    none = np.zeros(0, np.int64)
    if not items:
        return Index(ids, [], none, none, none, none, none, none, none, 0, 0, 0, short) if short else None
    m = np.array([len(x) for x in items])
    budgets = (EDIT_SHARE * m + 1e-9).astype(np.int64)  # from LEAST_BYTES on, two q-grams at least are left to share
    needs = m - Q + 1 - budgets * Q
    all_codes = [codes(x) for x in items]
    flat = np.concatenate(all_codes)
    item = np.repeat(np.arange(len(items), dtype=np.int32), [len(c) for c in all_codes])
    at = np.concatenate([np.arange(len(c), dtype=np.int32) for c in all_codes])
    window = int((m + budgets).min())
    least = int(np.ceil(needs / np.ceil((m + budgets) / window)).min())
    order = np.argsort(flat, kind="stable")
    grams, first, n = np.unique(flat[order], return_index=True, return_counts=True)
    marked = np.zeros(1 << _BITS, bool)
    marked[slots(grams)] = True
    counted = n <= MOST_POSTINGS
    order = order[np.repeat(counted, n)]
    needs = needs - (m - Q + 1 - np.bincount(item[order], minlength=len(items)))
    reach = int((m + 6 * budgets).max()) + 2 + Q
    return Index(ids, items, budgets, needs, marked, grams[counted], np.concatenate([[0], np.cumsum(n[counted])]), item[order], at[order], window, least, reach, short)


def edits_in_band(item: bytes, doc: bytes, low: int, high: int, budget: int, anchored: bool = False) -> tuple[int, int]:
    """(least edits of ``item`` against a part of ``doc``, end of that part), on diagonals ``low`` to ``high`` only.

    ``anchored``: the part begins where the document does. Diagonals that are over ``budget`` already, and too far from
    others to come below it again, are given up on the way; where none is left, some number over the budget is returned.
    """
    d = np.frombuffer(doc, np.uint8)
    far = len(item) + len(doc) + 1
    where = np.arange(low, high + 1, dtype=np.int32)
    padded = np.full(len(item) + len(where) + 1, 256, np.int16)
    a, b = max(low, 0), min(low + len(padded), len(d))
    if b > a:
        padded[a - low : b - low] = d[a:b]
    begin = np.where((where >= 0) & (where <= len(d)), where if anchored else 0, far).astype(np.int32)
    cols, row = where - np.int32(low), begin
    packed, apart, edge = False, [], len(d) - low
    for i, byte in enumerate(item):
        if i % 16 == 0 and i:
            alive = row <= budget
            if not alive.any():
                return budget + 1, 0
        if i % 16 == 0 and len(row) > 512:
            alive = row <= budget
            left = np.maximum.accumulate(np.where(alive, cols, -far))
            right = np.minimum.accumulate(np.where(alive, cols, 2 * far)[::-1])[::-1]
            keep = (cols - left <= budget + 1) | (right - cols <= budget + 1)
            if keep.sum() * 4 < 3 * len(cols):
                cols, row, packed = cols[keep], row[keep], True
                apart = np.flatnonzero(np.diff(cols) > 1)
        skip_item = np.append(row[1:], far)
        if packed:
            skip_item[apart] = far
        skip_item += 1  # the item's byte has no partner
        row = np.minimum(row + ((padded[cols + i] if packed else padded[i : i + len(row)]) != byte), skip_item)
        if low + i + 1 < 0:
            row[cols < -low - i - 1] = far
        if cols[-1] + i >= edge:
            row[cols + i >= edge] = far
        row -= cols
        np.minimum.accumulate(row, out=row)  # the document's bytes without partner
        row += cols
    k = int(row.argmin())
    return int(row[k]), low + int(cols[k]) + len(item)


def _begin(item: bytes, doc: bytes, end: int, budget: int) -> int:
    """Where the part of ``doc`` that ends at ``end`` and is ``item`` with at most ``budget`` edits begins."""
    part = doc[max(0, end - len(item) - budget) : end][::-1]
    return end - edits_in_band(item[::-1], part, -budget, budget, budget, anchored=True)[1]


def matches(index: Index, raw: bytes, any_one: bool = False) -> dict[int, tuple[int, int, int]]:
    """item -> (edits, start, end) of a verified occurrence in a normalised document; ``any_one``: of one item at most."""
    found: dict[int, tuple[int, int, int]] = {}
    if index.short:
        for end, (item, n) in index.short.iter(f" {raw.decode('latin-1')} "):
            found.setdefault(item, (0, end - 1 - n, end - 1))
            if any_one:
                return found
    if not index.items:
        return found
    for begin in range(0, max(1, len(raw) - Q + 1), SLICE):
        part = raw[begin : begin + SLICE + index.reach]
        c = codes(part)
        hit = index.marked[slots(c)]
        if hit.sum() < index.least:
            continue
        total = np.concatenate([[0], np.cumsum(hit)])
        upto = np.minimum(np.arange(len(c)) + index.window, len(c))
        if (total[upto] - total[: len(c)]).max() < index.least:
            continue
        fresh = _fresh(c, index.reach)
        for item, low, high in _runs(index, c, hit, fresh):
            if item in found:
                continue
            text, budget = index.items[item], int(index.budgets[item])
            place = part.find(text, max(0, low), high + len(text) + 1)
            if place >= 0:
                found[item] = (0, begin + place, begin + place + len(text))
            else:
                edits, end = edits_in_band(text, part, low - budget, high + budget, budget)
                if edits <= budget:
                    found[item] = (edits, begin + _begin(text, part, end, budget), begin + end)
            if any_one and found:
                return found
    return found


def _fresh(c: np.ndarray, reach: int) -> np.ndarray:
    """For each place whether the ``reach`` q-grams from there on differ from those at every earlier place (by a rolling hash)."""
    n = len(c) - reach + 1
    fresh = np.ones(len(c), bool)
    if n > 1:
        base, inverse = _MIX, np.uint64(pow(int(_MIX), -1, 1 << 64))
        power, back = np.cumprod(np.full(len(c), base, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c ^ c >> np.uint64(29)) * (c | np.uint64(1)) * power)])
        fresh[:n] = False
        fresh[np.unique((sums[reach:] - sums[:-reach]) * back, return_index=True)[1]] = True
    return fresh


def _counts(index: Index, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item << 40 | band + 2 ** 30, shared q-grams) of every band that shares any, ascending."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(index.grams):
        return keys, sums
    gram = np.minimum(np.searchsorted(index.grams, c[at]), len(index.grams) - 1)
    same = index.grams[gram] == c[at]
    at, gram = at[same], gram[same]
    count = index.first[gram + 1] - index.first[gram]
    total = np.cumsum(count)
    if not len(total):
        return keys, sums
    bounds = [0, *np.unique(np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS)) + 1).tolist(), len(at)]
    for a, b in zip(bounds, bounds[1:]):
        g, k = gram[a:b], count[a:b]
        run = np.repeat(index.first[g] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        item = index.post_item[run].astype(np.int64)
        band = (np.repeat(at[a:b], k) - index.post_at[run]) // (2 * index.budgets[item] + 1)
        mixed = item << 40 | (band + (1 << 30))
        new, n = np.unique(np.concatenate([mixed, mixed - 1]), return_counts=True)  # a band is its own step and the next one
        if len(keys):
            new, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([sums, n])).astype(np.int64)
        keys, sums = new, n
    return keys, sums


def _runs(index: Index, c: np.ndarray, hit: np.ndarray, fresh: np.ndarray) -> list[tuple[int, int, int]]:
    """(item, lowest, highest diagonal) of neighbouring bands that share enough q-grams; of each item the best first."""
    if not fresh.all():
        total = np.cumsum(fresh)
        before = np.concatenate([np.zeros(min(index.reach, len(total)), total.dtype), total[: -index.reach]])
        hit = hit & (total > before)  # within reach of a fresh place
    keys, n = _counts(index, c, np.flatnonzero(hit))
    item, band = keys >> 40, (keys & ((1 << 40) - 1)) - (1 << 30)
    width = 2 * index.budgets[item] + 1
    good = (n >= index.needs[item]) & fresh[np.clip(band * width - index.budgets[item], 0, len(c) - 1)]
    item, band, width, n = item[good], band[good], width[good], n[good]
    out = []
    if len(item):
        new = np.concatenate([[True], (np.diff(item) != 0) | (np.diff(band) * width[1:] > APART)])
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= np.concatenate([[False], np.diff((band - band[start]) * width // WIDE) > 0])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(item)) - 1
        most = np.maximum.reduceat(n, head)
        order = np.lexsort((band[head], -most, item[head]))
        head, last = head[order], last[order]
        out = list(zip(item[head].tolist(), (band[head] * width[head]).tolist(), ((band[last] + 2) * width[head] - 1).tolist()))
    for i in np.flatnonzero(index.needs < 1).tolist():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], fresh.astype(np.int8), [0]])))
        budget = int(index.budgets[i])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            out += [(i, x, min(x + WIDE, b) + 2 * budget) for x in range(a, b, WIDE)]
    return out


def _blocks(items: DataFrame) -> tuple[int, Iterator[Index]]:
    """How many blocks of items there are, and their indices, one at a time. The sizes are counted first."""
    known = items.select("item_id", "text").where("text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    parts = (known.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id").toLocalIterator() for k in range(n))
    return n, (x for x in (build([(r["item_id"], r["text"]) for r in rows]) for rows in parts) if x)


COLUMNS = "start long, end long, edits long"


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: one row for each document row and item that it holds (one verified place).

    Offsets are code points of the whole text. Null or empty texts hold nothing; null items, and those of punctuation and
    blanks alone, are in nothing; of items with one text the smallest id is reported. Repeated rows are reported each. Other
    columns of either table are not looked at.
    """
    id_type, item_type = docs.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id {item_type.simpleString()}, {COLUMNS}"
    n, blocks = _blocks(items)
    found = []
    for index in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        part = _scan(docs.select("doc_id", "text"), shared, schema, to_arrow_type(id_type), to_arrow_type(item_type))
        if n > 1:
            part = saved(part, "leaks")
            shared.destroy()
        found.append(part)
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def _scan(docs: DataFrame, shared, schema: str, id_type: pa.DataType, item_type: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and (found := matches(shared.value, normalise(text))):
                    where = places(text)
                    for item, (edits, a, b) in sorted(found.items()):
                        rows.append((doc_id, shared.value.ids[item], int(where[min(a, len(where) - 1)]), int(where[min(b, len(where)) - 1]) + 1, edits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [id_type, item_type, *[pa.int64()] * 3], strict=True)], ["doc_id", "item_id", "start", "end", "edits"])

    return docs.mapInArrow(run, schema)


def _tester(shared):
    @F.arrow_udf(T.BooleanType())
    def leaky(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t) and bool(matches(shared.value, normalise(t), any_one=True)) for t in texts.to_pylist()], pa.bool_())

    return leaky


def remove_leaky(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item (as ``find_leaks`` finds them). No row is moved: each block of items is one
    more test on the row; with several blocks what passes one is written before the next is tested."""
    n, blocks = _blocks(items)
    for index in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~_tester(shared)("text"))
        if n > 1:
            docs = saved(docs, "clean")
            shared.destroy()
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
