"""Alignment of two tokenizers: groups of tokens over the same bytes, links within them, counts of linked ids.

Ends of tokens are cumulated byte lengths; bytes at which both tokenizers end a token are common cuts (``intersect1d``), and
a token's group is the place of its end among them (``searchsorted``). All pairs of a group are links; they are laid
out by repeating each token of the first tokenizer as often as its group has tokens of the second. This is done for
whole blocks of documents at once, as every document ends with a common cut.

Counts: a block lists its different pairs of ids, each with the number of its documents that hold it, so what is shuffled
is at most one row for each pair and block. They are summed by pair and salt, then by pair; the totals go back the same way (to
the pairs and salts that are there, then to the blocks' rows), so no pair's rows have to meet in one task, and nothing is
broadcast. A block and the counts of its pairs are joined row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import read_ranks, slices
from tessera.llm.common import written
from tessera.llm.units import Units

BYTE_MODEL, PIECE_MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20  # of the texts of a block; one longer text is a block of its own
LINKS = 1 << 22  # laid out at once
SALTS = 64
BLANK = "▁"


class Both:
    """Ids of ``blank + text`` by the byte-level ranks (A) and of the text by the pieces (B, whose model adds the blank).

    A text whose joined A or B bytes are not those of ``blank + text``, and an empty one, has no ids.
    """

    def __init__(self, byte_model: str | None = None, piece_model: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        ranks = read_ranks(byte_model)
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model or public_tokenizers.path(PIECE_MODEL))
        self.a_bytes = {i: token for token, i in ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.a_sizes[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # units stand alone if a blank only ever begins a piece and no piece holds a line end
        self.apart = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        self.units = Units(self._learn, self._whole, lambda forms: tuple(map(b"".join, zip(*forms))), " ")

    def _checked(self, raw: bytes, a: list[int], b: list[int]) -> tuple[bytes, bytes] | None:
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        return text and self._checked(f" {text}".encode(), self.a.encode_ordinary(f" {text}"), self.b.encode(text)) or (b"", b"")

    def _learn(self, units: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Units are encoded joined to one text and told apart by their ends; where that text's bytes do not come back, one by one."""
        if not self.apart:
            return [None] * len(units)
        out: list[tuple[bytes, bytes] | None] = []
        for at in range(0, len(units), 8192):
            part = units[at : at + 8192]
            own = [" a", *(u if u[0] == "\n" else f" {u}" for u in part)]  # a first word, before which B puts its blank
            joined = "".join(own)
            coded = self._checked(joined.encode(), self.a.encode_ordinary(joined), self.b.encode(joined[1:]))
            if coded is None:
                out += map(self._one, part)
                continue
            stops = np.cumsum([len(x.encode()) for x in own])
            parts = []
            for raw, sizes in zip(coded, (self.a_sizes, self.b_sizes), strict=True):
                ends = ((np.searchsorted(np.cumsum(sizes[np.frombuffer(raw, "<u4")]), stops) + 1) * 4).tolist()
                parts.append([raw[x:y] for x, y in zip(ends, ends[1:])])
            out += zip(*parts, strict=True)
        return out

    def _one(self, unit: str) -> tuple[bytes, bytes] | None:
        raw, b = unit if unit[0] == "\n" else f" {unit}", self.b.encode(unit)
        return self._checked(raw.encode(), self.a.encode_ordinary(raw), b[1:] if unit[0] == "\n" else b)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        return self.units.of(texts)


@lru_cache(2)
def both(byte_model: str | None = None, piece_model: str | None = None) -> Both:
    return Both(byte_model, piece_model)


def _written_groups(first: np.ndarray, second: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, n_groups: int) -> tuple[bytes, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups, and where each group's text ends."""
    n_a, n_b = np.bincount(label_a, minlength=n_groups), np.bincount(label_b, minlength=n_groups)
    stop = np.cumsum(n_a + n_b)
    start = stop - n_a - n_b
    at_a = np.arange(len(first)) + (np.cumsum(n_b) - n_b)[label_a]  # a group's A tokens come before its B tokens
    at_b = np.arange(len(second)) + np.cumsum(n_a)[label_b]
    ids, mark = np.empty(len(first) + len(second), np.int32), np.full(len(first) + len(second), ord(","), np.uint8)
    ids[at_a], ids[at_b] = first, second
    mark[start + n_a - 1], mark[stop - 1] = ord("|"), ord(";")
    width = len(str(int(ids.max(initial=0))))
    cells, shown = np.empty((len(ids), width + 1), np.uint8), np.ones((len(ids), width + 1), bool)
    for k in range(width):
        ten = 10 ** (width - 1 - k)
        cells[:, k] = ids // ten % 10 + ord("0")
        if ten > 1:
            shown[:, k] = ids >= ten
    cells[:, width] = mark
    ends = np.cumsum(shown.sum(1))
    return cells[shown].tobytes(), ends[stop - 1]


def _pairs(doc: np.ndarray, first: np.ndarray, second: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair code (``a << 32 | b``) and number of links of each different pair of each document, in order.

    Links are laid out for at most about ``LINKS`` at a time, whole tokens of A with all tokens of their group.
    """
    n_b = np.bincount(label_b, minlength=n_groups)
    first_b = np.cumsum(n_b) - n_b
    times = n_b[label_a]
    upto = np.cumsum(times)
    codes, kinds = np.unique(doc, return_inverse=True)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    start = 0
    while start < len(first):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + LINKS, "right")))
        t = times[start:stop]
        total = int(t.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(t) - t, t)
        b = second[np.repeat(first_b[label_a[start:stop]], t) + inner]
        pair = np.repeat(first[start:stop], t) << 32 | b
        different, inverse = np.unique(pair, return_inverse=True)
        key, count = np.unique(np.repeat(kinds[start:stop], t) * len(different) + inverse, return_counts=True)
        out.append((codes[key // len(different)], different[key % len(different)], count))
        start = stop
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, p, n = map(np.concatenate, zip(*out))
    if len(out) > 1:  # a document cut between two parts
        order = np.lexsort((p, d))
        d, p, n = d[order], p[order], n[order]
        new = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(p) != 0)])
        d, p, n = d[new], p[new], np.add.reduceat(n, new)
    return d, p, n


class Aligned:
    """A block of documents, aligned."""

    def __init__(self, coded: list[tuple[bytes, bytes]], a_sizes: np.ndarray, b_sizes: np.ndarray):
        first = np.frombuffer(b"".join(a for a, _ in coded), "<u4").astype(np.int64)
        second = np.frombuffer(b"".join(b for _, b in coded), "<u4").astype(np.int64)
        self.n_a = np.array([len(a) // 4 for a, _ in coded], np.int64)
        self.n_b = np.array([len(b) // 4 for _, b in coded], np.int64)
        end_a, end_b = np.cumsum(a_sizes[first]), np.cumsum(b_sizes[second])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        label_a, label_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        doc = np.repeat(np.arange(len(coded)), self.n_a)
        last = np.flatnonzero(np.r_[label_a[1:] != label_a[:-1], True][: len(label_a)])  # the last A token of each group
        self.n_groups = np.bincount(doc[last], minlength=len(coded))
        raw, ends = _written_groups(first, second, label_a, label_b, len(common)) if len(common) else (b"", np.zeros(0, np.int64))
        stops = np.r_[0, ends][np.cumsum(self.n_groups)]
        starts = np.r_[0, stops[:-1]]
        self.digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(starts.tolist(), stops.tolist(), strict=True)]
        self.doc, self.pair, self.times = _pairs(doc, first, second, label_a, label_b, len(common))
        self.n_links = np.bincount(self.doc, self.times, len(coded)).astype(np.int64)


BLOCK = (
    "block string, documents array<struct<id:{kind},n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,digest:string,n_pairs:bigint>>, "
    "place binary, times binary, pairs array<struct<a:bigint,b:bigint,n:bigint>>"
)


def blocks(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block of documents: its ``documents`` in order, the different ``pairs`` of ids linked in it with the number ``n``
    of its documents that hold them, and for each document's pairs their ``place`` in that list and their links (``times``)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], BLOCK.format(kind=kind)).schema
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = both(byte_model, piece_model), TaskContext.get().partitionId()
        for number, rows in enumerate(slices(batches, most=BLOCK_BYTES)):
            got = Aligned(coder.encode([text or "" for text in rows.column(1).to_pylist()]), coder.a_sizes, coder.b_sizes)
            pairs, place, n = np.unique(got.pair, return_inverse=True, return_counts=True)
            n_pairs = np.bincount(got.doc, minlength=rows.num_rows)
            fields = [rows.column(0), *(pa.array(x.astype(np.int64)) for x in (got.n_a, got.n_b, got.n_groups, got.n_links)), pa.array(got.digests, pa.string()), pa.array(n_pairs.astype(np.int64))]
            documents = pa.StructArray.from_arrays(fields, fields=list(shape.field("documents").type.value_type))
            listed = pa.StructArray.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n.astype(np.int64))], fields=list(shape.field("pairs").type.value_type))
            one = lambda x, k: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=shape.field(k).type)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{number}"]), one(documents, "documents"), pa.array([place.astype("<u4").tobytes()]), pa.array([got.times.astype("<u4").tobytes()]), one(listed, "pairs")],
                schema=shape,
            )

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).mapInArrow(run, schema)


def pair_counts(made: DataFrame) -> DataFrame:
    """``block, place, n, best``: for each pair of a block the documents that hold it in all blocks, and whether no pair of the
    same A id is held by more. Sums are made by pair and salt, then by pair, and go back the same way."""
    rows = made.select("block", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"), F.posexplode("pairs").alias("place", "p")).select("block", "salt", "place", "p.a", "p.b", "p.n")
    salted = rows.groupBy("a", "b", "salt").agg(F.sum("n").alias("n"))
    total = salted.groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))  # at most SALTS of them
    most = total.groupBy("a").agg(F.max("n").alias("most"))
    total = total.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"), F.explode("salts").alias("salt"))
    return rows.select("block", "place", "a", "b", "salt").join(total, ["a", "b", "salt"]).select("block", "place", "n", "best")


def align(docs: DataFrame, byte_model: str | None = None, piece_model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts links whose pair of ids is held by as many documents as any pair of the same A id; ``count_sum`` adds the
    documents that hold each link's pair. Rows with a null or empty text, or one that a tokenizer does not give back byte by
    byte, have zeros and ''. Every row is a document, also repeated ones and those without an id; an empty table gives no
    rows; other columns are not looked at. The blocks are written to the shared folder once, so their numbers hold.
    """
    made, _ = written(blocks(docs, byte_model, piece_model, id_col, text_col), "alignment")
    counts = pair_counts(made).groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("n"), F.collect_list("best").alias("best"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = made.select("block", "documents", "place", "times").join(counts, "block", "left").select("documents", "place", "times", "places", "n", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                documents = batch.column(0).slice(k, 1).flatten()
                place, times = (np.frombuffer(batch.column(c)[k].as_py(), "<u4").astype(np.int64) for c in (1, 2))
                order, n, best = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 5))
                count, top = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                count[order], top[order] = n, best
                bounds = np.r_[0, np.cumsum(documents.field("n_pairs").to_numpy())]
                add = lambda x: np.diff(np.r_[0, np.cumsum(x)][bounds])  # noqa: E731, B023
                names = ("id", "n_a", "n_b", "n_groups", "n_links")
                yield pa.RecordBatch.from_arrays(
                    [*(documents.field(x) for x in names), pa.array(add(times * top[place])), pa.array(add(times * count[place])), documents.field("digest")],
                    [id_col, *names[1:], "n_best", "count_sum", "groups_sha256"],
                )

    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(docs: DataFrame) -> DataFrame:
    return align(docs)
