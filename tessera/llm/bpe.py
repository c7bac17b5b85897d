"""Byte-level BPE by backtracking over longest matches; ids are those of the merges, in time linear in the text.

Each match of the pattern is a piece. Bytes are mapped to the first 256 code points (Latin-1), so that a string automaton
over the vocabulary finds, in one pass, the longest token at every place. A sequence of tokens is what the merges give
exactly if each two neighbours are: if merging the bytes of both gives these two again. That is asked of each pair of
tokens once and remembered. So a piece is read from left to right with the longest token at each place; where it does
not agree with the one before it, its next shorter prefix is tried; where none is left, the place is marked as dead and the
reading goes back by one token. The tokens before a place are the only ones that agree (a prefix has one encoding), so a place
once dead stays so, and every place is left at most once for each token that begins there.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name
from tessera.llm.units import Units

TOKENIZER = "byte_bpe_50k.tiktoken"
BATCH_BYTES = 4 << 20  # of texts encoded together
PAIRS = 1 << 19  # of remembered pairs of tokens
NONE = 1 << 60  # above all ranks


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of lines of base64 text and rank."""
    import public_tokenizers

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path or public_tokenizers.path(TOKENIZER)).read_bytes().splitlines())}


class Coder:
    """Encodes and decodes with a table of ranks. All 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import public_tokenizers

        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.size, self.shorter = [0] * (max(ranks.values()) + 1), [-1] * (max(ranks.values()) + 1)  # shorter: the next token that is a prefix
        for token, i in ranks.items():
            self.size[i] = len(token)
            self.shorter[i] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, i))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.agreed: dict[int, bool] = {}
        lead = len(self.encode_whole("\n"))
        self.units = Units(self._learn, self.encode_whole, lambda forms: b"".join(forms)[lead:], "\n")  # without the line end put in front

    def merged(self, raw: bytes) -> list[int]:
        """The definition: of all neighbours the pair whose union has the lowest rank is merged, the first on ties, till none is a token."""
        rank = self.ranks.get
        parts = [raw[k : k + 1] for k in range(len(raw))]
        ranks = [rank(a + b, NONE) for a, b in pairwise(parts)]
        while ranks and (least := min(ranks)) < NONE:
            k = ranks.index(least)
            parts[k] += parts.pop(k + 1)
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], NONE)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], NONE)
        return [self.ranks[x] for x in parts]

    def agree(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` can stand side by side in what the merges give."""
        key = a << 32 | b
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            found = self.agreed[key] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece that is not empty."""
        n = len(raw)
        longest = [0] * n
        for end, (back, i) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - back] = i  # ends ascend, so the longest is written last
        dead = bytearray(n + 1)
        size, shorter, agreed = self.size, self.shorter, self.agreed.get
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            end = at + size[token]
            if not dead[end]:
                good = before < 0 or agreed(before << 32 | token)
                if good is None:
                    good = self.agree(before, token)
                if good:
                    out.append(token)
                    if end == n:
                        return out
                    before, at, token = token, end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
                token = shorter[token]

    def encode_whole(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces(text):
            raw = piece.encode()
            i = self.ranks.get(raw)
            if i is None:
                out += self.encode_piece(raw)
            else:
                out.append(i)
        return array("I", out).tobytes()

    def _learn(self, units: list[str]) -> list[bytes]:
        encode = self.encode_whole
        return [encode(u if u[0] == "\n" else f" {u}") for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as unsigned 32-bit integers."""
        return self.units.of(texts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary is an error."""
        return joined(self.bytes_of, ids)


def joined(bytes_of: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join(map(bytes_of.__getitem__, array("I", ids)))


@lru_cache(2)
def coder(vocabulary: str | None = None) -> Coder:
    """One coder for each vocabulary file and Python worker."""
    return Coder(read_ranks(vocabulary))


@lru_cache(2)
def bytes_by_id(vocabulary: str | None = None) -> dict[int, bytes]:
    """All that decoding needs: its Python workers are not those that encode, and hold no automaton."""
    return {i: token for token, i in read_ranks(vocabulary).items()}


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows cut into parts of about ``most`` bytes of a column (text or bytes), one row at least."""
    for batch in batches:
        start = held = 0
        for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            held += size or 0
            if held >= most:
                yield batch.slice(start, k + 1 - start)
                start, held = k + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids`` (little-endian unsigned 32-bit integers) of every row, by the ranks in ``vocabulary``; no special tokens.

    A null or empty text has no ids (empty bytes). Rows stand for themselves: null ids, repeated rows and ids are kept as
    they are, an empty table gives none; other columns, whatever their names, are not looked at. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for part in slices(batches):
            ids = own.encode([text or "" for text in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` and the bytes (``into``, with underscores before it where that name is taken) that its ids stand for; null
    ids give null, empty ones empty bytes. All rows and columns stay as they are."""

    @F.pandas_udf("binary")
    def back(ids):
        known = bytes_by_id(vocabulary)
        return ids.map(lambda x: joined(known, x), na_action="ignore")

    return encoded.withColumn(free_name(encoded, into), back(F.col(ids_col)))


def op12_bpe(docs: DataFrame) -> DataFrame:
    """Digests of the ids of every whole text and of the bytes that they decode to."""
    both = decode(encode(docs))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
