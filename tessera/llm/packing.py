"""Packing of token streams into windows by order-preserving dynamic programming.

A partition's documents, in their order, form one stream of tokens. Windows may be cut behind a document, behind a
sentence or, where a sentence is longer than a window, after every full window of it. ``best[j]`` is the least cost
of a packing that ends at cut ``j``:

    best[j] = min over i of best[i] + padding(j - i) + penalty(j)

Padding of a window shorter than ``size`` is ``size - (j - i)``, none where its length is a power of two (it is then
stored at that length). As ``best[i] + size - j + i`` is least where ``best[i] + i`` is least, a monotone queue holds
the candidates of the last ``size`` tokens; the powers of two are looked up besides. Every cut costs O(1).

Streams are solved block by block (a block's last window is carried over), so memory does not grow with the
partition. The tokens left at the end of a partition are cut into powers of two and need no padding at all.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1024
END_ID = 0
SENTENCE_PENALTY = 2  # in tokens of padding
FORCED_PENALTY = 32
BLOCK_TOKENS = 1 << 18
LEAST_POWER = 64  # shorter windows are made at the end of a partition only
CACHE_BYTES = 32 << 20  # of remembered words and their ids
TOKENIZER = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"  # the tokenizer file's one special token; inside a text it stands for its id, as that file has it


class Tokens:
    """Byte-level BPE ids of whole texts. The ids equal those of the tokenizer file ``byte_bpe_50k.json``.

    Its pre-tokeniser never joins a blank that follows a non-blank to what stands before. So the text from one
    single space or line end to the next is encoded on its own and remembered (up to ``CACHE_BYTES``, then anew).
    Words not yet known are encoded together; the lengths of the tokens tell where each word ends. Texts with longer
    white space go through the encoder whole. A text is cut at the special token, whose id follows those of the ranks.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        path = vocabulary or public_tokenizers.path(f"{TOKENIZER}.tiktoken")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding(TOKENIZER, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = np.array([max(ranks.values()) + 1], "<u4")
        self.ends = np.zeros(max(ranks.values()) + 2, bool)  # tokens behind which a sentence may end
        self.sizes = np.zeros(len(self.ends), np.int64)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")
            self.sizes[i] = len(token)
        self.words: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, words: list[str]) -> None:
        texts = [w if w[0] == "\n" else " " + w for w in words]
        ids = self.encoding.encode_to_numpy("".join(texts), disallowed_special=()).astype("<u4")
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x.encode()) for x in texts])) + 1
        raw, start = ids.tobytes(), 0
        for word, stop in zip(words, (stops * 4).tolist(), strict=True):
            self.words[word] = raw[start:stop]
            self.held += 150 + len(word) + stop - start
            start = stop

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        parts = [text.split(SPECIAL) for text in texts]
        plain = iter(self._plain([x for part in parts for x in part]))
        out = []
        for part in parts:
            found = [next(plain)]
            for _ in part[1:]:
                found += [self.special, next(plain)]
            out.append(np.concatenate(found) if len(found) > 1 else found[0])
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        known = self.words
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        split = [f"\n{text}".replace("\n", " \n").split(" ")[1:] for text in texts]
        odd = {""}
        new = {w for words in split for w in {*words}.difference(known)} - odd
        odd.update(w for w in new if w[-1].isspace() or w[0].isspace() and (w[0] != "\n" or w[1:2].isspace()))
        if new := list(new - odd):
            self._learn(new)
        out = []
        for text, words in zip(texts, split, strict=True):
            if odd.isdisjoint(words):
                raw = b"".join(map(known.__getitem__, words))[4:]  # without the line end put in front
                out.append(np.frombuffer(raw, "<u4"))
            else:
                out.append(np.array(self.encoding.encode_ordinary(text), "<u4"))
        return out


@lru_cache(2)
def tokens(vocabulary: str | None = None) -> Tokens:
    return Tokens(vocabulary)


def cuts(lengths: list[int], sentence_ends: list[np.ndarray], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream of documents of these lengths may be cut, ascending from 0, and their penalties."""
    places, penalties, base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0
    for n, ends in zip(lengths, sentence_ends, strict=True):
        inner = ends[(ends > 0) & (ends < n)]
        here = np.append(inner, n)
        gaps = np.diff(here, prepend=0)
        cost = np.full(len(here), SENTENCE_PENALTY)
        cost[-1] = 0
        if (gaps > size).any():
            starts = here - gaps
            forced = [np.arange(a + size, b, size) for a, b in zip(starts[gaps > size], here[gaps > size], strict=True)]
            here = np.concatenate([here, *forced])
            cost = np.concatenate([cost, np.full(len(here) - len(cost), FORCED_PENALTY)])
            order = np.argsort(here, kind="stable")
            here, cost = here[order], cost[order]
        places.append(here + base)
        penalties.append(cost)
        base += n
    return np.concatenate(places), np.concatenate(penalties)


def best_windows(places: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices into ``places`` of the cheapest chain of cuts from the first to the last place."""
    at, cost = places.tolist(), penalties.tolist()
    full: dict[int, list[int]] = {}  # cut -> the cuts a power of two before it
    for p in (1 << k for k in range(LEAST_POWER.bit_length() - 1, size.bit_length()) if 1 << k <= size):
        q = np.searchsorted(places, places - p)
        for j in np.flatnonzero(places[q] == places - p).tolist():
            full.setdefault(j, []).append(int(q[j]))
    last = len(at)
    best, back, level = [0] * last, [0] * last, [0] * last  # level[i]: best[i] + at[i]
    queue: deque[int] = deque([0])
    get, pop, push = full.get, queue.pop, queue.append
    for j in range(1, last):
        here = at[j]
        low = here - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        value = level[i] + size - here
        for q in get(j, ()):
            if best[q] < value:
                value, i = best[q], q
        best[j] = value = value + cost[j]
        back[j] = i
        level[j] = mine = value + here
        while queue and level[queue[-1]] >= mine:
            pop()
        push(j)
    chain, j = [last - 1], last - 1
    while j:
        j = back[j]
        chain.append(j)
    return chain[::-1]


def powers_of_two(n: int, size: int = SIZE) -> list[int]:
    """Lengths that add up to ``n``: full windows, then falling powers of two."""
    return [size] * (n // size) + [1 << k for k in range(size.bit_length() - 1, -1, -1) if (n % size) >> k & 1]


class Packer:
    """Packs a stream of ``(doc_id, ids)``; yields ``(doc_id, start, ids, doc_tokens, sequence, offset)``."""

    def __init__(self, first_sequence: int = 0, size: int = SIZE):
        self.size, self.sequence = size, first_sequence
        self.open: list[tuple[object, int, np.ndarray, np.ndarray, int]] = []  # id, start, ids left, sentence ends, tokens of the document
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.open.append((doc_id, 0, ids, ends, len(ids)))
        self.tokens += len(ids)
        if self.tokens >= BLOCK_TOKENS:
            places, penalties = cuts([len(x[2]) for x in self.open], [x[3] for x in self.open], self.size)
            chain = places[best_windows(places, penalties, self.size)]
            yield from self._emit(np.diff(chain)[:-1])

    def close(self) -> Iterator[tuple]:
        places, penalties = cuts([len(x[2]) for x in self.open], [x[3] for x in self.open], self.size)
        windows = np.diff(places[best_windows(places, penalties, self.size)]).tolist() if self.tokens else []
        lengths = [w for w in windows[:-1]] + powers_of_two(windows[-1], self.size) if windows else []
        yield from self._emit(lengths)

    def _emit(self, lengths) -> Iterator[tuple]:
        k = used = 0
        for length in lengths:
            offset = 0
            while offset < length:
                doc_id, start, ids, ends, total = self.open[k]
                take = min(length - offset, len(ids) - used)
                yield doc_id, start + used, ids[used : used + take], total, self.sequence, offset
                offset += take
                used += take
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        rest = self.open[k:]
        if used:
            doc_id, start, ids, ends, total = rest[0]
            rest[0] = (doc_id, start + used, ids[used:], ends[ends > used] - used, total)
        self.open, self.tokens = rest, sum(len(x[2]) for x in rest)


COLUMNS = "start long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed documents: ``doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset``.

    A document is its ids and then ``END_ID``; a null or empty text is ``END_ID`` alone. Each partition of the input
    packs its own rows in their order, without a shuffle; its number is in the upper bits of ``sequence_id``, so a
    task that is run again gives the same rows. Null ids and repeated rows are packed like any others.
    """
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, size)
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            a, b, c, d, e, f = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, arrow_id), pa.array(b, pa.int64()), pa.array([x.tobytes() for x in c], pa.binary()), *(pa.array(x, pa.int64()) for x in (d, e, f))],
                ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    encoded = coder.ids([text or "" for text in part.column(1).to_pylist()])
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoded, strict=True):
                        ids = np.append(ids, np.uint32(END_ID))
                        yield from packer.add(doc_id, ids, np.flatnonzero(coder.ends[ids[:-1]]) + 1)
            yield from packer.close()

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_id = to_arrow_type(id_type)
        for piece in pieces():
            out.append(piece)
            held += len(piece[2])
            if held > 1 << 20 or len(out) >= 10_000:
                yield batch()
                out.clear()
                held = 0
        if out:
            yield batch()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, {COLUMNS}")


def op3_packing(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
