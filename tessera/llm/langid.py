"""Language identification: scripts narrow the candidates, Viterbi over words labels the spans.

A word's score for a language is the log likelihood of its byte trigrams (of the lower-cased word and the bytes
beside it), hashed into ``SLOTS`` slots and learned from a bounded sample of labelled texts. Languages not seen with
a word's script (by Unicode range) are ruled out where another one was. The path of labels with the best sum of word scores, less
``SWITCH`` for each change of language, gives the spans of a text; the language with most letters is the text's.

Most texts are in one language. Let ``g`` be the most that any run of words gains under another language than the
best single one; if ``g <= SWITCH / 2`` no path with a change can be better, and the search is skipped (exactly).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fitted, id_bucket, sample_by

SLOTS = 1 << 16
SWITCH = 14.0
FIT_ROWS, FIT_CHARS, FIT_LANGS = 400, 20_000, 256  # bound of the sample: rows of a language, first characters of a row, languages (those with most rows)
RULED_OUT = -40.0

_LETTER = np.array([chr(i).isalpha() or i >= 128 for i in range(128)] + [True] * 128)
# Where the Unicode ranges of a script begin; "" is what belongs to none.
SCRIPT_RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0800, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Canadian"), (0x1680, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1C90, "Georgian"), (0x1CC0, ""), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, ""),
    (0x2C00, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2D00, "Georgian"), (0x2D30, ""), (0x2DE0, "Cyrillic"), (0x2E00, ""), (0x2E80, "Han"), (0x3000, ""), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0xA000, "Yi"), (0xA4D0, ""), (0xA640, "Cyrillic"), (0xA6A0, ""),
    (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"),
    (0xFF00, ""), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, ""), (0x20000, "Han"), (0x32000, ""),
)
SCRIPTS = ("", *sorted({name for _, name in SCRIPT_RANGES if name}))
_STARTS = np.array([start for start, _ in SCRIPT_RANGES])
_NUMBERS = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.int8)
_LATIN = SCRIPTS.index("Latin")


def script_of(raw: np.ndarray) -> np.ndarray:
    """Script (its place in ``SCRIPTS``) of the letter that begins at each byte; 0 inside a letter and for what is none."""
    out = np.where(_LETTER[raw] & (raw < 128), np.int8(_LATIN), np.int8(0))
    at = np.flatnonzero(raw >= 0xC0)
    if len(at):
        wide = np.append(raw, np.zeros(3, np.uint8)).astype(np.int32)
        lead, b, c, d = wide[at], wide[at + 1] & 63, wide[at + 2] & 63, wide[at + 3] & 63
        point = np.where(lead < 0xE0, (lead & 31) << 6 | b, np.where(lead < 0xF0, (lead & 15) << 12 | b << 6 | c, (lead & 7) << 18 | b << 12 | c << 6 | d))
        out[at] = _NUMBERS[np.searchsorted(_STARTS, point, "right") - 1]
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (SLOTS, languages) log likelihood
    scripts: np.ndarray  # (scripts, languages) seen with the script


def lower_same(text: str) -> str:
    """Lower-cased without any change of length, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _trigrams(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    return (x[:-2] * 40503 + x[1:-1] * 30011 + x[2:] * 2777 ^ x[1:-1] << 7) & (SLOTS - 1)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of each run of letters; ``raw`` begins and ends with a blank."""
    edge = np.diff(_LETTER[raw].astype(np.int8))
    return np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(b" " + lower_same(text).encode("utf-8", "replace") + b" ", np.uint8)


def fit(texts: list[str], labels: list[str]) -> Model:
    langs = sorted({*labels})
    counts, scripts = np.zeros((SLOTS, len(langs))), np.zeros((len(SCRIPTS), len(langs)))
    for text, label in zip(texts, labels, strict=True):
        raw, k = _bytes(text), langs.index(label)
        code = _trigrams(raw)
        inside = _LETTER[raw[1:-1]]
        counts[:, k] += np.bincount(code[inside], minlength=SLOTS)
        scripts[1:, k] += np.bincount(script_of(raw), minlength=len(SCRIPTS))[1:]
    p = (counts + 0.02) / (counts.sum(0) + 0.02 * SLOTS)
    return Model(langs, np.log(p).astype(np.float32), scripts > 0.01 * np.maximum(scripts.sum(0), 1))


def word_scores(model: Model, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _words(raw)
    if not len(starts):
        return starts, ends, np.zeros((0, len(model.langs)))
    code = _trigrams(raw)  # the trigram around byte i is at i - 1
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[::2], bounds[1::2] = starts - 1, np.minimum(ends - 1, len(code) - 1)
    scores = np.add.reduceat(model.table[code], bounds, axis=0)[::2].astype(np.float64)
    if not model.scripts[_LATIN].all() or raw.max() >= 0xCD:  # else all letters are Latin and rule nothing out
        kind = np.maximum.reduceat(script_of(raw), np.stack([starts, ends], 1).ravel())[::2]
        for s in np.unique(kind[kind > 0]):
            allowed = model.scripts[s]
            if allowed.any():
                scores[np.ix_(kind == s, ~allowed)] += RULED_OUT
    return starts, ends, scores


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word on the best path."""
    n, k = scores.shape
    top = int(scores.sum(0).argmax())
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    gain = np.cumsum(np.vstack([np.zeros(k), scores - scores[:, [top]]]), axis=0)
    if (gain - np.minimum.accumulate(gain, axis=0)).max() <= switch / 2:
        return np.full(n, top)
    state, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        lead = max(range(k), key=state.__getitem__)
        least = state[lead] - switch
        back.append([j if state[j] >= least else lead for j in range(k)])
        state = [max(s, least) + r for s, r in zip(state, row)]
    path = [max(range(k), key=state.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1])


def identify(model: Model, text: str | None) -> tuple[str, float, list[tuple[str, int, int]]]:
    """(language, score, spans (language, start, end) in code points)."""
    if not text or not model.langs:
        return "und", 0.0, []
    raw = _bytes(text)
    starts, ends, scores = word_scores(model, raw)
    if not len(starts) or not any(c.isalpha() for c in text):
        return "und", 0.0, []
    path = best_path(scores)
    weight = np.bincount(path, ends - starts, len(model.langs))
    best = int(weight.argmax())
    total = scores[path == best].sum(0)
    margin = total[best] - np.delete(total, best).max() if len(model.langs) > 1 else 50.0
    score = weight[best] / weight.sum() / (1 + np.exp(-np.clip(margin, -50, 50)))
    turns = np.flatnonzero(np.diff(path, prepend=-1))
    if len(turns) == 1:
        spans = [(model.langs[path[0]], 0, len(text))]
    else:
        body = raw[1:-1]
        point = np.cumsum((body & 0xC0) != 0x80) - 1  # code point of each byte
        at = [0, *point[starts[turns[1:]] - 1].tolist(), len(text)]
        spans = [(model.langs[path[t]], a, b) for t, a, b in zip(turns, at, at[1:])]
    return model.langs[best], float(score), spans


def train(docs: DataFrame, learn: Column | None = None) -> Model:
    """Fit on a bounded sample of the rows with a language (``FIT_*``, see ``sample_by``); null and empty texts teach nothing."""
    rows = docs.where("lang is not null")
    if learn is not None:
        rows = rows.where(learn)
    got = sample_by(rows, "lang", FIT_ROWS, FIT_CHARS, FIT_LANGS)
    return fitted(got.coalesce(1).orderBy("lang", "text"), fit)


SPAN = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


def identifier(model: Model):
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                lang, score, spans = identify(model, text)
                out.append({"lang_pred": lang, "score": score, "spans": [{"lang": k, "start": a, "end": b} for k, a, b in spans]})
            yield pa.array(out, _ARROW)

    return run


def identify_languages(docs: DataFrame, learn: Column | None = None, name: str = "language") -> DataFrame:
    """``docs`` and a column ``name`` (lang_pred, score, spans), in place of one of that name. Null texts and texts without a letter are ``und`` with score 0;
    so is everything where no labelled text is known. Rows are treated one by one: repeated rows and null ids stay."""
    return docs.withColumn(name, identifier(train(docs, learn))("text"))


def op1_langid(docs: DataFrame) -> DataFrame:
    learn = id_bucket("doc_id", 4) != 2
    return identify_languages(docs, learn).select("doc_id", (~learn).alias("held_out"), "language.lang_pred", "language.score", F.size("language.spans").alias("n_spans"))
