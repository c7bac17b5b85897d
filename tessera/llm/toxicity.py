"""Toxic spans and document scores from a linear-chain conditional random field over words.

Labels exist for documents, so word labels are derived first: in a document labelled toxic, the words that are far
more frequent in toxic than in other texts (log-likelihood ratio and smoothed log odds, in several different contexts, so that
copies of one text do not count again) are toxic tokens; all other words are not. Beginnings of words are tested in the
same way as whole words, so that an inflected or compound form that no label has shown is still known by its stem. The
field has two tags, one weight per known word or beginning, a bias and four transition weights, trained by gradient
ascent on the exact log likelihood.

A word the field has no weight for has the same potentials everywhere. Between known words the chain is therefore a
power of one 2x2 matrix, taken in closed form; forward-backward visits known words only and is still exact for
the whole text. The score of a document is a logistic function, fitted on the training documents, of the expected
number of toxic words (the sum of marginals) and, where there is one, of the length: two in a line are more than two in a book.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fitted, free_name, id_bucket, ordered_sample, table

THRESHOLD = 0.7
FIT_TOXIC, FIT_OTHER, FIT_CHARS = 2000, 4000, 20_000  # bound of the training sample: rows of either label, length of a row
FIT_WINDOWS = 64  # of a sample row, so many of its windows around known words, evenly spread, train the field
LEAST_CONTEXTS, LEAST_G, LEAST_ODDS = 4, 23.0, 1.5  # a log-likelihood ratio of 23 is passed by chance once in a million
BEGINNINGS = (4, 5, 6, 7)  # lengths of the beginnings of longer words that are features besides the word
CACHE_WORDS = 1 << 17
SLICE = 256  # texts held as strings at a time
STEPS, RATE, RIDGE = 120, 0.2, 0.02
_WIDTH, _PIECE = 17, 8192  # words of a training window, windows of a step of the gradient
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Model:
    """Weights of the field (tag 0: other, tag 1: toxic) and of the document's logistic function."""

    words: dict[str, int] = field(default_factory=dict)  # feature (see ``features``) -> the place of its weight
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -6.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -3.0]))  # see ``evidence``


def lowered(text: str | None) -> str:
    """Lower-cased without a change of length: the dotted capital I is the only character that would grow."""
    return (text or "").replace("\u0130", "i").lower()


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text))


def features(word: str) -> list[str]:
    """The word itself and, marked with a star, its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


class Scores(dict):
    """Word -> sum of its features' weights, 0 (the integer) for a word without any; filled as words come."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        known = [self.model.weights[k] for f in features(word) if (k := self.model.words.get(f)) is not None]
        self[word] = out = float(sum(known)) or 1e-9 if known else 0
        return out


def _powers(model: Model):
    """n -> M^n for the step matrix over a word without a weight, scaled by its larger eigenvalue."""
    step = np.exp(model.transitions + np.array([0.0, model.bias]))
    values, vectors = np.linalg.eig(step)
    values, vectors = values.real, vectors.real
    ratio, inverse = values / values.max(), np.linalg.inv(vectors)
    known: dict[int, np.ndarray] = {}

    def power(n: int) -> np.ndarray:
        if n not in known:
            if len(known) > 10_000:
                known.clear()
            known[n] = (vectors * ratio**n) @ inverse
        return known[n]

    return power


def marginals(model: Model, places: list[int], scores: list[float], length: int, power=None) -> np.ndarray:
    """P(toxic) of the words at ``places`` (ascending) of a text of ``length`` words, given their weights."""
    power = power or _powers(model)
    moves = np.exp(model.transitions)
    emit = [np.array([1.0, np.exp(model.bias + s)]) for s in scores]
    ahead: list[np.ndarray] = []
    state = None
    for k, place in enumerate(places):
        if state is None:
            v = np.array([1.0, np.exp(model.bias)]) @ power(place - 1) @ moves if place else np.ones(2)  # no transition leads into the first word
        else:
            v = state @ power(place - places[k - 1] - 1) @ moves
        state = v * emit[k]
        state = state / state.sum()
        ahead.append(state)
    after, out = np.ones(2), np.zeros(len(places))
    gap = length - 1 - places[-1] if places else 0
    for k in range(len(places) - 1, -1, -1):
        after = power(gap) @ after
        both = ahead[k] * after
        out[k] = both[1] / both.sum()
        after = moves @ (emit[k] * after)
        after = after / after.sum()
        gap = places[k] - places[k - 1] - 1 if k else 0
    return np.clip(out, 0.0, 1.0)


def expected(model: Model, words: list[str], power=None, scores: Scores | None = None) -> tuple[float, list[int], np.ndarray]:
    """Expected number of toxic words, the places of known words, and their marginals."""
    scores = Scores(model) if scores is None else scores
    each = list(map(scores.__getitem__, words))
    if not any(each):
        return 0.0, [], np.zeros(0)
    places = [i for i, x in enumerate(each) if x]
    p = marginals(model, places, [each[i] for i in places], len(words), power)
    return float(p.sum()), places, p


def evidence(mass: float, length: int) -> tuple[float, float, float]:
    """What the document's logistic function sees: expected toxic words, the length as far as there are any, 1."""
    return float(np.log1p(20 * mass)), float(np.log1p(length) * min(1.0, mass)), 1.0


def score_of(model: Model, mass: float, length: int) -> float:
    return float(1 / (1 + np.exp(-np.dot(model.logistic, evidence(mass, length)))))


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _lexicon(vocabulary: list[str], texts: list[np.ndarray], labels: list[int]) -> list[str]:
    """Features that speak for a toxic text: enough different contexts there, a significant log-likelihood ratio.

    Texts are the places of their words in the vocabulary. Of each word's features that pass only the most significant is kept.
    """
    other = np.zeros(len(vocabulary), np.int64)
    contexts, middles = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]  # of toxic texts
    n1 = n0 = 0
    for words, label in zip(texts, labels, strict=True):
        if label:
            n1 += len(words)
            around = np.concatenate([[0], words + 1, [0]]).astype(np.uint64)
            contexts.append(around[:-2] * _A ^ around[1:-1] * _B ^ around[2:] * _C)
            middles.append(words)
        else:
            n0 += len(words)
            other += np.bincount(words, minlength=len(vocabulary))
    if not (n0 and n1):
        return []
    once = np.unique(np.concatenate(contexts), return_index=True)[1]
    toxic = np.bincount(np.concatenate(middles)[once], minlength=len(vocabulary))
    y1: Counter = Counter()
    y0: Counter = Counter()
    known = np.flatnonzero(toxic).tolist()
    for k in known:
        for f in features(vocabulary[k]):
            y1[f] += int(toxic[k])
    for k in np.flatnonzero(other).tolist():
        for f in features(vocabulary[k]):
            if f in y1:
                y0[f] += int(other[k])

    share = n1 / (n1 + n0)

    def strength(f: str) -> float:
        a, b = y1[f], y0[f]
        if a < LEAST_CONTEXTS:
            return 0.0
        g = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
        return float(g) if odds > LEAST_ODDS and g > LEAST_G else 0.0

    found = {max((strength(f), f) for f in features(vocabulary[k])) for k in known}
    return sorted(f for value, f in found if value)


def fit(texts: list[str], labels: list[int]) -> Model:
    """Train on whole texts and their labels (1: toxic); without both labels the model knows the base rate only."""
    number: dict[str, int] = {}
    split = [np.fromiter((number.setdefault(w, len(number)) for w in tokens(t)), np.int32) for t in texts]
    vocabulary = list(number)
    number.clear()
    model = Model()
    rate = (sum(labels) + 0.5) / (len(labels) + 1) if labels else 0.05
    model.logistic = np.array([0.0, 0.0, np.log(rate / (1 - rate))])
    lexicon = _lexicon(vocabulary, split, labels)
    if not lexicon:
        return model
    model.words, model.weights = {w: i for i, w in enumerate(lexicon)}, np.zeros(len(lexicon))
    known = np.full((len(vocabulary) + 1, len(BEGINNINGS) + 1), -1, np.int32)
    for k, w in enumerate(vocabulary):
        own = [j for f in features(w) if (j := model.words.get(f)) is not None]
        known[k, : len(own)] = own
    known[-1] = -2
    ids, gold = _windows(known, split, labels)
    step = np.zeros(len(lexicon) + 5)
    step[-5] = -4.0
    moment, square = np.zeros_like(step), np.zeros_like(step)
    for turn in range(1, STEPS + 1):
        found = sum(_gradient(step, ids[at : at + _PIECE], gold[at : at + _PIECE]) for at in range(0, len(ids), _PIECE))
        gradient = found / len(ids) * 10 - RIDGE * step * (np.arange(len(step)) < len(lexicon)) / 10
        moment, square = 0.9 * moment + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        step = step + RATE * (moment / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    model.weights, model.bias, model.transitions = step[: len(lexicon)], float(step[-5]), step[-4:].reshape(2, 2)
    power = _powers(model)
    weight = np.append(model.weights, 0.0)[np.maximum(known[:-1], -1)].sum(1)  # of each word; place -1 is the 0 behind the weights
    mass = []
    for words in split:
        places = np.flatnonzero(known[words, 0] >= 0)
        mass.append(float(marginals(model, places.tolist(), weight[words[places]].tolist(), len(words), power).sum()) if len(places) else 0.0)
    x = np.array([evidence(m, len(w)) for m, w in zip(mass, split)])
    y, fitted_ = np.array(labels, float), model.logistic + [1.0, 0.0, 0.0]
    for _ in range(50):  # Newton steps of the logistic function, lightly damped
        p = 1 / (1 + np.exp(-x @ fitted_))
        damping = np.array([0.1, 0.1, 0.01])
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(damping), x.T @ (y - p) - damping * fitted_)
        fitted_ = fitted_ + np.clip(step, -1, 1)
    model.logistic = fitted_
    return model


def _windows(known: np.ndarray, split: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(features of the words of each window, their tags): windows around known words, up to ``FIT_WINDOWS`` spread over
    a text, or one in the middle of a text without any. In the features -1 is none, -2 (the last row of ``known``) no word."""
    ids, gold, none = [], [], len(known) - 1
    for words, label in zip(split, labels, strict=True):
        hits = np.flatnonzero(known[words, 0] >= 0)
        if len(hits) > FIT_WINDOWS:
            hits = hits[np.linspace(0, len(hits) - 1, FIT_WINDOWS).astype(np.int64)]
        elif not len(hits):
            hits = np.array([len(words) // 2])
        places = np.maximum(hits - _WIDTH // 2, 0)[:, None] + np.arange(_WIDTH)
        inside = places < np.minimum(hits + _WIDTH // 2 + 1, len(words))[:, None]
        part = known[np.where(inside, np.append(words, none)[np.minimum(places, len(words))], none)]
        ids.append(part)
        gold.append((part[..., 0] >= 0) & bool(label))
    return np.concatenate(ids), np.concatenate(gold)


def _gradient(theta: np.ndarray, ids: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """Observed minus expected features of all windows: word weights, bias, transitions."""
    n, width, most = ids.shape
    inside = ids[..., 0] > -2
    weights = np.append(theta[:-5], 0.0)
    word = np.where(ids >= 0, ids, len(weights) - 1)
    emit = np.ones((n, width, 2))
    emit[..., 1] = np.exp(theta[-5] + weights[word].sum(2))
    moves = np.exp(theta[-4:].reshape(2, 2))
    a, b = np.zeros((n, width, 2)), np.ones((n, width, 2))
    a[:, 0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        v = (a[:, t - 1] @ moves) * emit[:, t]
        a[:, t] = np.where(inside[:, t, None], v / v.sum(1, keepdims=True), a[:, t - 1])
    for t in range(width - 2, -1, -1):
        v = (b[:, t + 1] * emit[:, t + 1]) @ moves.T
        b[:, t] = np.where(inside[:, t + 1, None], v / v.sum(1, keepdims=True), 1.0)
    p = a * b
    p = p[..., 1] / p.sum(2)
    rest = (gold - p) * inside
    out = np.zeros_like(theta)
    out[:-5] = np.bincount(word.ravel(), np.repeat(rest.ravel(), most), len(weights))[:-1]
    out[-5] = rest.sum()
    pair = a[:, :-1, :, None] * moves * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    both = inside[:, 1:]
    seen = np.zeros((2, 2))
    for x in range(2):
        for y in range(2):
            seen[x, y] = ((gold[:, :-1] == x) & (gold[:, 1:] == y) & both).sum()
    out[-4:] = (seen - (pair * both[..., None, None]).sum((0, 1))).ravel()
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``learn`` holds (see ``FIT_*``); labels join on ``doc_id``.

    The sample is the rows with the smallest hashes of their texts, each text once. Null texts, null labels and texts of
    more than ``FIT_CHARS`` characters are not trained on.
    """
    known = labels.select("doc_id", F.col("toxic").alias("_label")).where("_label is not null").groupBy("doc_id").agg(F.max("_label").alias("_label"))
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, FIT_CHARS))
    if learn is not None:
        rows = rows.where(learn)
    # ids and hashes decide which rows are in the sample before any text is moved
    small = rows.select("doc_id", F.xxhash64("text").alias("_hash")).join(known, "doc_id").groupBy("_hash").agg(F.min(F.struct("doc_id", "_label")).alias("m"))
    small = small.select("_hash", "m.doc_id", "m._label")
    picked = [ordered_sample(small.where(F.col("_label") == y), F.struct("_hash", "doc_id"), n) for y, n in ((1, FIT_TOXIC), (0, FIT_OTHER))]
    chosen = picked[0].union(picked[1])
    got = rows.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("_hash"))
    got = got.groupBy("_hash").agg(F.min("text").alias("text"), F.max("_label").cast("int").alias("_label"))
    return fitted(got.coalesce(1).orderBy("_hash").select("text", "_label"), fit)


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def scorer(model: Model):
    """Column function: text -> struct of the document's score and its toxic spans (code points, end exclusive)."""

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        power, scores = _powers(model), Scores(model)
        for texts in batches:
            out = []
            for text in (t for at in range(0, len(texts), SLICE) for t in texts.slice(at, SLICE).to_pylist()):
                lower = lowered(text)
                words = _WORD.findall(lower)
                mass, places, p = expected(model, words, power, scores)
                spans = []
                if places:
                    hot = {i: float(x) for i, x in zip(places, p, strict=True) if x > 0.5}
                    spans = [{"start": m.start(), "end": m.end(), "p": hot[i]} for i, m in enumerate(_WORD.finditer(lower)) if i in hot] if hot else []
                out.append({"score": score_of(model, mass, len(words)), "spans": spans})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))]))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column | None = None, name: str = "toxicity") -> DataFrame:
    """``docs`` and a column ``name`` (score, spans), in place of one of that name. Null and empty texts get the score of a
    text without known words; rows are scored one by one, so repeated rows and null ids stay."""
    return docs.withColumn(name, scorer(train(docs, labels, learn))("text"))


def learnable() -> Column:
    return id_bucket("doc_id", 3) != 1


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that score ``THRESHOLD`` or more; all its columns stay as they are, whatever their names."""
    name = free_name(docs, "toxicity")
    return score_documents(docs, labels, learnable(), name).where(F.col(f"{name}.score") < THRESHOLD).select(docs.columns)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, table(spark, sf_dir, "labels"), learnable())
    return scored.select(
        "doc_id", (~learnable()).alias("held_out"), F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("toxicity.spans").alias("n_spans"),
    )
