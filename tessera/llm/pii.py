"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

The patterns give the base spans (e-mail, IP address, card and telephone numbers). The field's units are the base
spans, whose labels are given, and all other words with a digit or an @. Neighbouring units are linked as in a
linear chain; besides, units with the same key (the last digits of a number, the local part of an address), however
far apart, are linked to the next such unit by a skip edge that favours equal labels, and units whose keys differ by a
character or two by another. Loopy belief propagation over all edges gives each unit's marginals, so that a number written again without
its prefix or with a slip, or a user name without its host, gets the label that it has elsewhere in the document.

The weights of units, chain and skip edges are trained together on a bounded sample with the base spans as labels (``fit``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fitted, sample_texts

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS, FIT_CHARS = 2000, 20_000
ROUNDS, SURE = 20, 0.5
STEPS, RATE, RIDGE = 400, 2.0, 2e-4
LEAST_DIGITS = 7

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_UNIT = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_MARK = re.compile("[0-9@]")
_ANY = re.compile(r"\S+")
LEAST_NAME = 5
_EDGE = ".,;:!?()[]{}<>\"'*#$%&|"
_DIGITS = re.compile("[0-9]")
_JOINTS = re.compile(r"[._%+-]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the full pattern finds them: the local part reaches back from each @, at most to the last match."""
    done = 0
    for m in _HOST.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def names_of(text: str, base: list[tuple[int, int, int]]) -> set[str]:
    """Local parts of the e-mail addresses among the base spans, long enough to be a key."""
    found = {text[a:b].split("@")[0].lower() for k, a, b in base if k == 0}
    own = {n for n in found if len(n) >= LEAST_NAME and any(c.isalpha() for c in n) and not n.isalpha()}  # a plain word is no name
    return own | {x for n in own if len(x := _JOINTS.sub("", n)) >= LEAST_NAME}


def units(text: str, base: list[tuple[int, int, int]], names: set[str] | frozenset = frozenset()) -> list[tuple[int, int, int]]:
    """(label, start, end) in order of start: base spans (1 + kind) and other words (0, unknown) with a digit or an @, or in ``names``."""
    taken = sorted((a, b) for _, a, b in base)
    out = [(1 + k, a, b) for k, a, b in base]
    at = 0
    for m in (_ANY if names else _UNIT).finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue  # a base span is (a part of) this word
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
        if a < b and (_MARK.search(word) or text[a:b].lower() in names):
            out.append((0, a, b))
    return sorted(out, key=lambda u: (u[1], u[2], u[0]))


def key(word: str, names: set[str] | frozenset = frozenset()) -> str:
    """What repeated units share: the local part of an address or the user name (also behind an @) without dots and dashes, else
    the last digits of a number."""
    if "@" in word or any(c.isalpha() for c in word):
        local = word.lstrip("@").split("@")[0].lower()
        named = local in names or any(c.isdigit() for c in local)
        return _JOINTS.sub("", local) if len(local) >= LEAST_NAME and (named or word[:1] == "@") and any(c.isalpha() for c in local) else ""
    digits = "".join(_DIGITS.findall(word))
    return digits[-9:] if len(digits) >= LEAST_DIGITS else ""


def features(word: str) -> list[float]:
    digits, letters = "".join(_DIGITS.findall(word)), sum(c.isalpha() for c in word)
    n = len(digits)
    return [1.0, float(13 <= n <= 19 and luhn(digits)), float("@" in word), float(word.count(".") == 3 and not letters), float(word[:1] == "+"), float(n >= LEAST_DIGITS and not letters), float(13 <= n <= 19 and not letters), float(letters > 0), float(n > 0 and letters > 0), float("/" in word), min(n, 20) / 20, min(len(word), 40) / 40]


def skip_edges(keys: list[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(edges between units of one key, edges between units of similar keys). Each unit is linked to the next one of its key;
    keys are similar if they are equal after one character is left out of one of them or of both, and of the keys that share such a rest each is linked to the next."""
    same, similar, last, first = [], {}, {}, {}
    for i, k in enumerate(keys):
        if k:
            if k in last:
                same.append((last[k], i))
            else:
                first[k] = i
            last[k] = i
    near: dict[str, str] = {}
    for k in first:
        if len(k) > LEAST_NAME:
            for rest in {k, *(k[:j] + k[j + 1 :] for j in range(len(k)))}:
                if rest in near and near[rest] != k:
                    similar[(first[near[rest]], first[k])] = None
                near[rest] = k
    return same, list(similar)


@dataclass
class Field:
    unit: np.ndarray = field(default_factory=lambda: np.zeros((12, 5)))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((5, 5)))
    skip: float = 0.0  # for equal labels of units with one key
    similar: float = 0.0  # for equal labels of units with similar keys

    def potentials(self, n_chain: int, n_same: int, n_similar: int) -> np.ndarray:
        parts = [(self.chain, n_chain), (np.eye(5) * self.skip, n_same), (np.eye(5) * self.similar, n_similar)]
        return np.concatenate([np.broadcast_to(p, (n, 5, 5)) for p, n in parts])


def written_again(kind: int, word: str) -> tuple[list[str], list[str]]:
    """Ways in which a document may write an item of the base once more, and look-alikes that are something else."""
    digits = "".join(_DIGITS.findall(word))
    if kind == 0:
        local = word.split("@")[0]
        return ([local, f"@{local}"], [local[::-1], f"@{local[::-1]}"]) if len(local) >= LEAST_NAME and not local.isalpha() else ([], [])
    if kind == 1 or len(digits) < LEAST_DIGITS + 2:
        return [], []
    wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
    other = "".join(str(9 - int(d)) for d in digits)
    return ([digits[-9:], wrong[-9:]] if kind == 3 else [wrong, digits[:4] + "." + digits[4:]]), ([other[-9:]] if kind == 3 else [other[:-1] + str((int(other[-1]) + 3) % 10)])


def fit(texts: list[str]) -> Field:
    """All weights together, by the pseudo-likelihood of each unit's label given those of its neighbours over both kinds of edges;
    base spans, whose labels are always given, count as neighbours only.

    Labels are the base spans, and other units take that of a base span with their key. As few texts repeat an item, each
    base span is also written again behind its text in other forms, with its label, together with as many look-alikes without one.
    """
    x, y, free, edges = [], [], [], ([], [], [])
    for text in texts:
        base = base_spans(text)
        names = names_of(text, base)
        known = [(k, text[a:b]) for k, a, b in units(text, base, names)]
        open_here = [k == 0 for k, _ in known]
        for k, word in list(known):
            if k:
                again, other = written_again(k - 1, word)
                known += [(k, w) for w in again] + [(0, w) for w in other]
        keys = [key(w, names) for _, w in known]
        given = {c: k for (k, _), c in zip(known, keys) if k and c}
        at = len(y)
        free += open_here + [True] * (len(known) - len(open_here))
        x += [features(w) for _, w in known]
        y += [k or given.get(c, 0) for (k, _), c in zip(known, keys)]
        for found, new in zip(edges, ([(i, i + 1) for i in range(len(known) - 1)], *skip_edges(keys))):
            found += [(at + i, at + j) for i, j in new]
    out = Field()
    if not any(free):
        out.unit[0] = [4.0, 0, 0, 0, 0]
        return out
    x, y, free = np.array(x), np.array(y), np.array(free, float)[:, None]
    gold = np.eye(5)[y]
    ends = [np.array(e, np.int64).reshape(-1, 2).T for e in edges]
    n = len(y)
    for _ in range(STEPS):
        score = x @ out.unit
        np.add.at(score, ends[0][1], out.chain[y[ends[0][0]]])
        np.add.at(score, ends[0][0], out.chain.T[y[ends[0][1]]])
        for (i, j), weight in zip(ends[1:], (out.skip, out.similar)):
            np.add.at(score, i, weight * gold[j])
            np.add.at(score, j, weight * gold[i])
        p = np.exp(score - score.max(1, keepdims=True))
        rest = (gold - p / p.sum(1, keepdims=True)) * free
        out.unit += RATE * (x.T @ rest / n - RIDGE * out.unit)
        chain = np.zeros((5, 5))
        np.add.at(chain, y[ends[0][0]], rest[ends[0][1]])
        np.add.at(chain.T, y[ends[0][1]], rest[ends[0][0]])
        out.chain = np.clip(out.chain + RATE * (chain / n - RIDGE * out.chain), -1, 1)
        same, similar = (float(rest[i, y[j]].sum() + rest[j, y[i]].sum()) / n for i, j in ends[1:])
        out.skip += RATE * (same - RIDGE * out.skip)
        out.similar += RATE * (similar - RIDGE * out.similar)
    return out


def propagate(own: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Marginals (n, 5) by loopy belief propagation; ``own``: log potentials, ``edges`` (m, 2), ``potentials`` (m, 5, 5)."""
    n, m = len(own), len(edges)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    table_ = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, 5))
    for _ in range(ROUNDS):
        total = own.copy()
        np.add.at(total, target, message)
        ahead = (total[source] - message[back])[:, :, None] + table_
        new = np.logaddexp.reduce(ahead, axis=1)
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max() if m else 0.0
        message = 0.5 * message + 0.5 * new
        if change < 1e-3:
            break
    total = own.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(model: Field, text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) by kind and start: base spans and those that the field adds."""
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    names = names_of(text, base)
    u = units(text, base, names)
    if len(u) > len(base):
        same, similar = skip_edges([key(text[a:b], names) for _, a, b in u])
        own = np.array([features(text[a:b]) for _, a, b in u]) @ model.unit
        for i, (label, _, _) in enumerate(u):
            if label:
                own[i] = np.where(np.arange(5) == label, 0.0, -50.0)
        edges = np.array([(i, i + 1) for i in range(len(u) - 1)] + same + similar, int).reshape(-1, 2)
        potentials = model.potentials(len(u) - 1, len(same), len(similar))
        p = propagate(own, edges, potentials)
        for i, (label, a, b) in enumerate(u):
            best = int(p[i].argmax())
            if not label and best and p[i, best] > SURE:
                out.append((best - 1, a, b, False))
        out.sort(key=lambda x: (x[0], x[1], x[2]))
    return out


def redact(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """``text`` with each span (overlapping ones together) replaced by the kind of the first, such as ``[EMAIL]``."""
    parts, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def spans_udf(model: Field):
    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in all_spans(model, t or "")] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return find


def redact_udf(model: Field):
    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redact(t, all_spans(model, t)) for t in texts.to_pylist()], pa.string())

    return clean


def train(docs: DataFrame) -> Field:
    """Fit on at most ``FIT_ROWS`` texts with a digit, of at most ``FIT_CHARS`` characters, by smallest hash: a sample of texts;
    longer ones are left to the others of their kind."""
    return fitted(sample_texts(docs.where(F.col("text").rlike("[0-9]")), FIT_ROWS, FIT_CHARS), fit)


def find_pii(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` and ``name`` (in place of a column of that name): an array of (kind, start, end, base), by kind and start,
    offsets in code points.

    A null or empty text has no spans. Rows are treated one by one; repeated rows and null ids stay.
    """
    return docs.withColumn(name, spans_udf(train(docs))("text"))


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; a null text stays null."""
    out = docs.withColumn("text", redact_udf(train(docs))("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_pii(docs: DataFrame) -> DataFrame:
    """The counts and ``base_sha256`` are of base spans; ``spans`` also has those that the field adds."""
    found = find_pii(docs.select("doc_id", "text"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii", lambda s: s["base"])
    count = lambda k: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
