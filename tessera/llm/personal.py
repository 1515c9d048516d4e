"""Personal data: exact patterns and a skip-chain conditional random field (operator 5)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import integer_ids

KINDS = ("email", "ip", "card", "phone")
#: Documents that hold a digit or an at sign, and that the field's weights are fitted on.
SAMPLE = 1500
#: Belief from which on a token outside the patterns becomes a span.
SURE = 0.9
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits whose first digit doesn't begin one, hence the look-behind and the possessive runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one at sign: what stands before it as far as the class goes, and a domain after it."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            low = domain.end()
        at = text.find("@", max(at + 1, low))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; matches that fail their test are dropped, not tried again."""
    spans = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            spans.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((3, *m.span()))
    return spans


class Field:
    """The graph of a document: a node for each word with a digit or an at sign; edges between neighbours in the text, and
    skip edges between a word and the one before it with the same digits or the same core."""

    FEATURES = 21

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.words = [(m.start(), m.end(), i) for i, m in enumerate(_WORD.finditer(text)) if _HINT.search(m[0])]
        n = len(self.words)
        self.core = [(s + len(w) - len(w.lstrip("([{<\"'.,;:")), e - len(w) + len(w.rstrip(")]}>\"'.,;:!?"))) for s, e, _ in self.words for w in (text[s:e],)]
        self.label = np.zeros(n, int)  # the pattern that covers the word, 0 for none
        at = 0
        for kind, start, end in sorted(spans, key=lambda x: x[1:]):
            while at and self.words[at - 1][1] > start:
                at -= 1
            while at < n and self.words[at][1] <= start:
                at += 1
            while at < n and self.words[at][0] < end:
                self.label[at] = self.label[at] or kind + 1
                at += 1
        self.features = np.array([self._features(text[a:b]) for a, b in self.core]).reshape(n, self.FEATURES)
        self.chain = [(i - 1, i) for i in range(1, n) if self.words[i][2] - self.words[i - 1][2] == 1]
        self.skip, last, neighbours = [], {}, set(self.chain)
        for i, (a, b) in enumerate(self.core):
            w = text[a:b].lower()
            digits = "".join(c for c in w if c.isdigit())
            for key in {w, digits} if len(digits) >= 7 else {w} if len(w) >= 5 else ():
                if key in last and (last[key], i) not in neighbours:
                    self.skip.append((last[key], i))
                last[key] = i
        self.skip = list(dict.fromkeys(self.skip))

    def _features(self, w: str) -> list[float]:
        digits = sum(c.isdigit() for c in w)
        dots, letters = w.count("."), sum(c.isalpha() for c in w)
        return [
            1.0, "@" in w, "@" in w and "." in w.partition("@")[2], dots == 3 and letters == 0, 0 < dots < 3, dots > 3, digits == 0, 1 <= digits <= 2, 3 <= digits <= 4, 5 <= digits <= 8,
            9 <= digits <= 12, 13 <= digits <= 19, digits > 19, 13 <= digits <= 19 and _luhn("".join(c for c in w if c.isdigit())), letters > 0, letters > digits, w.startswith("+"), "(" in w or ")" in w, "-" in w, digits == len(w), len(w) > 24,
        ]


class Weights:
    """Log potentials of the field: features by label, neighbours by pair of labels, and agreement along skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: float):
        self.unary, self.chain, self.skip = unary, chain, skip


def fit(fields: list[Field], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Weights:
    """Weights that maximise the penalised pseudo-likelihood of the pattern labels: each node given its features and its neighbours' labels.

    A node's own pattern is hidden from it, so the weights learn what its shape and its neighbours tell without the pattern.
    """
    k = len(KINDS) + 1
    x = np.concatenate([f.features for f in fields if len(f.label)]) if any(len(f.label) for f in fields) else np.zeros((0, Field.FEATURES))
    y = np.concatenate([f.label for f in fields] or [np.zeros(0, int)])
    left, right, agree = (np.zeros((len(y), k)) for _ in range(3))
    at = 0
    for f in fields:
        for a, b in f.chain:
            left[at + b, f.label[a]] = 1
            right[at + a, f.label[b]] = 1
        for a, b in f.skip:
            agree[at + b, f.label[a]] += 1
            agree[at + a, f.label[b]] += 1
        at += len(f.label)
    unary, chain, skip = np.zeros((Field.FEATURES, k)), np.zeros((k, k)), 0.0
    truth = np.eye(k)[y]
    for _ in range(rounds if len(y) else 0):
        score = x @ unary + left @ chain + right @ chain.T + skip * agree
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (truth - p) / len(y)
        unary += rate * (x.T @ error * 10 - decay * unary)
        chain += rate * (left.T @ error + error.T @ right - decay * chain)
        skip += rate * ((agree * error).sum() * 10 - decay * skip)
    return Weights(unary, chain, skip)


def beliefs(field: Field, weights: Weights, rounds: int = 10) -> np.ndarray:
    """Marginals by loopy message passing, with the labels of the patterns held fixed."""
    k = len(KINDS) + 1
    own = field.features @ weights.unary
    known = field.label > 0
    own[known] = -50.0
    own[known, field.label[known]] = 0.0
    edges = np.array([*field.chain, *field.skip], int).reshape(-1, 2)
    pair = np.stack([weights.chain] * len(field.chain) + [weights.skip * np.eye(k)] * len(field.skip)) if len(edges) else np.zeros((0, k, k))
    source, target = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    messages = np.zeros((len(source), k))
    total = own
    for _ in range(rounds if len(edges) else 0):
        arriving = (total[source] - messages[back])[:, :, None] + pair
        top = arriving.max(axis=1, keepdims=True)
        new = np.log(np.exp(arriving - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        done = np.abs(new - messages).max(initial=0) < 1e-4
        messages = 0.5 * messages + 0.5 * new  # damped, so that loops settle
        total = own.copy()
        np.add.at(total, target, messages)
        if done:
            break
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], weights: Weights) -> list[tuple[int, int, int]]:
    """Spans that the field adds: words outside all patterns of whose kind it is SURE; neighbours of one kind are one span."""
    field = Field(text, spans)
    if not (field.label == 0).any():  # the patterns hold every node
        return []
    p = beliefs(field, weights)
    found, last = [], -1
    for i in np.flatnonzero((field.label == 0) & (p[:, 1:].max(axis=1, initial=0) >= SURE)):
        (start, end), kind = field.core[i], int(p[i, 1:].argmax())
        if end <= start:
            continue
        if found and last == i - 1 and found[-1][0] == kind and field.words[i][2] - field.words[last][2] == 1:
            start = found.pop()[1]
        found.append((kind, start, end))
        last = i
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def fit_weights(docs: DataFrame, sample: int = SAMPLE) -> Weights:
    """Fit the field on the patterns of at most sample documents, whole texts: those with a digit or an at sign and the least hashes."""
    hinted = docs.select("text", F.xxhash64("text").alias("_h")).where(F.col("text").rlike("[0-9@]"))
    # First the hashes alone, so that no task sends more than sample numbers to the driver; then the texts below the last one.
    least = [r["_h"] for r in hinted.select("_h").distinct().orderBy("_h").limit(sample).collect()]
    if not least:
        return fit([])
    chosen = hinted.where(F.col("_h") <= least[-1]).groupBy("_h").agg(F.min("text").alias("text"))
    texts = [r["text"] for r in chosen.orderBy("_h").collect()]
    return fit([Field(t, base_spans(t)) for t in texts])


def find_personal(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (patterns), base_sha256, spans (patterns and added) for each row of docs.

    Every text is read whole; null texts are empty, and have no spans. A word with a digit or an at sign that no pattern
    covers becomes a span when the field, which ties it to repeated or similar words, is SURE of its kind; patterns stay. Equal and null
    ids are rows like others; extra columns are left out; an empty table gives an empty result.
    """
    docs = integer_ids(docs)
    weights = weights or fit_weights(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, every = [], [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text and _HINT.search(text) else []
                counts.append([sum(s[0] == k for s in spans) for k in range(4)] if spans else (0, 0, 0, 0))
                digests.append(hashlib.sha256(_joined(spans).encode()).hexdigest())
                every.append(_joined(spans + added_spans(text, spans, weights)) if text and _HINT.search(text) else "")
            by_kind = np.array(counts, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in by_kind), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def mask_personal(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """docs with all personal data in text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; n_chars, if there, follows the text.

    Every row and column stays; texts without personal data, null and empty ones too, stay as they are. Equal and null ids are rows like others; an empty
    table gives an empty result.
    """
    weights = weights or fit_weights(docs)

    def clean(text: str) -> str:
        spans = base_spans(text)
        return masked(text, spans + added_spans(text, spans, weights))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [clean(x) if x and _HINT.search(x) else x for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    at, numbered = docs.columns.index("text"), docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots are none for mapInArrow
    cleaned = numbered.mapInArrow(scan, numbered.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned
