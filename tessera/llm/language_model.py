"""Scoring texts by a subword lattice (operator 10).

The model: a text is its words and an end mark. A word's probability is the sum over all ways to spell it with the pieces
of an existing vocabulary, each spelling weighing the product of its pieces' probabilities. The sum is a forward recursion in log space.
The vocabulary at hand is of the BPE kind, whose scores are ranks, so piece probabilities are learned from the training texts: they start as
frequencies in the vocabulary's own spelling, and are then expected frequencies over all spellings (forward and backward, one pass of expectation maximisation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import mix, text_chunks, word_hashes, word_spans
from tessera.session import materialize

#: Most frequent words whose figures every task holds; all others are joined by shuffle.
HEAD = 1 << 17
#: Longest words, in code points, that are spelled out many at a time.
SHORT = 40
#: Passes that learn weights as expected uses over all spellings, at most, and the part of uses below which they have settled.
ROUNDS, SETTLED = 3, 0.01
_LOG2 = float(np.log10(2.0))
_PRIME = 0x9E3779B97F4A7C15 | 1
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MARK = "▁"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 7, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, word, train, uses: each distinct word (A-Z folded), how often training documents hold it and all do.

    A task sums up runs of texts before the shuffle, so a word of any frequency reaches it as a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1), 8 << 20):
                starts, ends, bounds = word_spans(data, offsets)
                if not len(starts):
                    continue
                hashed, first, which, uses = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                trains = ~np.array(batch.column(0)[low:high].to_numpy(zero_copy_only=False), bool)
                train = np.bincount(which, np.repeat(trains, np.diff(bounds)), len(hashed)).astype(np.int64)
                raw = data.tobytes()
                words = [raw[a:b].translate(_LOWER) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(train), pa.array(uses)], names=["hash", "word", "train", "uses"])

    rows = docs.select(held_out(F.col("doc_id")).alias("out"), "text").mapInArrow(count, "hash long, word string, train long, uses long")
    return rows.groupBy("hash", "word").agg(F.sum("train").alias("train"), F.sum("uses").alias("uses"))


def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(counts: DataFrame, vocabulary: str) -> DataFrame:
    """piece, n: uses of each piece of the vocabulary in its own spelling of the training words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = _vocabulary(vocabulary)
        total = np.zeros(processor.get_piece_size(), np.int64)
        for batch in batches:
            train = batch.column(1).to_numpy()
            for low in range(0, len(train), 2000):
                ids = processor.encode(batch.column(0)[low : low + 2000].to_pylist(), num_threads=1)
                lengths = [len(x) for x in ids]
                flat = np.fromiter((i for x in ids for i in x), np.int64, sum(lengths))
                total += np.bincount(flat, np.repeat(train[low : low + 2000], lengths), len(total)).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "n"])

    return counts.where("train > 0").select("word", "train").mapInArrow(spell, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


class Lattice:
    """Log10 probabilities of words under piece probabilities; unknown characters are spelled by their bytes."""

    def __init__(self, pieces: list[str], log10p: np.ndarray, byte_log10p: np.ndarray, ids: np.ndarray | None = None, byte_ids: np.ndarray | None = None):
        self.ids, self.byte_ids = np.arange(len(pieces)) if ids is None else ids, np.arange(256) if byte_ids is None else byte_ids
        self.index = {p: i for i, p in enumerate(pieces)}
        self.by_name = dict(zip(pieces, log10p.tolist(), strict=True))
        self.longest = max(map(len, pieces))
        self.bytes = byte_log10p
        hashed = np.array([self._hash(np.array(list(map(ord, p)), np.uint64)[None])[0] for p in pieces], np.uint64)
        order = np.argsort(hashed)
        self.hashes, self.values, self.order = hashed[order], log10p[order], order

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        value = np.zeros(len(points), np.uint64)
        for column in points.T:
            value = value * np.uint64(_PRIME) + mix(column + np.uint64(1))
        return value

    def _by_bytes(self, character: str) -> float:
        return float(sum(self.bytes[b] for b in character.encode()))

    def one(self, word: str) -> float:
        """Forward recursion over one spelled-out word."""
        text = MARK + word
        alpha = np.full(len(text) + 1, -np.inf)
        alpha[0] = 0.0
        for end in range(1, len(text) + 1):
            arcs = []
            for start in range(max(0, end - self.longest), end):
                p = self.by_name.get(text[start:end])
                if p is not None:
                    arcs.append(alpha[start] + p)
            if text[end - 1] not in self.by_name:
                arcs.append(alpha[end - 1] + self._by_bytes(text[end - 1]))
            top = max(arcs)
            alpha[end] = top + np.log10(np.sum(10.0 ** (np.array(arcs) - top))) if top > -np.inf else top
        return float(alpha[-1])

    def many(self, words: list[str]) -> np.ndarray:
        """The same recursion for many words at a time, those of one length together."""
        out = np.zeros(len(words))
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            if length > SHORT:
                out[at] = [self.one(words[i]) for i in at]
                continue
            for low in range(0, len(at), 20_000):
                some = at[low : low + 20_000]
                points = np.frombuffer("".join(MARK + words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), length + 1).astype(np.uint64)
                out[some] = self._forward(points)
        return out

    def _find(self, hashed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, self.values[at], -np.inf)

    def _forward(self, points: np.ndarray) -> np.ndarray:
        n, length = points.shape
        mixed = mix(points + np.uint64(1))
        alpha = [np.zeros(n)]
        arcs: list[list[np.ndarray]] = [[] for _ in range(length + 1)]
        for start in range(length):
            if start:
                stacked = np.stack(arcs[start])
                top = stacked.max(axis=0)
                safe = np.where(np.isfinite(top), top, 0.0)
                with np.errstate(divide="ignore"):
                    alpha.append(safe + np.log10((10.0 ** (stacked - safe)).sum(axis=0)))
                arcs[start] = []
            value = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                value = value * np.uint64(_PRIME) + mixed[:, end - 1]
                p = self._find(value)
                if end == start + 1:
                    for row in np.flatnonzero(~np.isfinite(p)):
                        p[row] = self._by_bytes(chr(int(points[row, start])))
                if np.isfinite(p).any():
                    arcs[end].append(alpha[start] + p)
        stacked = np.stack(arcs[length])
        top = stacked.max(axis=0)
        return top + np.log10((10.0 ** (stacked - top)).sum(axis=0))


    def expected(self, words: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece and each byte over all spellings of words that occur so often."""
        pieces, by_byte = np.zeros(len(self.index)), np.zeros(256)
        lengths = np.array([len(w) for w in words])
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            if length > SHORT:
                for i in at:
                    self._expected_one(words[i], float(uses[i]), pieces, by_byte)
                continue
            for low in range(0, len(at), 2000):
                some = at[low : low + 2000]
                points = np.frombuffer("".join(MARK + words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), length + 1).astype(np.uint64)
                self._expected_many(points, uses[some].astype(np.float64), pieces, by_byte)
        return pieces, by_byte

    def _expected_one(self, word: str, uses: float, pieces: np.ndarray, by_byte: np.ndarray) -> None:
        text = MARK + word
        arcs: list[tuple[int, int, int, float]] = []
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                if text[start:end] in self.by_name:
                    arcs.append((start, end, self.index[text[start:end]], self.by_name[text[start:end]]))
            if text[end - 1] not in self.by_name:
                arcs.append((end - 1, end, -1, self._by_bytes(text[end - 1])))
        alpha, beta = np.full(len(text) + 1, -np.inf), np.full(len(text) + 1, -np.inf)
        alpha[0] = beta[-1] = 0.0
        for start, end, _, p in arcs:
            alpha[end] = np.logaddexp2((alpha[start] + p) / _LOG2, alpha[end] / _LOG2) * _LOG2
        for start, end, _, p in sorted(arcs, key=lambda a: -a[0]):
            beta[start] = np.logaddexp2((beta[end] + p) / _LOG2, beta[start] / _LOG2) * _LOG2
        for start, end, piece, p in arcs:
            share = uses * 10.0 ** (alpha[start] + p + beta[end] - alpha[-1])
            if piece >= 0:
                pieces[piece] += share
            else:
                np.add.at(by_byte, list(text[start].encode()), share)

    def _expected_many(self, points: np.ndarray, uses: np.ndarray, pieces: np.ndarray, by_byte: np.ndarray) -> None:
        n, length = points.shape
        mixed = mix(points + np.uint64(1))
        arcs: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # start, end, place of the piece in hash order (-1: bytes), log10 probability
        for start in range(length):
            value = np.zeros(n, np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                value = value * np.uint64(_PRIME) + mixed[:, end - 1]
                at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                hit = self.hashes[at] == value
                p, at = np.where(hit, self.values[at], -np.inf), np.where(hit, at, -1)
                if end == start + 1:
                    for row in np.flatnonzero(~hit):
                        p[row] = self._by_bytes(chr(int(points[row, start])))
                if np.isfinite(p).any():
                    arcs.append((start, end, at, p))
        alpha, beta = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        alpha[0] = beta[length] = 0.0
        for start, end, _, p in arcs:  # by start, so what enters a place is complete before it is left
            alpha[end] = np.logaddexp2((alpha[start] + p) / _LOG2, alpha[end] / _LOG2) * _LOG2
        for start, end, _, p in reversed(arcs):
            beta[start] = np.logaddexp2((beta[end] + p) / _LOG2, beta[start] / _LOG2) * _LOG2
        for start, end, at, p in arcs:
            share = uses * 10.0 ** (alpha[start] + p + beta[end] - alpha[length])
            known = at >= 0
            np.add.at(pieces, self.order[at[known]], share[known])
            if end == start + 1:
                for row in np.flatnonzero(~known):
                    np.add.at(by_byte, list(chr(int(points[row, start])).encode()), share[row])


def expected_counts(counts: DataFrame, lattice: Lattice) -> list[tuple[int, float]]:
    """(piece, expected uses in the training words), at most a row for each piece of the vocabulary; counted in millionths, so that sums don't depend on their order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, by_byte = np.zeros(len(lattice.index)), np.zeros(256)
        for batch in batches:
            more = lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            pieces += more[0]
            by_byte += more[1]
        ids, n = np.concatenate((lattice.ids, lattice.byte_ids)), np.round(np.concatenate((pieces, by_byte)) * 1e6).astype(np.int64)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[used]), pa.array(n[used])], names=["piece", "n"])

    rows = counts.where("train > 0").select("word", "train").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [(r["piece"], r["n"] / 1e6) for r in rows.collect()]


def moved(before: list[tuple[int, float]], after: list[tuple[int, float]]) -> float:
    """The part of all uses that have gone from one piece to another."""
    old, new = ({piece: n / total for piece, n in uses} if (total := sum(n for _, n in uses)) else {} for uses in (before, after))
    return sum(abs(new.get(p, 0) - old.get(p, 0)) for p in old.keys() | new.keys()) / 2


def learn_lattice(found: list[tuple[int, float]], ends: int, vocabulary: str, smoothing: float = 0.5) -> tuple[Lattice, float]:
    """(lattice, log10 probability of the end mark) from counts of pieces; every piece counts smoothing more."""
    processor = _vocabulary(vocabulary)
    size = processor.get_piece_size()
    weight = np.full(size, smoothing)
    for piece, n in found:
        weight[piece] += n
    special = [i for i in range(size) if processor.is_control(i) or processor.is_unknown(i)]
    weight[special] = 0
    total = weight.sum() + ends + smoothing
    byte, byte_ids = np.zeros(256), np.zeros(256, np.int64)
    names, values, ids = [], [], []
    for i in range(size):
        if processor.is_byte(i):
            byte[int(processor.id_to_piece(i)[1:-1], 16)] = np.log10(weight[i] / total)
            byte_ids[int(processor.id_to_piece(i)[1:-1], 16)] = i
        elif i not in special:
            names.append(processor.id_to_piece(i))
            values.append(np.log10(weight[i] / total))
            ids.append(i)
    return Lattice(names, np.array(values), byte, np.array(ids), byte_ids), float(np.log10((ends + smoothing) / total))


def score_documents(docs: DataFrame, vocabulary: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    The model learns from the rows that held_out() spares. base_score: add-one smoothed word unigrams; score: the lattice.
    The figures of the head most frequent words are held by every task (a bound on what is broadcast); those of all other
    words are joined by shuffle, and summed for each row. Null and blank texts are just an end mark. Equal and null ids are rows
    like others (a null id trains); extra columns are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = materialize(word_counts(docs), "word-counts")
    ends = docs.where(~held_out(F.col("doc_id"))).count()
    totals = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    train_tokens, distinct = int(totals[0]) + ends, int(totals[1]) + (ends > 0)
    found = [(r["piece"], r["n"]) for r in piece_counts(counts, vocabulary).collect()]  # at most a row per piece of the vocabulary
    lattice, end_score = learn_lattice(found, ends, vocabulary)
    for _ in range(ROUNDS):
        before, found = found, expected_counts(counts, lattice)
        lattice, end_score = learn_lattice(found, ends, vocabulary)
        if moved(before, found) < SETTLED:
            break

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lattice.many(batch.column(1).to_pylist()))], names=["hash", "train", "uses", "spelled"])

    figures = counts.select("hash", "word", "train", "uses").mapInArrow(spell, "hash long, train long, uses long, spelled double")
    figures = materialize(figures.select("hash", "uses", F.log10(F.col("train") + 1.0).alias("base"), (F.col("train") > 0).cast("long").alias("known"), "spelled"), "word-figures")
    top = figures.orderBy(F.desc("uses"), "hash").limit(head).toArrow()
    order = np.argsort(top.column("hash").to_numpy())
    keys, known, base, spelled = (top.column(c).to_numpy()[order] for c in ("hash", "known", "base", "spelled"))
    near = spark.sparkContext.broadcast((keys, known.astype(np.float64), base, spelled))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums over head words for each text, and a row for each other word; row: partition and place in it."""
        keys, known, base, spelled = near.value
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                starts, ends, bounds = word_spans(data, offsets)
                hashed = word_hashes(data, starts, ends).view(np.int64)
                at = np.minimum(np.searchsorted(keys, hashed), max(len(keys) - 1, 0))
                hit = keys[at] == hashed if len(keys) else np.zeros(len(hashed), bool)
                rows = np.arange(place, place + high - low)
                of = np.repeat(np.arange(high - low), np.diff(bounds))
                sums = [np.bincount(of[hit], x[at[hit]], high - low) for x in (known, base, spelled)]
                rest = ~hit
                n_rest = int(rest.sum())
                key = np.concatenate((mix(rows.astype(np.uint64)).view(np.int64), hashed[rest]))
                tail = np.zeros(n_rest)
                columns = [
                    pa.array(key), pa.array(np.concatenate((rows, rows[of[rest]]))), pa.array(np.concatenate((np.zeros(high - low, bool), np.ones(n_rest, bool)))),
                    pa.concat_arrays([batch.column(0).slice(low, high - low), pa.nulls(n_rest, pa.int64())]),
                    pa.array(np.concatenate((np.diff(bounds), tail.astype(np.int64)))), *(pa.array(np.concatenate((s, tail))) for s in sums),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "row", "tail", "doc_id", "n", "known", "base", "spelled"])
                place += high - low

    looked = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look_up, "hash long, row long, tail boolean, doc_id long, n long, known double, base double, spelled double")
    other = figures.select("hash", F.col("known").alias("k"), F.col("base").alias("b"), F.col("spelled").alias("s"))
    joined = looked.join(other, "hash", "left")
    pick = lambda a, b: F.when(F.col("tail"), F.col(a)).otherwise(F.col(b))
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.sum(pick("k", "known")).alias("known"), F.sum(pick("b", "base")).alias("base"), F.sum(pick("s", "spelled")).alias("spelled")
    )
    n = F.col("n") + 1
    shared = float(np.log10(train_tokens + distinct + 1))
    return summed.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), n.alias("n_tokens"), (F.col("known").cast("long") + int(ends > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + 1)) - n * shared).alias("base_score"), (F.col("spelled") + end_score).alias("score"),
    )
