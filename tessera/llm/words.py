"""Words, sizes and set hashes that the text operators share.

A word is a maximal run of code points other than space and U+0009 to U+000D.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


# ---- the same words, seen as bytes by numpy, for tasks that hash every shingle ----

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
CHUNK_BYTES = 2 << 20


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into these bytes) for runs of about size bytes; no text is cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words as byte positions, and each text's range of words; in_word says which bytes words hold."""
    inside = in_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z folded to a-z."""
    power, inverse = _powers_up_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_FOLDED[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles as ascending 64-bit hashes, and the bounds of each text's run.

    A text of fewer than k words has its whole sequence as its one shingle; without words it has none.
    """
    starts, ends, bounds = word_spans(data, offsets)
    hashed = word_hashes(data, starts, ends)
    n = len(hashed)
    rolled = np.zeros(n, np.uint64)
    for at in range(k):
        rolled[: n - at] += hashed[at:] * np.uint64(2 * (0x5851F42D4C957F2D + 0x632BE59BD9B4E019 * at & (2**63 - 1)) + 1)
    rolled = mix(rolled)
    count = np.diff(bounds)
    long_enough = count >= k
    keep = np.zeros(n, bool)
    kept = np.where(long_enough, count - k + 1, (count > 0).astype(count.dtype))
    for low, high in zip(bounds[:-1][kept > 0], (bounds[:-1] + kept)[kept > 0], strict=True):
        keep[low:high] = True
    for row in np.flatnonzero((count > 0) & ~long_enough):
        low, high = bounds[row], bounds[row + 1]
        value = np.array([high - low], np.uint64)
        for word in hashed[low:high]:
            value = mix(value * np.uint64(0xD6E8FEB86659FD93) + word)
        rolled[low] = value[0]
    values = rolled[keep]
    at = np.concatenate(([0], np.cumsum(kept)))
    for low, high in zip(at[:-1], at[1:], strict=True):
        values[low:high].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[at[:-1][kept > 0]] = True
    return values[fresh], np.concatenate(([0], np.cumsum(fresh)))[at]


def set_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-free 64-bit sums of the runs that begin at starts and cover values."""
    return np.add.reduceat(mix(values ^ np.uint64(0xA0761D6478BD642F)), starts) if len(starts) else np.zeros(0, np.uint64)


def as_fraction(threshold: float) -> Fraction:
    return Fraction(str(threshold)).limit_denominator(10_000)


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def integer_ids(docs: DataFrame) -> DataFrame:
    """docs, if its doc_id is a whole number; refused at once otherwise, before any task runs."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be a whole number, not {kind.simpleString()}")
    return docs
