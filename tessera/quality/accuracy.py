"""Logical accuracy: values that several models of their clinical context find unlikely.

Models are fitted over all rows by sums that tasks make of their batches; only the trees of the isolation forest come from a bounded sample, as that method has it.
Lines at quantiles, a reconstruction from the main directions of the context, and isolation depth take the place of the surveyed tools' models that Spark has no
form of (boosted quantiles, autoencoder, one-class machine).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import round_scaled
from tessera.session import materialize

#: The quantiles of the lines, and the part of rows that scores must exceed.
QUANTILES, LIMIT = (0.01, 0.99), 0.98
#: How far the scaled coefficients of a line may move before all rows are read again.
NEAR = 0.1
#: Trees, and rows that each is grown from.
TREES, TREE_ROWS = 100, 256


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def summed(df: DataFrame, names: Sequence[str], sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of sums(matrix of the named columns): each task adds up its batches, the driver one row for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch, names)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": [total.tolist()]})

    parts = [np.array(r["total"]) for r in df.select(*names).mapInArrow(run, "total array<double>").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(0)


def _kept(df: DataFrame, names: Sequence[str], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows for which keep(matrix of the named columns) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(_matrix(batch, names))))

    return df.mapInArrow(run, df.schema)


def _scale(df: DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and deviations (1 for a constant) and the number of rows."""
    first = summed(df, names, lambda x: np.concatenate(([len(x)], x.sum(axis=0))))
    if not len(first):
        return np.zeros(len(names)), np.ones(len(names)), 0
    mean = first[1:] / first[0]
    spread = np.sqrt(summed(df, names, lambda x: ((x - mean) ** 2).sum(axis=0)) / first[0])
    return mean, np.where(spread > 1e-12 * np.maximum(np.abs(mean), 1), spread, 1), int(first[0])


def quantile_lines(df: DataFrame, features: Sequence[str], target: str, quantiles: Sequence[float] = QUANTILES, rounds: int = 80, exact: float = 1e-5) -> np.ndarray:
    """For each quantile q the intercept and slopes that minimise the tilted absolute loss over all rows.

    Each round minimises a quadratic that lies above the loss and touches it at the last line (Hunter and Lange): weighted least squares with weights 1 / (e + |residual|) from
    sums over all rows, for all quantiles in one pass. e falls to a millionth of the target's deviation. Rows with nulls must be gone.

    Once the lines move little, rows that no line within NEAR of them can meet are added up: their loss is linear there, so the optimum is the same, and later rounds read the other rows only.
    Where a line moves further, all rows count again.
    """
    names = [*features, target]
    mean, spread, n = _scale(df, names)
    d = len(features) + 1
    if not n:
        return np.full((len(quantiles), d), np.nan)

    def design(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - mean) / spread
        return np.hstack([np.ones((len(z), 1)), z[:, :-1]]), z[:, -1]

    def plain(x: np.ndarray) -> np.ndarray:
        z, y = design(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    def solve(square: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.linalg.lstsq(square.reshape(d, d), right, rcond=1e-10)[0]

    def far(x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows no line meets that lies within NEAR of its line in home, in every coefficient."""
        z, y = design(x)
        off = y[:, None] - z @ home.T
        return (np.abs(off) > NEAR * np.abs(z).sum(axis=1, keepdims=True)).all(axis=1), z, off

    def tilts(x: np.ndarray, home: np.ndarray) -> np.ndarray:
        away, z, off = far(x, home)
        above = off[away] > 0
        return 2 * (np.where(above, q, q - 1).T @ z[away])

    total, q = summed(df, names, plain), np.array(quantiles)
    lines = np.tile(solve(total[: d * d], total[d * d :]), (len(quantiles), 1))
    rows, beyond, home = df, np.zeros((len(quantiles), d)), None
    for k in range(rounds):
        small = max(0.1 * 0.7**k, 1e-6)

        def weighted(x: np.ndarray, lines=lines, small=small) -> np.ndarray:
            z, y = design(x)
            out = []
            for line in lines:
                w = 1 / (small + np.abs(y - z @ line))
                out += [((z * w[:, None]).T @ z).ravel(), (z * w[:, None]).T @ y, z.sum(axis=0)]
            return np.concatenate(out)

        sums = summed(rows, names, weighted)
        sums = (sums if len(sums) else np.zeros(len(quantiles) * (d * d + 2 * d))).reshape(len(quantiles), -1)
        new = np.array([solve(s[: d * d], s[d * d : -d] + (2 * level - 1) * s[-d:] + tilt) for level, s, tilt in zip(quantiles, sums, beyond, strict=True)])
        moved, lines = np.abs(new - lines).max(), new
        if home is not None and np.abs(lines - home).max() > NEAR:
            rows, beyond, home = df, np.zeros((len(quantiles), d)), None  # far rows may now lie on the other side: all count again
        elif moved < exact and small <= 1e-5:
            break
        elif home is None and moved < NEAR / 4:
            home = lines
            beyond = summed(df, names, lambda x, home=home: tilts(x, home)).reshape(len(quantiles), d)
            rows = materialize(_kept(df.select(*names), names, lambda x, home=home: ~far(x, home)[0]), "near-lines")
    slopes = lines[:, 1:] * spread[-1] / spread[:-1]
    return np.hstack([(mean[-1] + lines[:, :1] * spread[-1]) - slopes @ mean[:-1, None], slopes])


class Forest:
    """Isolation trees: random cuts between the extremes of a random column, down to single rows or the mean depth of the sample."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(rows, len(sample))
        self.deepest = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng) for _ in range(trees)] if self.size else []

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        """Mean depth at which a row of n is alone."""
        n = np.asarray(n, float)
        more = np.maximum(n, 3)
        return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(more - 1) + np.euler_gamma) - 2 * (more - 1) / more))

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """column (-1: leaf), cut, left, right, depth of each node."""
        nodes: list[list[float]] = []
        stack = [(rows, 0, -1, 0)]
        while stack:
            some, depth, parent, side = stack.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            low, high = (some.min(axis=0), some.max(axis=0)) if len(some) else (np.zeros(0), np.zeros(0))
            wide = np.flatnonzero(high > low)
            if depth >= self.deepest or not len(wide):
                nodes.append([-1, 0.0, at, at, depth + float(self.expected(len(some)))])
                continue
            column = int(rng.choice(wide))
            cut = rng.uniform(low[column], high[column])
            nodes.append([column, cut, 0, 0, 0.0])
            below = some[:, column] < cut
            stack += [(some[below], depth + 1, at, 0), (some[~below], depth + 1, at, 1)]
        table = np.array(nodes)
        return table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; rows that are soon alone are near 1."""
        total = np.zeros(len(x))
        for column, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.deepest):
                c = column[at]
                below = x[np.arange(len(x)), np.maximum(c, 0)] < cut[at]
                at = np.where(c < 0, at, np.where(below, left[at], right[at]))
            total += depth[at]
        usual = float(self.expected(self.size)) or 1.0
        return 2.0 ** (-total / max(len(self.trees), 1) / usual)


def fit_forest(df: DataFrame, features: Sequence[str], trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """Trees from at most trees * rows rows, which a seeded hash picks from all."""
    chosen = df.select(*features).orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(trees * rows).toArrow()
    return Forest(np.stack([c.cast(pa.float64()).to_numpy() for c in chosen.columns], axis=1), trees, rows, seed)


def main_directions(df: DataFrame, features: Sequence[str], keep: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, projection on the `keep` main directions of the scaled columns), by default half of them."""
    mean, spread, n = _scale(df, features)
    keep = max(1, len(features) // 2) if keep is None else keep
    square = summed(df, features, lambda x: ((x - mean) / spread).T @ ((x - mean) / spread)) if n else np.eye(len(features))
    _, vectors = np.linalg.eigh(square.reshape(len(features), len(features)))
    axes = vectors[:, ::-1][:, :keep]
    return mean, spread, axes @ axes.T


def _scored(df: DataFrame, features: Sequence[str], columns: dict[str, Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """df with a column of doubles for each function of the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, features)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(f(x)) for f in columns.values()]], names=[*batch.schema.names, *columns])

    return df.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"{c} double" for c in columns]]))


def _limits(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """df with the LIMIT quantile of each score beside it; quantiles within one part in 100,000 of the rows."""
    found = df.agg(*[F.percentile_approx(s, LIMIT, 100_000).alias(s) for s in scores]).first()
    return df.withColumns({f"{s}_limit": F.lit(found[s]).cast("double") for s in scores})


def numeric_accuracy(context: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """context with low and high (the lines at 0.01 and 0.99), rebuilt (the target from the main directions) and how far off it is, isolation, both with their limits, and direction: Upper or Under
    where the value lies outside the lines and is farther off than the limit, else null. Isolation stands beside the verdict and has no part in it: it judges a value among all values, not in its context.
    Rows with a null in target or features are left out, as no model has a word on them."""
    names = [target, *features]
    rows = materialize(context.dropna(subset=names), "context")
    lines = quantile_lines(rows, features, target)
    mean, spread, projection = main_directions(rows, names)
    forest = fit_forest(rows, names)
    low, high = ((lambda x, line=line: line[0] + x[:, 1:] @ line[1:]) for line in lines)
    rebuilt = lambda x: ((((x - mean) / spread) @ projection) * spread + mean)[:, 0]
    scored = _scored(rows, names, {"low": low, "high": high, "rebuilt": rebuilt, "isolation": forest.scores})
    scored = _limits(materialize(scored.withColumn("off", F.abs(F.col("rebuilt") - F.col(target))), "scored"), ["off", "isolation"])
    far = F.col("off") > F.col("off_limit")
    return scored.withColumn("direction", F.when(far & (F.col(target) > F.col("high")), "Upper").when(far & (F.col(target) < F.col("low")), "Under"))


def categorical_accuracy(context: DataFrame, features: Sequence[str]) -> DataFrame:
    """context with isolation and off (mean distance of the scaled columns from what the main directions give back), their limits, and outlier: both exceed them."""
    rows = materialize(context.dropna(subset=list(features)), "context")
    mean, spread, projection = main_directions(rows, features)
    off = lambda x: np.abs(((x - mean) / spread) @ projection - (x - mean) / spread).mean(axis=1)
    scored = _limits(materialize(_scored(rows, features, {"isolation": fit_forest(rows, features).scores, "off": off}), "scored"), ["isolation", "off"])
    return scored.withColumn("outlier", (F.col("isolation") > F.col("isolation_limit")) & (F.col("off") > F.col("off_limit")))


def accuracy_summary(judged: DataFrame, outlier: str) -> DataFrame:
    """total, outliers, accuracy: the rows that aren't outliers in per cent; outlier: an SQL condition."""
    counted = judged.agg(F.count("*").alias("total"), F.count(F.when(F.expr(outlier), 1)).alias("outliers"))
    return counted.withColumn("accuracy", round_scaled((F.col("total") - F.col("outliers")) * 100 / F.nullif(F.col("total"), F.lit(0)), 2))
