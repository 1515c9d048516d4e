"""Key-by-key comparison of result tables with tolerances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def values_match(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    """Equality by the column's type; two nulls match."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        near = F.abs(F.timestamp_diff("MICROSECOND", a, b)) <= tolerance * 1e6
    elif isinstance(kind, T.NumericType):
        near = F.abs(a.cast("double") - b.cast("double")) <= tolerance
    else:
        near = a == b
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def normal_key(kind: T.DataType, key: Column) -> Column:
    """Numbers as doubles, times as timestamps, all else as text, so that keys of two sources meet."""
    if isinstance(kind, T.NumericType):
        return key.cast("double")
    return key.cast("timestamp_ntz") if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else key.cast("string")


def match_rates(candidate: DataFrame, truth: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: Mapping[str, float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """column_name, n_matched, n_total, match_rate: matches over truth rows, keys that only the candidate has, and its repeated keys.

    Of a repeated key the first row in the given order counts (by its values where none is given). A column that the candidate lacks matches nothing. Repeated keys of the truth
    are refused.
    """
    tolerance, keys = tolerance or {}, list(keys)
    missing = [k for k in keys if k not in candidate.columns]
    if missing:
        raise ValueError(f"the candidate lacks keys {missing}")
    if not truth.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("the truth repeats a key")
    alike = {k: normal_key(truth.schema[k].dataType, F.col(k)) for k in keys}
    truth, candidate = truth.withColumns(alike), candidate.withColumns(alike)
    there = [v for v in values if v in candidate.columns]
    first = F.min_by(F.struct(*[F.col(v).alias(f"_{v}") for v in there], F.lit(1).alias("_here")), F.struct(*(order or there), F.lit(0)))
    once = candidate.groupBy(*keys).agg(F.count("*").alias("_n"), first.alias("_row")).select(*keys, "_n", "_row.*")
    once = once.withColumns({f"_{v}": F.lit(None).cast(truth.schema[v].dataType) for v in values if v not in there})
    joined = truth.withColumn("_truth", F.lit(1)).join(once, keys, "full")
    present = F.col("_n").isNotNull() & F.col("_truth").isNotNull()
    extra = F.sum(F.when(F.col("_truth").isNull(), F.col("_n")).otherwise(F.greatest(F.coalesce("_n", F.lit(1)) - 1, F.lit(0))))
    total = F.sum(F.coalesce("_truth", F.lit(0))) + extra
    hits = [(F.count_if(present & values_match(F.col(f"_{v}"), F.col(v), truth.schema[v].dataType, tolerance.get(v, 0.0))) if v in there else F.sum(F.lit(0)).cast("long")).alias(v) for v in values]
    row = joined.agg(total.alias("n_total"), *hits)
    return row.unpivot(["n_total"], list(values), "column_name", "n_matched").select("column_name", "n_matched", "n_total", (F.col("n_matched") / F.col("n_total")).alias("match_rate"))


def reward(rates: DataFrame) -> DataFrame:
    """The mean of the columns' match rates."""
    return rates.agg(F.coalesce(F.avg("match_rate"), F.lit(0.0)).alias("reward"))


def renamed(tables: Mapping[str, DataFrame], names: Mapping[str, str], columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables under other names, and with other names of columns; no two may fall together."""
    out = {names.get(n, n): df.withColumnsRenamed({c: columns[c] for c in df.columns if c in columns}) for n, df in tables.items()}
    if len(out) != len(tables) or any(len(set(df.columns)) != len(df.columns) for df in out.values()):
        raise ValueError("two names fall together")
    return out


def equivalent(results: Sequence[DataFrame]) -> list[bool]:
    """Whether each result has the columns, in order, and the rows, repeats and nulls included, of the first."""
    first = results[0]
    return [len(r.columns) == len(first.columns) and (counts := same_rows(first, r.toDF(*first.columns)).first())["only_left"] == 0 and counts["only_right"] == 0 for r in results[1:]]


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of rows that only one side has, repeats included."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_right")))
