"""Small relational operators with a defined order where SQL leaves one open."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators.timeops import window_join


def surrogate_keys(df: DataFrame, order: Sequence[str], name: str = "row_key") -> DataFrame:
    """df with 1, 2, ... in the given total order: ranges of the order are numbered by themselves and shifted by the rows before them, so no task sorts all rows."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *[F.col(c).asc_nulls_first() for c in order]).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))  # one row for each shuffle partition
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return ranged.withColumn("_place", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to all shuffle partitions, which adaptive plans then don't merge to as few as there are cores: what a task sorts and holds at once follows their number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hash_sample(df: DataFrame, keys: Sequence[str], rows: int, seed: int = 0) -> DataFrame:
    """A sample of that many rows that depends on the keys and the seed only."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *keys).limit(rows)


def top_values(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    """The k most frequent values; of equal frequency the smaller ones."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def first_pivot(df: DataFrame, key: str, name: str, value: str, names: Sequence[str], order: str) -> DataFrame:
    """A column for each name with its value of the least order."""
    return df.groupBy(key).agg(*[F.min_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def presence_pivot(df: DataFrame, key: str, name: str, names: Sequence[str]) -> DataFrame:
    """A 0/1 column for each name: whether the key has a row of it."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(name) == n, 1).otherwise(0)).alias(n) for n in names])


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order]))).where("_nth = 1").drop("_nth")


def boundaries_between(unit: str, low: Column, high: Column) -> Column:
    """How many starts of a unit lie in (low, high]: 10:59 to 11:01 is one HOUR."""
    return F.timestamp_diff(unit, F.date_trunc(unit, low).cast("timestamp_ntz"), F.date_trunc(unit, high).cast("timestamp_ntz"))


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Only the first match is replaced; pattern without anchors, groups or backreferences of its own."""
    return F.regexp_replace(text, F.lit(f"(?s)^(.*?)(?:{pattern})"), F.concat(F.lit("$1"), F.lit(replacement)))


def in_groups(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], name: str, otherwise: str | None = None) -> DataFrame:
    """df with the group of its value: the lists become a lookup of known size, joined by broadcast."""
    rows = [(v, g) for g, values in groups.items() for v in values]
    lookup = df.sparkSession.createDataFrame(rows, f"`{column}` string, `{name}` string")
    joined = df.join(F.broadcast(lookup), column, "left")
    return joined.fillna({name: otherwise}) if otherwise is not None else joined


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def qualifying_history(events: DataFrame, key: str, row: str, time: str, counts: Column, years: int = 2) -> DataFrame:
    """row, source: each row itself and the earlier rows of its key that count and are at most so many years older."""
    now = events.select(F.col(key).alias("_k"), F.col(row).alias(row), F.col(time).alias("_t"), (F.col(time) - F.expr(f"interval {years} year")).alias("_low"))
    past = events.where(counts).select(F.col(key).alias("_k"), F.col(row).alias("source"), F.col(time).alias("_s"))
    near = window_join(now, past, "_k", "_s", "_low", "_t", "left", 366 * years * 86_400_000_000, how="inner")
    return near.select(row, "source").unionByName(events.select(F.col(row), F.col(row).alias("source")))


def twelve_leads(df: DataFrame, first: str, second: str) -> DataFrame:
    """The four limb leads that follow from leads I and II, sample by sample."""
    rules = {"iii": lambda a, b: b - a, "avr": lambda a, b: -(a + b) / 2, "avl": lambda a, b: a - b / 2, "avf": lambda a, b: b - a / 2}
    return df.withColumns({name: F.zip_with(F.col(first).cast("array<double>"), F.col(second).cast("array<double>"), rule) for name, rule in rules.items()})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def int16_samples(encoded: pd.Series) -> pd.Series:
    """Base64 text of little-endian 16-bit samples as numbers; null for null."""
    import base64

    import numpy as np

    return encoded.map(lambda x: np.frombuffer(base64.b64decode(x), "<i2").astype(int).tolist() if x is not None else None)
