"""Diagnosis-code operators: prefix flags, weighted indices and prefix lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starts_with_any(code: Column, prefixes: Sequence[str]) -> Column:
    """One IN test for each length of prefix, instead of one LIKE for each prefix."""
    out = F.lit(False)
    for n in sorted({len(p) for p in prefixes}):
        out = out | F.substring(code, 1, n).isin(*sorted(p for p in prefixes if len(p) == n))
    return out


def prefix_between(code: Column, n: int, low: str, high: str) -> Column:
    return F.substring(code, 1, n).between(low, high)


def prefix_flags(diagnoses: DataFrame, key: str, code: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """key and a 0/1 column for each group of prefixes, in one aggregation."""
    return diagnoses.groupBy(key).agg(*[F.max(F.when(starts_with_any(F.col(code), p), 1).otherwise(0)).alias(g) for g, p in groups.items()])


def weighted_index(flags: DataFrame, weights: Mapping[str, float], hierarchy: Sequence[tuple[str, str]] = ()) -> Column:
    """Sum of weights of flags; of a pair (severe, mild) in hierarchy the mild one counts only without the severe one."""
    out = F.lit(0)
    milder = {mild: severe for severe, mild in hierarchy}
    for name, weight in weights.items():
        flag = F.col(name)
        if name in milder:
            flag = F.when(F.col(milder[name]) == 1, 0).otherwise(flag)
        out = out + flag * weight
    return out


def longest_prefix(rows: DataFrame, lookup: DataFrame, code: str, prefix: str, lengths: Sequence[int], values: list[str], id_columns: list[str]) -> DataFrame:
    """Rows with the values of the longest lookup prefix of their code: prefixes are exploded, so the join has an equality key."""
    tries = F.array(*[F.substring(F.col(code), 1, n) for n in lengths])
    exploded = rows.withColumn("_try", F.explode(F.array_distinct(tries)))
    joined = exploded.join(lookup.withColumnRenamed(prefix, "_prefix"), F.col("_try") == F.col("_prefix"))
    best = F.max_by(F.struct(*values), F.length("_try")).alias("_best")
    return joined.groupBy(*id_columns, code).agg(best).select(*id_columns, code, "_best.*")
