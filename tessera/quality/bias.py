"""Metrics by group of patients: how far the worst group's score lies from the mean of the groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import round_scaled
from tessera.quality import metrics
from tessera.session import materialize

#: What stands between the name of a grouping, of a group and of a table or variable.
_MARK = "\x1f"
# Groups of age.
AGES = ((10, "0-9"), (20, "10-19"), (30, "20-29"), (40, "30-39"), (50, "40-49"), (60, "50-59"), (70, "60-69"), (80, "70-79"), (120, "80+"))


def age_group(age: Column) -> Column:
    """The group that holds an age; null below 0 and from 120 on."""
    out = F.lit(None).cast("string")
    for high, name in reversed(AGES):
        out = F.when(age < high, name).otherwise(out)
    return F.when(age >= 0, out)


def demographics(long: DataFrame, variables: Mapping[str, str]) -> DataFrame:
    """Patient_id and one column for each variable (its name -> name of the column): the value of the least row key that isn't blank."""
    rows = long.where(F.col("Variable_name").isin(*variables) & (F.col("Value") != "") & F.col("Patient_id").isNotNull())
    first = [F.min_by(F.when(F.col("Variable_name") == v, F.col("Value")), F.when(F.col("Variable_name") == v, F.struct("Primary_key", "Value"))).alias(name) for v, name in variables.items()]
    return rows.groupBy("Patient_id").agg(*first)


def _mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))


def _share(good: Column, every: Column) -> Column:
    return good * 100 / F.nullif(every, F.lit(0))


def class_diversity_total(per: DataFrame, *by: str) -> DataFrame:
    """The diversities of metrics.class_diversity, weighted by their numbers of values."""
    return per.groupBy(*by).agg(round_scaled(_mean("diversity", "n"), 2).alias("score"))


def instance_percents(per: DataFrame) -> DataFrame:
    """The rows of metrics.instance_diversity with both figures in per cent; a class whose every patient has it once counts as fully diverse."""
    share = F.col("patients") / F.col("occurrences")
    return per.withColumns({"instance_diversity": round_scaled(share * 100, 2), "gini_percent": F.when(share == 1, 100.0).otherwise(round_scaled(F.col("gini") * 100, 2))})


def instance_diversity_total(per: DataFrame, *by: str) -> DataFrame:
    """The percentages weighted by occurrences: score, gini."""
    rows = instance_percents(per)
    return rows.groupBy(*by).agg(round_scaled(_mean("instance_diversity", "occurrences"), 2).alias("score"), round_scaled(_mean("gini_percent", "occurrences"), 2).alias("gini"))


def classification_total(per: DataFrame, *by: str) -> DataFrame:
    """The figures of metrics.classification weighted by their numbers of rows, to three digits; groups without an area have no part in its mean."""
    figures = ("accuracy", "macro_precision", "macro_recall", "macro_f1")
    area = F.sum(F.col("auc") * F.col("n")) / F.sum(F.when(F.col("auc").isNotNull(), F.col("n")))
    return per.groupBy(*by).agg(F.sum("n").alias("n"), round_scaled(area, 3).alias("auc"), *[round_scaled(_mean(f, "n"), 3).alias(f) for f in figures])


#: Metric -> (its table over the long format, its score by group from that table).
SCORES: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[..., DataFrame]]] = {
    "completeness": (metrics.completeness, lambda t, *by: t.groupBy(*by).agg(round_scaled(_share(F.sum("n_present"), F.sum("n_total")), 2).alias("score"))),
    "date_validity": (metrics.date_validity, lambda t, *by: t.groupBy(*by).agg(round_scaled(_mean("validity", "n"), 2).alias("score"))),
    "range_validity": (metrics.range_validity, lambda t, *by: t.groupBy(*by).agg(round_scaled(_share(F.sum("n") - F.sum("n_under") - F.sum("n_over"), F.sum("n")), 2).alias("score"))),
    "class_diversity": (metrics.class_diversity, class_diversity_total),
    "instance_diversity": (metrics.instance_diversity, lambda t, *by: instance_diversity_total(t, *by).drop("gini")),
    "preciseness": (metrics.preciseness, lambda t, *by: t.groupBy(*by).agg(round_scaled(_mean("gini", "n") * 100, 2).alias("score"))),
}


def scores_by_group(long: DataFrame, patients: DataFrame, groupings: Sequence[str], wanted: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """metric, grouping, group_name, score: each metric over the rows of each group by itself; patients: Patient_id and a column for each grouping.

    Rows of patients without a value in some grouping are left out of all. The long format is laid out once, a row for each grouping, with the group as a part of the names of table and variable; so every metric
    runs once for all groups, and what it compares (quartiles of a variable, shares of its classes) stays within the group.
    """
    known = patients.dropna(subset=list(groupings))
    parts = F.array(*[F.concat(F.lit(g + _MARK), F.col(g).cast("string"), F.lit(_MARK)) for g in groupings])
    grouped = long.join(known.select("Patient_id", F.explode(parts).alias("_group")), "Patient_id")
    grouped = grouped.withColumns({c: F.concat("_group", F.col(c)) for c in ("Original_table_name", "Variable_name")})
    grouped = materialize(grouped.select(*metrics.LONG_COLUMNS), "grouped")
    out = None
    for name in wanted:
        table, score = SCORES[name]
        named = F.split("Original_table_name", _MARK)
        found = score(table(grouped).withColumns({"grouping": named[0], "group_name": named[1]}), "grouping", "group_name")
        found = found.select(F.lit(name).alias("metric"), "grouping", "group_name", "score")
        out = found if out is None else out.unionByName(found)
    return out


def group_disparities(scores: DataFrame) -> DataFrame:
    """metric, grouping, groups, mean, disparity: the mean of the groups' scores, and the largest distance of a group from it; groups without a score don't count."""
    middle = scores.groupBy("metric", "grouping").agg(F.avg("score").alias("mean"))  # a row for each metric and grouping
    far = scores.join(F.broadcast(middle), ["metric", "grouping"]).where("score is not null")
    return far.groupBy("metric", "grouping").agg(F.count("*").alias("groups"), round_scaled(F.first("mean"), 4).alias("mean"), round_scaled(F.max(F.abs(F.col("score") - F.col("mean"))), 4).alias("disparity"))
