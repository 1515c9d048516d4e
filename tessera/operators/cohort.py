"""Cohort selection, exclusion flow and calibration."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Criteria:
    """Bounds are inclusive; prefixes match any or all of a person's codes' prefixes; None asks for nothing."""

    age_min: int | None = None
    age_max: int | None = None
    group: str | None = None
    prefixes: Sequence[str] = ()
    match_all: bool = False
    has_event: bool | None = None

    def __post_init__(self) -> None:
        if self.age_min is not None and self.age_max is not None and self.age_min > self.age_max:
            raise ValueError("age_min exceeds age_max")


def select_cohort(people: DataFrame, key: str, age: str, group: str, codes: DataFrame, code: str, events: DataFrame, criteria: Criteria) -> DataFrame:
    """Semi and anti joins stand for EXISTS and NOT EXISTS, so each side is scanned once and people are never multiplied."""
    out = people
    if criteria.age_min is not None:
        out = out.where(F.col(age) >= criteria.age_min)
    if criteria.age_max is not None:
        out = out.where(F.col(age) <= criteria.age_max)
    if criteria.group is not None:
        out = out.where(F.col(group) == criteria.group)
    wanted = [[p] for p in criteria.prefixes] if criteria.match_all else [list(criteria.prefixes)] if criteria.prefixes else []
    for prefixes in wanted:
        test = F.lit(False)
        for p in prefixes:
            test = test | F.col(code).startswith(p)
        out = out.join(codes.where(test).select(key), key, "left_semi")
    if criteria.has_event is not None:
        out = out.join(events.select(key), key, "left_semi" if criteria.has_event else "left_anti")
    return out


_CODE = re.compile(r"^[A-Za-z0-9.]+$")


@dataclass(frozen=True)
class AdmissionCriteria:
    """What admissions must be like; None asks for nothing. Codes are prefixes of letters, digits and dots; an admission must have any of them, or with match_all one of each."""

    age_min: int | None = None
    age_max: int | None = None
    gender: str | None = None
    codes: Sequence[str] = ()
    match_all: bool = False
    has_stay: bool | None = None
    died: bool | None = None

    def __post_init__(self) -> None:
        for name in ("age_min", "age_max"):
            age = getattr(self, name)
            if age is not None and (isinstance(age, bool) or not isinstance(age, int) or not 0 <= age <= 130):
                raise ValueError(f"{name} must be a whole number from 0 to 130")
        if self.age_min is not None and self.age_max is not None and self.age_min > self.age_max:
            raise ValueError("age_min exceeds age_max")
        if self.gender not in (None, "F", "M"):
            raise ValueError("gender must be F or M")
        if bad := [c for c in self.codes if not isinstance(c, str) or not _CODE.match(c)]:
            raise ValueError(f"codes hold letters, digits and dots only, not {bad}")
        for name in ("match_all", "has_stay", "died"):
            if not isinstance(getattr(self, name), (bool, type(None))):
                raise ValueError(f"{name} must be true or false")


def select_admissions(patients: DataFrame, admissions: DataFrame, diagnoses: DataFrame, icustays: DataFrame, criteria: AdmissionCriteria) -> DataFrame:
    """subject_id, hadm_id, gender, anchor_age, hospital_expire_flag of the admissions that meet all criteria.

    Codes are gathered once for each admission, whatever their number; stays and codes come in by semi and anti joins, so no admission is multiplied.
    """
    people = patients.select("subject_id", "gender", "anchor_age")
    if criteria.age_min is not None:
        people = people.where(F.col("anchor_age") >= criteria.age_min)
    if criteria.age_max is not None:
        people = people.where(F.col("anchor_age") <= criteria.age_max)
    if criteria.gender is not None:
        people = people.where(F.col("gender") == criteria.gender)
    chosen = admissions.select("subject_id", "hadm_id", "hospital_expire_flag")
    if criteria.died is not None:
        chosen = chosen.where(F.col("hospital_expire_flag") == int(criteria.died))
    chosen = chosen.join(people, "subject_id")
    if criteria.codes:
        held = [F.bool_or(F.col("icd_code").startswith(c)) for c in criteria.codes]
        having = reduce(lambda a, b: a & b if criteria.match_all else a | b, held)
        chosen = chosen.join(diagnoses.groupBy("hadm_id").agg(having.alias("_has")).where("_has").select("hadm_id"), "hadm_id", "left_semi")
    if criteria.has_stay is not None:
        chosen = chosen.join(icustays.select("hadm_id"), "hadm_id", "left_semi" if criteria.has_stay else "left_anti")
    return chosen.select("subject_id", "hadm_id", "gender", "anchor_age", "hospital_expire_flag")


def admission_counts(chosen: DataFrame, icustays: DataFrame | None = None) -> DataFrame:
    """patient_count, admission_count, and icu_stay_count where the stays are given."""
    counts = chosen.agg(F.count_distinct("subject_id").alias("patient_count"), F.count_distinct("hadm_id").alias("admission_count"))
    if icustays is None:
        return counts
    stays = icustays.join(chosen.select("hadm_id").distinct(), "hadm_id", "left_semi").agg(F.count_distinct("stay_id").alias("icu_stay_count"))
    return counts.crossJoin(stays)  # one row each


def age_bands(cohort: DataFrame, key: str, age: str, first: int = 20, step: int = 10, last: int = 90) -> DataFrame:
    band = F.when(F.col(age) < first, f"0-{first - 1}").when(F.col(age) >= last, f"{last}+")
    low = (F.floor(F.col(age) / step) * step).cast("int")
    band = band.otherwise(F.concat(low.cast("string"), F.lit("-"), (low + step - 1).cast("string")))
    return cohort.groupBy(band.alias("band")).agg(F.count_distinct(key).alias("n"))


def standardised_difference(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    return F.try_divide(mean_a - mean_b, F.sqrt((var_a + var_b) / 2))


def category_bias(df: DataFrame, kept: Column, variables: Sequence[str]) -> DataFrame:
    """variable_name, category, n_kept, n_excluded, share_kept, share_excluded, smd (of the two shares) for each value of each variable; nulls are a category without a name. Rows are laid out once for all variables,
    and counts leave each task before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable_name"), F.col(v).cast("string").alias("category")) for v in variables])
    rows = df.select(F.coalesce(kept, F.lit(False)).alias("_kept"), F.explode(pairs).alias("p")).select("_kept", "p.*")
    per = rows.groupBy("variable_name", "category").agg(F.count_if("_kept").alias("n_kept"), F.count_if(~F.col("_kept")).alias("n_excluded"))
    every = Window.partitionBy("variable_name")
    shares = per.withColumns({f"share_{s}": F.try_divide(F.col(f"n_{s}"), F.sum(f"n_{s}").over(every)) for s in ("kept", "excluded")})
    p, q = F.col("share_kept"), F.col("share_excluded")
    return shares.withColumn("smd", standardised_difference(p, p * (1 - p), q, q * (1 - q)))


def exclusion_bias(df: DataFrame, kept: Column, variables: Sequence[str]) -> DataFrame:
    """variable_name, smd between kept and excluded rows, from one aggregation."""
    aggs = [f(F.when(side, F.col(v))).alias(f"{n}_{s}_{v}") for v in variables for s, side in (("k", kept), ("x", ~kept)) for n, f in (("m", F.avg), ("v", F.var_samp))]
    row = df.agg(*aggs)
    smd = [standardised_difference(F.col(f"m_k_{v}"), F.col(f"v_k_{v}"), F.col(f"m_x_{v}"), F.col(f"v_x_{v}")).alias(v) for v in variables]
    return row.select(F.lit(1).alias("one"), *smd).unpivot(["one"], list(variables), "variable_name", "smd").drop("one")


def calibration(df: DataFrame, score: str, outcome: str, probability: str, width: int = 10) -> DataFrame:
    """Observed and expected events and rates by score band; what is expected comes from a probability column."""
    band = (F.floor(F.col(score) / width) * width).cast("long").alias("band")
    return df.groupBy(band).agg(
        F.count("*").alias("n"), F.sum(outcome).alias("observed"), F.sum(probability).alias("expected"), F.avg(outcome).alias("observed_rate"), F.avg(probability).alias("expected_rate")
    )


def exclusion_flow(df: DataFrame, steps: Sequence[tuple[str, Column]], variables: Sequence[str], flag: float = 0.2, high: float = 0.3) -> DataFrame:
    """step, label, variable_name, n_before, n_kept, n_excluded, n_missing, smd, bias: each step keeps rows of those that the steps before kept, and one pass over the rows counts all of them."""
    reached = F.lit(True)
    aggregates = []
    for i, (_, keep) in enumerate(steps):
        kept, out = reached & F.coalesce(keep, F.lit(False)), reached & ~F.coalesce(keep, F.lit(False))
        aggregates += [F.count_if(reached).alias(f"n_{i}"), F.count_if(kept).alias(f"k_{i}")]
        for v in variables:
            aggregates += [F.count_if(reached & F.col(v).isNull()).alias(f"miss_{i}_{v}")]
            aggregates += [f(F.when(side, F.col(v))).alias(f"{n}_{s}_{i}_{v}") for s, side in (("k", kept), ("x", out)) for n, f in (("m", F.avg), ("v", F.var_samp))]
        reached = kept
    row = df.agg(*aggregates)
    lines = [
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.lit(v).alias("variable_name"), F.col(f"n_{i}").alias("n_before"), F.col(f"k_{i}").alias("n_kept"), F.col(f"miss_{i}_{v}").alias("n_missing"),
            standardised_difference(F.col(f"m_k_{i}_{v}"), F.col(f"v_k_{i}_{v}"), F.col(f"m_x_{i}_{v}"), F.col(f"v_x_{i}_{v}")).alias("smd"),
        ) for i, (label, _) in enumerate(steps) for v in variables
    ]
    found = row.select(F.explode(F.array(*lines)).alias("r")).select("r.*").withColumn("n_excluded", F.col("n_before") - F.col("n_kept"))
    return found.withColumn("bias", F.when(F.abs("smd") > high, "High").when(F.abs("smd") > flag, "Flagged").when(F.col("smd").isNotNull(), "Low"))
