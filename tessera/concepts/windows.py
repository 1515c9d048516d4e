"""Scores over other windows than the first day: from six hours before the stay to a given number of hours after its start, missing organs counted as normal."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.concepts.scores import BREATH_DAY, COMA, LIVER, PLATELETS, PRESSORS, SIRS, Rules, _by_stay, _points, _ratios, _total
from tessera.operators.timeops import window_join

BEFORE = 6
# Urine plays no part in a short window, and only rates above 0 count as given.
CIRCULATION: Rules = [
    ("rate_dopamine > 15 OR rate_epinephrine > 0.1 OR rate_norepinephrine > 0.1", 4),
    ("rate_dopamine > 5 OR (rate_epinephrine > 0 AND rate_epinephrine <= 0.1) OR (rate_norepinephrine > 0 AND rate_norepinephrine <= 0.1)", 3), ("rate_dopamine > 0 OR rate_dobutamine > 0", 2), ("mbp_min < 70", 1),
    ("coalesce(mbp_min, rate_dopamine, rate_dobutamine, rate_epinephrine, rate_norepinephrine) IS NULL", None),
]
KIDNEY: Rules = [("creatinine_max >= 5.0", 4), ("creatinine_max >= 3.5", 3), ("creatinine_max >= 2.0", 2), ("creatinine_max >= 1.2", 1), ("creatinine_max IS NULL", None)]
ORGANS = {"respiration": BREATH_DAY, "coagulation": PLATELETS, "liver": LIVER, "cardiovascular": CIRCULATION, "cns": COMA, "renal": KIDNEY}


def _within(icustays: DataFrame, rows: DataFrame, key: str, hours: int) -> DataFrame:
    """Stays with the rows of their key in the window, ends included; stays without one keep a row."""
    stays = icustays.select(F.col(key).alias("_owner"), "stay_id", (F.col("intime") - F.expr(f"interval {BEFORE} hour")).alias("_low"), (F.col("intime") + F.expr(f"interval {hours} hour")).alias("_high"))
    found = rows.withColumnRenamed(key, "_owner").drop("subject_id", "hadm_id", "stay_id")
    return window_join(stays, found, "_owner", "charttime", "_low", "_high", "both", (BEFORE + hours) * 3_600_000_000)


def _extremes(icustays: DataFrame, rows: DataFrame, key: str, hours: int, *columns: Column) -> DataFrame:
    return _within(icustays, rows, key, hours).groupBy("stay_id").agg(*columns)


def _scored(icustays: DataFrame, parts: DataFrame, rules: dict[str, Rules], total: str) -> DataFrame:
    scored = parts.select("stay_id", *[_points(r, n) for n, r in rules.items()])
    joined = icustays.select("subject_id", "hadm_id", "stay_id").join(scored, "stay_id", "left")
    return joined.select("subject_id", "hadm_id", "stay_id", _total(list(rules)).alias(total), *[F.coalesce(n, F.lit(0)).alias(n) for n in rules])


def early_sofa(icustays, bg, ventilation, vitals, chemistry, enzyme, blood_count, scales, *pressors, hours: int = 12, labs: DataFrame | None = None) -> DataFrame:
    """Organ failure over the first hours; gases of every specimen count. pressors: norepinephrine, epinephrine, dopamine, dobutamine. labs: one table that stands for chemistry, enzymes and blood count."""
    given = None
    for name, table in zip(PRESSORS, pressors, strict=True):
        rows = table.select("stay_id", F.col("starttime").alias("charttime"), F.col("vaso_rate").alias(f"rate_{name}"))
        given = rows if given is None else given.unionByName(rows, allowMissingColumns=True)
    if labs is None:
        for table, column in ((chemistry, "creatinine"), (enzyme, "bilirubin_total"), (blood_count, "platelet")):
            rows = table.select("hadm_id", "charttime", column)
            labs = rows if labs is None else labs.unionByName(rows, allowMissingColumns=True)
    labs = labs.select("hadm_id", "charttime", "creatinine", "bilirubin_total", "platelet")
    worst = F.max("creatinine").alias("creatinine_max"), F.max("bilirubin_total").alias("bilirubin_max"), F.min("platelet").alias("platelet_min")
    parts = _by_stay(
        icustays.select("stay_id"), _ratios(_within(icustays, bg.select("subject_id", "charttime", "pao2fio2ratio"), "subject_id", hours).select("stay_id", "charttime", "pao2fio2ratio"), ventilation, ["stay_id"]),
        _extremes(icustays, vitals.select("stay_id", "charttime", "mbp"), "stay_id", hours, F.min("mbp").alias("mbp_min")), _extremes(icustays, labs, "hadm_id", hours, *worst),
        _extremes(icustays, scales.select("stay_id", "charttime", "gcs"), "stay_id", hours, F.min("gcs").alias("gcs_min")),
        _extremes(icustays, given, "stay_id", hours, *[F.max(f"rate_{n}").alias(f"rate_{n}") for n in PRESSORS]),
    )
    return _scored(icustays, parts, ORGANS, "sofa")


def early_sirs(icustays, vitals, bg, blood_count, differential=None, hours: int = 12) -> DataFrame:
    """Signs of inflammation over the first hours; of gases the arterial ones count. Without a differential the blood count holds its columns."""
    arterial = bg.where("specimen = 'ART.'").select("subject_id", "charttime", "pco2")
    cells = blood_count.select("subject_id", "charttime", "wbc", *(["bands"] if differential is None else []))
    if differential is not None:
        cells = cells.unionByName(differential.select("subject_id", "charttime", "bands"), allowMissingColumns=True)
    signs = [F.min("temperature").alias("temperature_min"), F.max("temperature").alias("temperature_max"), F.max("heart_rate").alias("heart_rate_max"), F.max("resp_rate").alias("resp_rate_max")]
    parts = _by_stay(
        icustays.select("stay_id"), _extremes(icustays, vitals.select("stay_id", "charttime", "temperature", "heart_rate", "resp_rate"), "stay_id", hours, *signs),
        _extremes(icustays, arterial, "subject_id", hours, F.min("pco2").alias("paco2_min")),
        _extremes(icustays, cells, "subject_id", hours, F.min("wbc").alias("wbc_min"), F.max("wbc").alias("wbc_max"), F.max("bands").alias("bands_max")),
    )
    return _scored(icustays, parts, SIRS, "sirs")


def sofa_12h_of(icustays, bg, ventilation, vitals, labs, scales, *pressors) -> DataFrame:
    """sofa_12h from one table of laboratory values."""
    return early_sofa(icustays, bg, ventilation, vitals, None, None, None, scales, *pressors, hours=12, labs=labs)


sofa_12h, sirs_12h = partial(early_sofa, hours=12), partial(early_sirs, hours=12)
