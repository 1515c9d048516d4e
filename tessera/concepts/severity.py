"""Severity scores over the first day or the whole stay: organ dysfunction (LODS), simplified and acute physiology (SAPS II, APS III)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.concepts.comorbidity import flags_of, has_code
from tessera.concepts.scores import Rules, _by_stay, _invasive, _points, _total, case, ventilated_first_day
from tessera.operators.score import logistic

MASK_ITEM = 226732
# Published thresholds and points, in the order in which they are tried. Points of None: nothing was measured.
LODS: dict[str, Rules] = {
    "neurologic": [("gcs_min IS NULL OR gcs_min < 3", None), ("gcs_min <= 5", 5), ("gcs_min <= 8", 3), ("gcs_min <= 13", 1)],
    "cardiovascular": [
        ("heart_rate_max IS NULL AND sbp_min IS NULL", None), ("heart_rate_min < 30 OR sbp_min < 40", 5), ("sbp_min < 70 OR sbp_max >= 270", 3), ("heart_rate_max >= 140 OR sbp_max >= 240 OR sbp_min < 90", 1),
    ],
    "renal": [
        ("bun_max IS NULL OR urineoutput IS NULL OR creatinine_max IS NULL", None), ("urineoutput < 500 OR bun_max >= 56", 5), ("creatinine_max >= 1.6 OR urineoutput < 750 OR bun_max >= 28 OR urineoutput >= 10000", 3),
        ("creatinine_max >= 1.2 OR bun_max >= 7.5", 1),
    ],
    "pulmonary": [("pao2fio2_vent_min >= 150", 1), ("pao2fio2_vent_min < 150", 3)],
    "hematologic": [("wbc_max IS NULL AND platelets_min IS NULL", None), ("wbc_min < 1", 3), ("wbc_min < 2.5 OR platelets_min < 50 OR wbc_max >= 50", 1)],
    "hepatic": [("pt_max IS NULL AND bilirubin_total_max IS NULL", None), ("bilirubin_total_max >= 2 OR pt_max > 15 OR pt_min < 3", 1)],
}
SAPS: dict[str, Rules] = {
    "age_score": [("age IS NULL", None), ("age < 40", 0), ("age < 60", 7), ("age < 70", 12), ("age < 75", 15), ("age < 80", 16), ("true", 18)],
    "hr_score": [("heart_rate_max IS NULL", None), ("heart_rate_min < 40", 11), ("heart_rate_max >= 160", 7), ("heart_rate_max >= 120", 4), ("heart_rate_min < 70", 2)],
    "sysbp_score": [("sbp_min IS NULL", None), ("sbp_min < 70", 13), ("sbp_min < 100", 5), ("sbp_max >= 200", 2)],
    "temp_score": [("temperature_max IS NULL", None), ("temperature_max >= 39.0", 3)],
    "pao2fio2_score": [("pao2fio2_vent_min IS NULL", None), ("pao2fio2_vent_min < 100", 11), ("pao2fio2_vent_min < 200", 9), ("true", 6)],
    "uo_score": [("urineoutput IS NULL", None), ("urineoutput < 500", 11), ("urineoutput < 1000", 4)],
    "bun_score": [("bun_max IS NULL", None), ("bun_max < 28", 0), ("bun_max < 84", 6), ("true", 10)],
    "wbc_score": [("wbc_max IS NULL", None), ("wbc_min < 1", 12), ("wbc_max >= 20", 3)],
    "potassium_score": [("potassium_max IS NULL", None), ("potassium_min < 3 OR potassium_max >= 5", 3)],
    "sodium_score": [("sodium_max IS NULL", None), ("sodium_min < 125", 5), ("sodium_max >= 145", 1)],
    "bicarbonate_score": [("bicarbonate_max IS NULL", None), ("bicarbonate_min < 15", 6), ("bicarbonate_min < 20", 3)],
    "bilirubin_score": [("bilirubin_total_max IS NULL", None), ("bilirubin_total_max < 4", 0), ("bilirubin_total_max < 6", 4), ("true", 9)],
    "gcs_score": [("gcs_min IS NULL OR gcs_min NOT BETWEEN 3 AND 15", None), ("gcs_min < 6", 26), ("gcs_min < 9", 13), ("gcs_min < 11", 7), ("gcs_min < 14", 5)],
    "comorbidity_score": [("aids = 1", 17), ("hem = 1", 10), ("mets = 1", 9)],
    "admissiontype_score": [("surgical = 1 AND admission_type = 'ELECTIVE'", 0), ("surgical = 1 AND admission_type <> 'ELECTIVE'", 8), ("true", 6)],
}
#: Prefixes of codes by version, as in the comorbidity groups; pairs are ranges.
SAPS_GROUPS: dict[str, tuple[tuple, tuple]] = {
    "aids": ((("042", "044"),), (("B20", "B22"), "B24")),
    "hem": (
        (("20000", "20238"), ("20240", "20248"), ("20250", "20302"), ("20310", "20312"), ("20302", "20382"), ("20400", "20522"), ("20580", "20702"), ("20720", "20892"), "2386", "2733"), (("C81", "C96"),),
    ),
    "mets": ((("1960", "1991"), ("20970", "20975"), "20979", "78951"), (("C77", "C79"), "C800")),
}
#: score: value, its midpoint (None: the maximum counts), points below each bound, points beyond the last. The end of the day's range farther from the midpoint counts; of equally far ones the larger points.
APS: dict[str, tuple[str, float | None, list[tuple[float, int]], int]] = {
    "hr_score": ("heart_rate", 75, [(40, 8), (50, 5), (100, 0), (110, 1), (120, 5), (140, 7), (155, 13)], 17),
    "mbp_score": ("mbp", 90, [(40, 23), (60, 15), (70, 7), (80, 6), (100, 0), (120, 4), (130, 7), (140, 9)], 10),
    "temp_score": ("temperature", 38, [(33.0, 20), (33.5, 16), (34.0, 13), (35.0, 8), (36.0, 2), (40.0, 0)], 4),
    "resp_rate_score": ("resp_rate", 19, [(6, 17), (12, 8), (14, 7), (25, 0), (35, 6), (40, 9), (50, 11)], 18),
    "hematocrit_score": ("hematocrit", 45.5, [(41.0, 3), (50.0, 0)], 3),
    "wbc_score": ("wbc", 11.5, [(1.0, 19), (3.0, 5), (20.0, 0), (25.0, 1)], 5),
    "creatinine_score": ("creatinine", 1, [(0.5, 3), (1.5, 0), (1.95, 4)], 7),
    "bun_score": ("bun", None, [(17.0, 0), (20.0, 2), (40.0, 7), (80.0, 11)], 12),
    "sodium_score": ("sodium", 145.5, [(120, 3), (135, 2), (155, 0)], 4),
    "albumin_score": ("albumin", 3.5, [(2.0, 11), (2.5, 6), (4.5, 0)], 4),
    "bilirubin_score": ("bilirubin_total", None, [(2.0, 0), (3.0, 5), (5.0, 6), (8.0, 8)], 16),
    "glucose_score": ("glucose", 130, [(40, 8), (60, 9), (200, 0), (350, 3)], 5),
}
#: What goes before the bands of a value: quiet breathing of the ventilated, creatinine of the acutely ill kidney.
APS_FIRST: dict[str, Rules] = {"resp_rate_score": [("vent = 1 AND {x} < 14", 0)], "creatinine_score": [("arf = 1 AND {x} < 1.5", 0), ("arf = 1 AND {x} >= 1.5", 10)]}
APS_URINE: Rules = [
    ("urineoutput IS NULL", None), ("urineoutput < 400", 15), ("urineoutput < 600", 8), ("urineoutput < 900", 7), ("urineoutput < 1500", 5), ("urineoutput < 2000", 4), ("urineoutput < 4000", 0), ("true", 1),
]
APS_OXYGEN: Rules = [
    ("pao2 < 50", 15), ("pao2 < 70", 5), ("pao2 < 80", 2), ("pao2 IS NOT NULL", 0), ("aado2 < 100", 0), ("aado2 < 250", 7), ("aado2 < 350", 9), ("aado2 < 500", 11), ("aado2 >= 500", 14), ("true", None),
]
APS_COMA: Rules = [
    ("gcs_unable = 1", 0),
    ("gcs_eyes = 1 AND gcs_verbal = 1 AND gcs_motor IN (1, 2)", 48), ("gcs_eyes = 1 AND gcs_verbal = 1 AND gcs_motor IN (3, 4)", 33), ("gcs_eyes = 1 AND gcs_verbal = 1 AND gcs_motor IN (5, 6)", 16),
    ("gcs_eyes = 1 AND gcs_verbal IN (2, 3) AND gcs_motor IN (1, 2)", 29), ("gcs_eyes = 1 AND gcs_verbal IN (2, 3) AND gcs_motor IN (3, 4)", 24),
    ("gcs_eyes > 1 AND gcs_verbal = 1 AND gcs_motor IN (1, 2)", 29), ("gcs_eyes > 1 AND gcs_verbal = 1 AND gcs_motor IN (3, 4)", 24), ("gcs_eyes > 1 AND gcs_verbal = 1 AND gcs_motor IN (5, 6)", 15),
    ("gcs_eyes > 1 AND gcs_verbal IN (2, 3) AND gcs_motor IN (1, 2)", 29), ("gcs_eyes > 1 AND gcs_verbal IN (2, 3) AND gcs_motor IN (3, 4)", 24), ("gcs_eyes > 1 AND gcs_verbal IN (2, 3) AND gcs_motor = 5", 13),
    ("gcs_eyes > 1 AND gcs_verbal IN (2, 3) AND gcs_motor = 6", 10), ("gcs_eyes > 1 AND gcs_verbal = 4 AND gcs_motor BETWEEN 1 AND 4", 13), ("gcs_eyes > 1 AND gcs_verbal = 4 AND gcs_motor = 5", 8),
    ("gcs_eyes > 1 AND gcs_verbal = 4 AND gcs_motor = 6", 3), ("gcs_eyes > 1 AND gcs_verbal = 5 AND gcs_motor BETWEEN 1 AND 5", 3), ("gcs_eyes > 1 AND gcs_verbal = 5 AND gcs_motor = 6", 0), ("true", None),
]
APS_ACID: Rules = [
    ("ph IS NULL OR pco2 IS NULL", None), ("ph < 7.20 AND pco2 < 50", 12), ("ph < 7.20", 4),
    ("ph < 7.30 AND pco2 < 30", 9), ("ph < 7.30 AND pco2 < 40", 6), ("ph < 7.30 AND pco2 < 50", 3), ("ph < 7.30", 2),
    ("ph < 7.35 AND pco2 < 30", 9), ("ph < 7.45 AND pco2 < 30", 5), ("ph < 7.45 AND pco2 < 45", 0), ("ph < 7.45", 1),
    ("ph < 7.50 AND pco2 < 30", 5), ("ph < 7.50 AND pco2 < 35", 0), ("ph < 7.50 AND pco2 < 45", 2), ("ph < 7.50", 12),
    ("ph < 7.60 AND pco2 < 40", 3), ("ph < 7.60", 12), ("pco2 < 25", 0), ("pco2 < 40", 3), ("true", 12),
]
KIDNEY_FAILURE = (("5854", "5855", "5856"), ("N184", "N185", "N186"))
APS_NAMES = [
    "hr_score", "mbp_score", "temp_score", "resp_rate_score", "pao2_aado2_score", "hematocrit_score", "wbc_score", "creatinine_score", "uo_score", "bun_score", "sodium_score", "albumin_score",
    "bilirubin_score", "glucose_score", "acidbase_score", "gcs_score",
]


def bands(score: str, value: str) -> str:
    """Points of an extreme by the bands of its score, as SQL."""
    first = [(test.format(x=value), points) for test, points in APS_FIRST.get(score, [])]
    _, _, below, beyond = APS[score]
    return case([(f"{value} IS NULL", None), *first, *[(f"{value} < {bound}", points) for bound, points in below]], beyond)


def _masks(icustays: DataFrame, chart: DataFrame, pattern: str, opened: bool) -> DataFrame:
    """The time under a mask that helps breathing on the first day, an hour before its first record to four hours after its last; opened: a record at the very start of the stay doesn't count."""
    day, worn = F.col("intime") + F.expr("interval 1 day"), chart.where((F.col("itemid") == MASK_ITEM) & F.lower("value").rlike(pattern)).select(F.col("stay_id").alias("m_stay"), "charttime")
    begun = F.col("charttime") > F.col("intime") if opened else F.col("charttime") >= F.col("intime")
    rows = icustays.select("subject_id", "stay_id", "intime").join(worn, (F.col("stay_id") == F.col("m_stay")) & F.coalesce(begun & (F.col("charttime") <= day), F.lit(False)))
    return rows.groupBy("subject_id", "stay_id", "intime").agg((F.min("charttime") - F.expr("interval 1 hour")).alias("v_start"), (F.max("charttime") + F.expr("interval 4 hour")).alias("v_end"))


def _helped(gases: DataFrame, spans: DataFrame, begun: Column) -> DataFrame:
    """The least oxygenation ratio of each stay inside spans (v_stay, v_start, v_end); a semi join, so gases under both kinds of help count once."""
    inside = (F.col("stay_id") == F.col("v_stay")) & begun & (F.col("charttime") <= F.col("v_end"))
    return gases.join(spans, inside, "left_semi").groupBy("stay_id").agg(F.min("pao2fio2ratio").alias("pao2fio2_vent_min"))


def _during(icustays: DataFrame, bg: DataFrame) -> DataFrame:
    """Gases of an admission from the start of a stay until its end."""
    stays = icustays.select("stay_id", F.col("hadm_id").alias("s_hadm"), "intime", "outtime")
    return stays.join(bg, (F.col("s_hadm") == F.col("hadm_id")) & (F.col("charttime") >= F.col("intime")) & (F.col("charttime") < F.col("outtime")))


def lods(icustays, chart, bg, ventilation, scale, vitals, labs, urine) -> DataFrame:
    """Six organs; oxygenation counts only under invasive ventilation or a mask that helps breathing."""
    return lods_of(icustays, chart, bg, ventilation, labs, urine, scale, vitals)


def lods_of(icustays, chart, bg, ventilation, labs, urine, *days) -> DataFrame:
    """lods from days: coma scale and vitals of the first day, or one table of both."""
    masks = _masks(icustays, chart, "cpap|bipap mask", False).select(F.col("stay_id").alias("v_stay"), "v_start", "v_end")
    ratio = _helped(_during(icustays, bg).select("stay_id", "charttime", "pao2fio2ratio"), _invasive(ventilation).unionByName(masks), F.col("charttime") >= F.col("v_start"))
    labs = labs.select("stay_id", "bun_max", "wbc_min", "wbc_max", "bilirubin_total_max", "creatinine_max", "pt_min", "pt_max", "platelets_min")
    taken = ("gcs_min", "heart_rate_min", "heart_rate_max", "sbp_min", "sbp_max")
    parts = _by_stay(icustays, ratio, *[d.select("stay_id", *[c for c in taken if c in d.columns]) for d in days], urine.select("stay_id", "urineoutput"), labs)
    scored = parts.select("subject_id", "hadm_id", "stay_id", *[_points(r, n) for n, r in LODS.items()])
    return scored.select("subject_id", "hadm_id", "stay_id", _total(list(LODS)).alias("lods"), *LODS)


def _day(icustays: DataFrame, tables: list[DataFrame], key: str, columns: list[Column]) -> DataFrame:
    """Aggregates over the first day, its start left out, of all rows of some tables that have the stay's key: one join for all of them."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumnRenamed(key, "_key")
    inside = (F.col("charttime") > F.col("intime")) & (F.col("charttime") <= F.col("intime") + F.expr("interval 1 day"))
    joined = icustays.select("stay_id", F.col(key).alias("_of"), "intime").join(rows, (F.col("_of") == F.col("_key")) & F.coalesce(inside, F.lit(False)))
    return joined.groupBy("stay_id").agg(*columns)


def sapsii(icustays, admissions, age, services, diagnoses, chart, bg, ventilation, scales, vitals, urine, *labs) -> DataFrame:
    """Fifteen components of the first 24 hours and the probability that goes with their sum. A stay's masks help all stays of its patient at that time. labs: chemistry, blood count and enzymes, or one table of their columns."""
    day = F.expr("interval 1 day")
    masks = _masks(icustays, chart, "cpap mask|bipap", True).select(F.col("subject_id").alias("patient"), F.greatest("v_start", "intime").alias("v_start"), F.least("v_end", F.col("intime") + day).alias("v_end"))
    masks = masks.join(icustays.select(F.col("subject_id").alias("patient"), F.col("stay_id").alias("v_stay")), "patient").select("v_stay", "v_start", "v_end")
    art = bg.where("specimen = 'ART.'").select(F.col("subject_id").alias("patient"), "charttime", "pao2fio2ratio")
    near = (F.col("subject_id") == F.col("patient")) & (F.col("charttime") > F.col("intime")) & (F.col("charttime") <= F.col("intime") + day)
    ratio = _helped(icustays.join(art, near).select("stay_id", "charttime", "pao2fio2ratio"), _invasive(ventilation).unionByName(masks), F.col("charttime") > F.col("v_start"))
    chemistry, blood_count, enzyme = labs if len(labs) == 3 else labs * 3
    ends = {"heart_rate": vitals, "sbp": vitals, "temperature": vitals, "bun": chemistry, "potassium": chemistry, "sodium": chemistry, "bicarbonate": chemistry, "wbc": blood_count, "bilirubin_total": enzyme}
    tables = [t.select("subject_id", "charttime", *[F.col(n).cast("double").alias(n) for n, of in ends.items() if of is t]) for t in (vitals, *labs)]
    of_patient = _day(icustays, tables, "subject_id", [f(n).alias(f"{n}_{end}") for n in ends for f, end in ((F.min, "min"), (F.max, "max"))])
    of_stay = _day(icustays, [scales.select("stay_id", "charttime", "gcs"), urine.select("stay_id", "charttime", "urineoutput")], "stay_id", [F.min("gcs").alias("gcs_min"), F.sum("urineoutput").alias("urineoutput")])
    first = services.groupBy("hadm_id").agg(F.min(F.struct("transfertime", "curr_service")).alias("s")).select("hadm_id", F.lower("s.curr_service").contains("surg").cast("int").alias("surgical"))
    rows = icustays.join(admissions.select("hadm_id", "admission_type"), "hadm_id")
    for table in (age.select("hadm_id", "age"), first, flags_of(diagnoses, SAPS_GROUPS)):
        rows = rows.join(table, "hadm_id", "left")
    rows = _by_stay(rows, ratio, of_patient, of_stay)
    rows = rows.select("*", *[_points(r, n) for n, r in SAPS.items()]).withColumn("sapsii", _total(list(SAPS)))
    chance = logistic(F.lit(-7.7631) + F.lit(0.0737) * F.col("sapsii") + F.lit(0.9971) * F.ln(F.col("sapsii") + 1))
    return rows.select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("starttime"), (F.col("intime") + day).alias("endtime"), "sapsii", chance.alias("sapsii_prob"), *SAPS)


def _worst(score: str) -> Column:
    value, middle, _, _ = APS[score]
    low, high = F.expr(bands(score, f"{value}_min")), F.expr(bands(score, f"{value}_max"))
    if middle is None:
        return high.alias(score)
    below, above = F.abs(F.col(f"{value}_min") - middle), F.abs(F.col(f"{value}_max") - middle)
    chosen = F.when(above > below, high).when(above < below, low).otherwise(F.greatest(low, high))
    return (F.when(F.col("arf") == 1, high).otherwise(chosen) if score == "creatinine_score" else chosen).alias(score)


def apsiii(icustays, diagnoses, bg, ventilation, scale, vitals, urine, labs) -> DataFrame:
    """Sixteen components and the probability that goes with their sum; gases of the whole stay, the rest of the first day."""
    return apsiii_of(icustays, diagnoses, bg, ventilation, labs, scale, vitals, urine)


def apsiii_of(icustays, diagnoses, bg, ventilation, labs, *days) -> DataFrame:
    """apsiii from days: urine, coma scale and vitals of the first day, or one table of the latter two. Gases are read once: oxygen off and on invasive ventilation and the acid-base balance come from one aggregation."""
    art = _during(icustays, bg.where("specimen = 'ART.'")).select("stay_id", "charttime", "po2", "pco2", "ph", "aado2", F.coalesce("fio2", "fio2_chartevents").alias("share"))
    inside = (F.col("stay_id") == F.col("v_stay")) & (F.col("charttime") >= F.col("v_start")) & (F.col("charttime") <= F.col("v_end"))
    on = F.col("v_stay").isNotNull()
    gases = art.join(_invasive(ventilation), inside, "left").groupBy("stay_id").agg(
        F.max(F.when(~on & (F.coalesce("share", F.lit(21)) < 50), F.col("po2"))).alias("pao2"), F.max(F.when(on & (F.col("share") >= 50), F.col("aado2"))).alias("aado2"),
        F.max(F.expr(case(APS_ACID))).alias("acidbase_score"),
    )
    ill = diagnoses.groupBy("hadm_id").agg(F.max(F.when(has_code(F.col("icd_code"), F.col("icd_version"), KIDNEY_FAILURE), 1).otherwise(0)).alias("ckd"))
    labs = labs.withColumnsRenamed({"glucose_min": "l_glucose_min", "glucose_max": "l_glucose_max"})
    rows = _by_stay(icustays.join(ill, "hadm_id", "left"), gases, ventilated_first_day(icustays, ventilation).withColumnRenamed("mechvent", "vent"), *days, labs)
    rows = rows.withColumns({
        "glucose_max": F.greatest("glucose_max", "l_glucose_max"), "glucose_min": F.least("glucose_min", "l_glucose_min"),
        "arf": F.when((F.col("creatinine_max") >= 1.5) & (F.col("urineoutput") < 410) & (F.col("ckd") == 0), 1).otherwise(0),
    })
    rows = rows.select("subject_id", "hadm_id", "stay_id", "acidbase_score", *[_worst(n) for n in APS], _points(APS_URINE, "uo_score"), _points(APS_OXYGEN, "pao2_aado2_score"), _points(APS_COMA, "gcs_score"))
    rows = rows.withColumn("apsiii", _total(APS_NAMES))
    return rows.select("subject_id", "hadm_id", "stay_id", "apsiii", logistic(F.lit(-4.4360) + F.lit(0.04726) * F.col("apsiii")).alias("apsiii_prob"), *APS_NAMES)
