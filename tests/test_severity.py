from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.concepts import severity
from tessera.concepts.elixhauser import elixhauser

T = datetime(2150, 1, 1, 10, 30)
HOUR = timedelta(hours=1)
STAY = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"
GAS = "subject_id long, hadm_id long, charttime timestamp_ntz, specimen string, po2 double, pco2 double, ph double, aado2 double, fio2 double, fio2_chartevents double, pao2fio2ratio double"


def one_row(spark, **values):
    kinds = {int: "bigint", float: "double", type(None): "double"}
    return spark.range(1).select(*[F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in values.items()])


def tables(spark):
    stays = spark.createDataFrame([(1, 7, 5, T, T + 48 * HOUR), (2, 8, 6, T, T + HOUR)], STAY)
    bg = spark.createDataFrame(
        [
            (1, 7, T + HOUR, "ART.", 60.0, 25.0, 7.25, None, None, None, 90.0), (1, 7, T + 30 * HOUR, "ART.", 75.0, 45.0, 7.4, None, 40.0, None, 200.0), (1, 7, T + 10 * HOUR, "ART.", 300.0, None, 7.4, 360.0, 60.0, None, 120.0),
            (1, 7, T + 48 * HOUR, "ART.", 400.0, 20.0, 7.1, None, None, None, 10.0), (1, 7, T + 2 * HOUR, "VEN.", 500.0, 20.0, 7.1, None, None, None, 20.0),
        ], GAS,
    )
    vent = spark.createDataFrame([(5, T + 9 * HOUR, T + 11 * HOUR, "InvasiveVent"), (5, T, T + 40 * HOUR, "Oxygen")], "stay_id long, starttime timestamp_ntz, endtime timestamp_ntz, ventilation_status string")
    chart = spark.createDataFrame([(5, T, 226732, "CPAP mask ")], "stay_id long, charttime timestamp_ntz, itemid int, value string")
    return stays, bg, vent, chart


def test_organ_dysfunction(spark):
    stays, bg, vent, chart = tables(spark)
    scale, vitals = one_row(spark, stay_id=5, gcs_min=8), one_row(spark, stay_id=5, heart_rate_min=80.0, heart_rate_max=150.0, sbp_min=95.0, sbp_max=130.0)
    labs = one_row(spark, stay_id=5, bun_max=10.0, wbc_min=2.0, wbc_max=9.0, bilirubin_total_max=None, creatinine_max=1.0, pt_min=2.0, pt_max=12.0, platelets_min=200.0)
    found = {r["stay_id"]: r.asDict() for r in severity.lods(stays, chart, bg, vent, scale, vitals, labs, one_row(spark, stay_id=5, urineoutput=800.0)).collect()}
    assert [found[5][n] for n in ("lods", *severity.LODS)] == [10, 3, 1, 1, 3, 1, 1]  # the venous ratio of 20 under the mask counts
    assert [found[6][n] for n in ("lods", *severity.LODS)] == [0, None, None, None, 0, None, None]


def test_acute_physiology(spark):
    stays, bg, vent, _ = tables(spark)
    extremes = {"heart_rate": (70, 80), "mbp": (60, 120), "temperature": (37, 39), "resp_rate": (5, 20), "glucose": (50, 100)}
    vitals = one_row(spark, stay_id=5, **{f"{n}_{end}": float(v) for n, pair in extremes.items() for end, v in zip(("min", "max"), pair)})
    values = {"hematocrit": (30, 46), "wbc": (2, 21), "creatinine": (1, 2), "bun": (18, 19), "sodium": (136, 155), "albumin": (None, None), "bilirubin_total": (1, 4), "glucose": (90, 210)}
    labs = one_row(spark, stay_id=5, **{f"{n}_{end}": None if v is None else float(v) for n, pair in values.items() for end, v in zip(("min", "max"), pair)})
    codes = spark.createDataFrame([(7, "N181", 10)], "hadm_id long, icd_code string, icd_version int")
    scale = one_row(spark, stay_id=5, gcs_min=9, gcs_motor=5, gcs_verbal=2, gcs_eyes=2, gcs_unable=0)
    found = {r["stay_id"]: r.asDict() for r in severity.apsiii(stays, codes, bg, vent, scale, vitals, one_row(spark, stay_id=5, urineoutput=400.0), labs).collect()}
    # heart: both ends 5 off; pressure: both 30 off; temperature: both 1 off; breathing: 5 is farther off but ventilated; glucose: 50 and 210 are 80 off
    expected = {
        "hr_score": 0, "mbp_score": 7, "temp_score": 0, "resp_rate_score": 0, "pao2_aado2_score": 2, "hematocrit_score": 3, "wbc_score": 5, "creatinine_score": 10, "uo_score": 8, "bun_score": 2, "sodium_score": 4,
        "albumin_score": None, "bilirubin_score": 6, "glucose_score": 9, "acidbase_score": 9, "gcs_score": 13,
    }
    assert {n: found[5][n] for n in severity.APS_NAMES} == expected
    assert found[5]["apsiii"] == sum(v or 0 for v in expected.values())
    assert found[6]["apsiii"] == 0


def test_simplified_physiology(spark):
    stays, bg, vent, chart = tables(spark)
    admissions = spark.createDataFrame([(7, "ELECTIVE"), (8, "URGENT")], "hadm_id long, admission_type string")
    services = spark.createDataFrame([(7, T, "CSURG"), (7, T + HOUR, "MED"), (8, T, "NSURG")], "hadm_id long, transfertime timestamp_ntz, curr_service string")
    codes = spark.createDataFrame([(7, "C787", 10), (7, "20280", 9), (8, "4019", 9)], "hadm_id long, icd_code string, icd_version int")
    at = lambda name, *points: spark.createDataFrame([(1, 5, T + h * HOUR, float(v)) for h, v in points], f"subject_id long, stay_id long, charttime timestamp_ntz, {name} double")
    vitals = at("heart_rate", (0, 30), (1, 100), (25, 170)).withColumns({"sbp": F.lit(120.0), "temperature": F.lit(39.0)})
    chemistry = at("bun", (2, 28)).withColumns({"potassium": F.lit(4.0), "sodium": F.lit(145.0), "bicarbonate": F.lit(19.0)})
    ages = spark.createDataFrame([(7, 72.5)], "hadm_id long, age double")
    found = {
        r["stay_id"]: r.asDict()
        for r in severity.sapsii(
            stays, admissions, ages, services, codes, chart, bg, vent, at("gcs", (3, 9)), vitals, at("urineoutput", (1, 400), (24, 400), (26, 9000)), chemistry, at("wbc", (1, 25)), at("bilirubin_total", (1, 5)),
        ).collect()
    }
    # the mask's record at the very start doesn't count, so only the gas of the tenth hour does; the pulse of 30 stands at the start, that of 170 after the day
    expected = [15, 0, 0, 3, 9, 4, 6, 3, 0, 1, 3, 4, 7, 10, 0]
    assert [found[5][n] for n in severity.SAPS] == expected and found[5]["sapsii"] == sum(expected)
    assert [found[6][n] for n in severity.SAPS] == [None] * 13 + [0, 8]


def test_elixhauser_groups(spark):
    admissions = spark.createDataFrame([(1, 7), (1, 8)], "subject_id long, hadm_id long")
    rows = [(7, 1, "I500", 10), (7, 2, "C509", 10), (7, 3, "C780", 10), (7, 4, "25000", 9), (7, 5, "E112", 10), (7, 6, "C4A0", 10), (7, 7, "4255", 9), (7, 8, "I109", 10)]
    found = {r["hadm_id"]: r.asDict() for r in elixhauser(admissions, spark.createDataFrame(rows, "hadm_id long, seq_num int, icd_code string, icd_version int")).collect()}
    on = {n for n, v in found[7].items() if v == 1 and not n.endswith("_id")}
    assert on == {"metastatic_cancer", "diabetes_complicated", "congestive_heart_failure", "alcohol_abuse", "hypertension"}
    assert (found[7]["elixhauser_count"], found[7]["elixhauser_vanwalraven"], found[8]["elixhauser_count"]) == (5, 19, 0)
