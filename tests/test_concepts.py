from datetime import datetime, timedelta

import pytest

from tessera.concepts import build, infusions, measurements, stays

T = datetime(2150, 1, 1, 10, 30)
HOUR = timedelta(hours=1)
LAB = "subject_id long, hadm_id long, specimen_id long, itemid int, charttime timestamp_ntz, valuenum double"
CHART = "subject_id long, stay_id long, charttime timestamp_ntz, itemid int, value string, valuenum double"
INPUT = "stay_id long, linkorderid long, itemid int, rate double, rateuom string, amount double, patientweight double, starttime timestamp_ntz, endtime timestamp_ntz"
STAY = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"


def rows(df, *by):
    return [r.asDict() for r in df.orderBy(*by).collect()]


def test_laboratory_tables(spark):
    lab = spark.createDataFrame([(1, 7, 10, 50868, T, -3.0), (1, None, 10, 50912, T, 151.0), (1, 7, 11, 50912, T, 1.5), (1, 7, 11, 50912, T, -1.0), (1, 7, 12, 50912, T, None)], LAB)
    found = rows(measurements.chemistry(lab), "specimen_id")
    assert [(r["specimen_id"], r["hadm_id"], r["aniongap"], r["creatinine"]) for r in found] == [(10, 7, -3.0, None), (11, 7, None, 1.5)]
    assert measurements.inflammation(lab).count() == 0


def test_chart_tables(spark):
    chart = spark.createDataFrame(
        [(1, 5, T, 223761, "98.6", 98.6), (1, 5, T, 220045, "80", 80.0), (1, 5, T, 220045, "300", 300.0), (1, 5, T, 224642, "Oral", None), (1, None, T, 220045, "70", 70.0),
         (1, 5, T, 223835, "0.5", 0.5), (1, 5, T, 220339, "101", 101.0), (1, 5, T, 223849, "CMV", None), (1, 5, T, 226730, "180", 180.0), (1, 5, T, 226707, "60", 60.0)], CHART
    )
    (vital,) = rows(measurements.vitalsign(chart), "charttime")
    assert (vital["heart_rate"], float(vital["temperature"]), vital["temperature_site"], vital["sbp"]) == (80.0, 37.0, "Oral", None)
    (setting,) = rows(measurements.ventilator_setting(chart), "charttime")
    assert (setting["stay_id"], setting["fio2"], setting["peep"], setting["ventilator_mode"]) == (5, 50.0, None, "CMV")
    assert [float(r["height"]) for r in rows(measurements.height(chart), "charttime")] == [180.0]


def test_urine_counts_irrigant_against(spark):
    out = spark.createDataFrame([(5, T, 226559, 100.0), (5, T, 227488, 30.0), (5, T, 227489, 10.0), (5, T, 1, 9.0)], "stay_id long, charttime timestamp_ntz, itemid int, value double")
    assert rows(measurements.urine_output(out), "charttime") == [{"stay_id": 5, "charttime": T, "urineoutput": 80.0}]


def test_agents(spark):
    given = spark.createDataFrame(
        [(5, 1, 221906, 0.001, "mg/kg/min", 1.0, 80.0, T, T + 2 * HOUR), (5, 2, 222315, 0.04, "units/min", 1.0, 80.0, T + HOUR, T + 3 * HOUR), (6, 3, 221749, 50.0, "mcg/min", 1.0, 0.0, T, T + HOUR)], INPUT
    )
    found = rows(infusions.vasoactive_agent(given).where("stay_id = 5"), "starttime")
    assert [(r["norepinephrine"], r["vasopressin"]) for r in found] == [(1.0, None), (1.0, pytest.approx(2.4)), (None, pytest.approx(2.4))]
    doses = rows(infusions.norepinephrine_equivalent_dose(infusions.vasoactive_agent(given)), "starttime")
    assert [float(r["norepinephrine_equivalent_dose"]) for r in doses] == [1.0, 1.1, 0.1]


def test_stays(spark):
    stay = spark.createDataFrame([(1, 7, 5, T, T + 48 * HOUR), (2, 8, 6, T, T)], STAY)
    chart = spark.createDataFrame([(1, 5, T, 220045, "80", 80.0), (1, 5, T + 2 * HOUR, 220045, "90", 90.0)], CHART)
    hours = rows(stays.icustay_hourly(stays.icustay_times(chart, stay)), "hr")
    assert (len(hours), hours[0]["hr"], hours[-1]["hr"], hours[24]["endtime"]) == (27, -24, 2, datetime(2150, 1, 1, 11))
    first = rows(stays.first_day_vitalsign(stay, measurements.vitalsign(chart)), "stay_id")
    assert [(r["stay_id"], r["heart_rate_min"], r["heart_rate_mean"]) for r in first] == [(5, 80.0, 85.0), (6, None, None)]
    lab = spark.createDataFrame([(1, 7, 1, 50912, T - 3 * 24 * HOUR, 0.5), (1, 7, 2, 50912, T, 1.0), (1, 7, 3, 50912, T + 48 * HOUR, 2.0)], LAB)
    found = rows(stays.kdigo_creatinine(lab, stay).where("stay_id = 5"), "charttime")
    assert [(r["creat"], r["creat_low_past_48hr"], r["creat_low_past_7day"]) for r in found] == [(0.5, None, None), (1.0, None, 0.5), (2.0, 1.0, 0.5)]


def test_age(spark):
    admitted = spark.createDataFrame([(1, 7, datetime(2150, 1, 1))], "subject_id long, hadm_id long, admittime timestamp_ntz")
    assert rows(stays.age(admitted, spark.createDataFrame([(1, 60, 2150)], "subject_id long, anchor_age int, anchor_year int")), "hadm_id")[0]["age"] == 60.0


def test_differential_imputes_counts(spark):
    lab = spark.createDataFrame([(1, 7, 1, 51301, T, 8.0), (1, 7, 1, 51256, T, 50.0), (1, 7, 1, 51199, T, 200.0), (1, 7, 2, 51256, T, 50.0)], LAB)
    found = rows(measurements.blood_differential(lab), "specimen_id")
    assert [(float(r["neutrophils_abs"] or -1), float(r["eosinophils_abs"] or -1)) for r in found] == [(4.0, 0.2), (-1.0, -1.0)]


def test_build_by_name(spark):
    drugs = spark.createDataFrame([(1, 7, "Lisinopril 5mg", T, T), (1, 7, "Aspirin EC", T, T), (1, 7, None, T, T)], "subject_id long, hadm_id long, drug string, starttime timestamp_ntz, stoptime timestamp_ntz")
    assert [r["acei"] for r in rows(build("acei", lambda _: drugs), "acei")] == ["Lisinopril 5mg"]
    assert [r["nsaid"] for r in rows(build("nsaid", lambda _: drugs), "nsaid")] == ["Aspirin EC"]
    base = {
        "icustays": spark.createDataFrame([(1, 7, 5, T, T)], STAY),
        "outputevents": spark.createDataFrame([(5, T - HOUR, 226559, 1.0), (5, T + HOUR, 226559, 2.0)], "stay_id long, charttime timestamp_ntz, itemid int, value double"),
    }
    assert rows(build("first_day_urine_output", base.get), "stay_id") == [{"subject_id": 1, "stay_id": 5, "urineoutput": 2.0}]
