"""The long format of small source tables, row by row."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import compat
from tessera.quality import longform, metrics

T = datetime(2150, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "patients": spark.createDataFrame([(2, "F", 40, None), (1, None, 50, T)], "subject_id long, gender string, anchor_age int, dod timestamp_ntz"),
        "prescriptions": spark.createDataFrame([(1, 10, T, None, "MAIN", "Aspirin", "5", "mg", "PO")], "subject_id long, hadm_id long, starttime timestamp_ntz, stoptime timestamp_ntz, drug_type string, drug string, dose_val_rx string, dose_unit_rx string, route string"),
        "labevents": spark.createDataFrame([(1, 10, 7, T, "1.5", 1.5, "mg", None), (1, 10, 8, T, "POS", None, None, "abnormal")], "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, valueuom string, flag string"),
        "chartevents": spark.createDataFrame([(1, 10, 5, T, "Yes", None)], "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, value string, valuenum double"),
        "d_labitems": spark.createDataFrame([(7, "Glucose", "Blood"), (9, "x", None)], "itemid long, label string, fluid string"),
        "d_items": spark.createDataFrame([(5, "Cough")], "itemid long, label string"),
        "discharge": spark.createDataFrame([(1, 10, "DS", 3, T, None, "Words.")], "subject_id long, hadm_id long, note_type string, note_seq int, charttime timestamp_ntz, storetime timestamp_ntz, text string"),
        "radiology": spark.createDataFrame([(1, None, "RR", 1, None, None, None)], "subject_id long, hadm_id long, note_type string, note_seq int, charttime timestamp_ntz, storetime timestamp_ntz, text string"),
        "unknown": spark.createDataFrame([(1,)], "a int"),
    }


def test_every_row(tables):
    long = longform.build_long(tables, radiology=F.lit("CR"))
    assert tuple(long.columns) == metrics.LONG_COLUMNS
    found = {(r["Original_table_name"], r["Primary_key"], r["Variable_name"]): r for r in long.collect()}
    short = {k: (r["Value"], r["Variable_type"], r["Is_categorical"], r["Event_date"], r["Unit"], r["Mapping_info_1"], r["Mapping_info_2"]) for k, r in found.items()}
    at = "2150-01-02 03:04:05"
    assert short == {
        ("PATIENTS", 0, "gender"): ("", "", "1", None, None, None, None), ("PATIENTS", 0, "anchor_age"): ("50", "numeric", "0", None, None, None, None), ("PATIENTS", 0, "dod"): (at, "timestamp", "0", None, None, "date", None),
        ("PATIENTS", 1, "gender"): ("F", "string", "1", None, None, None, None), ("PATIENTS", 1, "anchor_age"): ("40", "numeric", "0", None, None, None, None), ("PATIENTS", 1, "dod"): ("", "", "0", None, None, "date", None),
        ("PRESCRIPTIONS", 0, "starttime"): (at, "timestamp", "0", None, None, "date", None), ("PRESCRIPTIONS", 0, "stoptime"): ("", "", "0", None, None, "date", None),
        ("PRESCRIPTIONS", 0, "drug_type"): ("MAIN", "string", "1", at, None, None, None), ("PRESCRIPTIONS", 0, "drug"): ("Aspirin", "string", "0", at, None, "prescription", "drug"),
        ("PRESCRIPTIONS", 0, "dose_val_rx"): ("5", "numeric", "0", None, "mg", "prescription", "prescription_info"), ("PRESCRIPTIONS", 0, "route"): ("PO", "string", "1", None, None, "prescription", "prescription_info"),
        ("LABEVENTS", 0, "Glucose_Blood"): ("1.5", "numeric", "0", at, "mg", "event", "lab_event"), ("LABEVENTS", 0, "valuenum"): ("1.5", "numeric", "0", at, "mg", "event", "lab_event"),
        ("LABEVENTS", 0, "flag"): ("", "", "1", at, None, None, None), ("LABEVENTS", 1, "8"): ("POS", "string", "0", at, None, "event", "lab_event"),
        ("LABEVENTS", 1, "valuenum"): ("", "", "0", at, None, "event", "lab_event"), ("LABEVENTS", 1, "flag"): ("abnormal", "string", "1", at, None, None, None),
        ("CHARTEVENTS", 0, "Cough"): ("Yes", "string", "1", at, None, "event", "chart_event"), ("CHARTEVENTS", 0, "valuenum"): ("", "", "0", at, None, "event", "chart_event"),
        ("DISCHARGE", 0, "text"): ("Words.", "string", "0", at, None, "note_clinical", "DIS"), ("DISCHARGE", 0, "storetime"): ("", "", "0", None, None, "date", None),
        ("DISCHARGE", 0, "note_type"): ("DS", "string", "1", None, None, None, None), ("DISCHARGE", 0, "note_seq"): ("3", "numeric", "0", None, None, None, None),
        ("RADIOLOGY", 0, "text"): ("", "string", "0", None, None, "note_rad", "CR"), ("RADIOLOGY", 0, "storetime"): ("", "", "0", None, None, "date", None),
        ("RADIOLOGY", 0, "note_type"): ("RR", "string", "1", None, None, None, None), ("RADIOLOGY", 0, "note_seq"): ("1", "numeric", "0", None, None, None, None),
    }
    assert (found["LABEVENTS", 0, "Glucose_Blood"]["Variable_ID"], found["LABEVENTS", 0, "flag"]["Variable_ID"]) == ("7", "")
    assert (found["RADIOLOGY", 0, "text"]["Patient_id"], found["RADIOLOGY", 0, "text"]["Admission_id"]) == ("1", None)


def test_metrics_read_the_kinds(tables):
    long = longform.build_long(tables)
    kinds = {(r["kind"], r["item"]): r["patients"] for r in metrics.fidelity_by_kind(long).collect()}
    assert kinds == {("event", None): 1, ("prescription", "Aspirin"): 1, ("prescription", "5"): 1, ("prescription", "PO"): 1}
    assert {r["Variable_name"] for r in metrics.class_diversity(long).collect()} == {"gender", "drug_type", "route", "flag", "Cough", "note_type"}


def test_tables_without_rows_and_without_rules(tables):
    assert longform.build_long({"patients": tables["patients"].limit(0)}).count() == 0
    with pytest.raises(ValueError, match="rules"):
        longform.build_long({"unknown": tables["unknown"]})


def test_rows_are_numbered_and_laid_out_only_as_asked(spark):
    stays = spark.createDataFrame([(1, 2, "2150-01-01", "2150-01-02")], "subject_id long, hadm_id long, intime string, outtime string")
    plain = longform.build_long({"icustays": stays}, keyed=False)
    assert "Window" not in plain._jdf.queryExecution().optimizedPlan().toString()
    keyed = longform.build_long({"icustays": stays})
    assert plain.drop("Primary_key").exceptAll(keyed.drop("Primary_key")).isEmpty() and plain.count() == keyed.count() == 2
    assert [r["Variable_name"] for r in longform.build_long({"icustays": stays}, variables={"intime"}).collect()] == ["intime"]


def test_dates_try_only_patterns_that_fit(spark):
    texts = ["2150-01-02", "2150-1-2 3:4:5", "2150-1-2 3:4", "2150/1/2", "2/1/2150", "2150.1.2", "21500102", " 2150-01-02 ", "2150-13-01", "x", "", None, "1:2", "12.5", "2150-01-02T03:04:05"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(p)) for p in compat.DATE_PATTERNS])
    assert df.where(~compat.any_date(F.col("x")).eqNullSafe(plain)).isEmpty()
    assert len(set(compat.DATE_PATTERNS.values())) > 1  # a text of one form is not tried by all patterns
