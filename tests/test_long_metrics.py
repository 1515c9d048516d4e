"""Codes, mapped dates and sequences over the long format, and searches with signs, row by row."""

import pytest
from pyspark.sql import functions as F

from tessera.quality import metrics
from tessera.quality.metrics import LONG_COLUMNS
from tessera.sources import catalog


def long_of(spark, rows):
    names = ["Primary_key", "Original_table_name", "Variable_name", "Value", "Patient_id", "Mapping_info_1", "Event_date"]
    df = spark.createDataFrame([(*r, None)[:7] for r in rows], "Primary_key long, " + ", ".join(f"{c} string" for c in names[1:]))
    return df.select(*[F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in LONG_COLUMNS])


def test_codes_by_name_and_description(spark):
    rows = [(i, "D", n, v, "p", "medical_code") for i, (n, v) in enumerate([("icd9", "401.1"), ("icd9", "x"), ("code", "I10"), ("code", "I10"), ("code", "i10"), ("other", "7"), ("own", "Z-1"), ("lost", "1")])]
    rows.append((9, "D", "icd9", "zzz", "p", "event"))
    words = spark.createDataFrame([("D", "icd9", None), ("D", "code", "ICD revision 10"), ("D", "other", "a word"), ("D", "own", "ours")], "Original_table_name string, Variable_name string, Description string")
    further = spark.createDataFrame([("own", "^Z-[0-9]$")], "Variable_name string, pattern string")
    found = {r["Variable_name"]: (r["n"], r["pattern"], r["n_invalid"], r["validity"]) for r in metrics.code_validity(long_of(spark, rows), words, further).collect()}
    assert found == {
        "icd9": (2, r"^[0-9]{3}(\.[0-9]{1,2})?$", 1, 50.0), "code": (3, r"^[A-Z]{1}[0-9]{2}(\.[0-9]{1,2})?$", 1, 66.67), "other": (1, "", 1, 0.0), "own": (1, "^Z-[0-9]$", 0, 100.0), "lost": (1, "", 1, 0.0),
    }


def test_dates_of_records_and_of_values(spark):
    rows = [(1, "A", "admittime", "2150-01-01", "p", "date", "2150-02-30"), (2, "A", "admittime", "soon", "p", "Date", None), (3, "A", "name", "x", "p", None, "2150-01-01 10:00:00")]
    found = {r["Variable_name"]: (r["n"], r["validity"]) for r in metrics.date_validity(metrics.mapped_dates(long_of(spark, rows))).collect()}
    assert found == {"Event_date": (2, 50.0), "admittime": (2, 50.0)}


def test_sequences_meet_on_three_keys(spark):
    day = lambda d: f"2150-01-{d:02}"
    rows = [
        (1, "A", "in", day(1), "p", "date"), (1, "A", "out", day(2), "p", "date"), (2, "A", "in", day(5), "p", "date"), (2, "A", "out", day(4), "p", "date"), (3, "A", "in", day(1), "p", "date"),
        (4, "A", "in", "bad", "p", "date"), (4, "A", "out", day(2), "p", "date"), (1, "A", "in", day(3), "q", "date"), (1, "A", "out", day(3), "q", "date"), (1, "B", "in", day(9), "p", "date"), (5, "A", "in", day(1), "p", "event"),
        (5, "A", "out", day(2), "p", "date"), (6, "A", "in", day(2), "p", "date"), (6, "A", "out", day(1), "p", "date"), (6, "A", "out", day(3), "p", "date"), (7, "A", "in", day(1), None, "date"), (7, "A", "out", day(1), None, "date"),
    ]
    found = metrics.sequence_validity_long(long_of(spark, rows), [("A", "in", "out"), ("B", "in", "out")])
    assert [tuple(r) for r in found.collect()] == [("A", "in", "out", 5, 2, 60.0)]


def test_searches_take_signs(spark):
    notes = spark.createDataFrame([(1, "Fever of 38.5 and chills"), (2, "FEVER"), (3, "fe_er 50% a\\b"), (4, None)], "id int, text string")
    ids = lambda q: [r["id"] for r in catalog.search_notes(notes, "id", "text", q).collect()]
    assert ids("fever") == [1, 2] and ids("f_ver") == [1, 2] and ids("fe_er") == [1, 2, 3] and ids("of%chills") == [1] and ids("a\\b") == [3] and ids("50%") == [3]
    assert catalog.search_notes(notes, "id", "text", "f_ver", snippet=4).first()["snippet"] == "Feve"


def test_the_guard_knows_functions_and_excepts(spark):
    catalog.check_sql(spark, "select * except (a), upper(b), count(*) over (partition by c) from t")
    catalog.check_sql(spark, "select transform(a, x -> x + 1), cast(b as int), date_trunc('day', c), coalesce(d, 0), percentile_approx(e, 0.5) filter (where f > 1) from t")
    for bad in ("select my_function(a) from t", "select other.upper(a) from t where evil(b)", "select reflect('a', 'b')"):
        with pytest.raises(catalog.QueryError):
            catalog.check_sql(spark, bad)


def test_variables_are_described(spark):
    long = long_of(spark, [(1, "LABEVENTS", "Glucose", "1", "p", None), (2, "A", "x", "1", "p", None), (3, "A", "y", "1", "p", None), (4, "B", "x", "1", "p", None), (5, "A", "z", "1", "p", None), (6, "A", "x", "2", "q", None)])
    words = spark.createDataFrame([("a", "X", "x of a"), (None, "x", "any x"), (None, "y", "NO_DESC here"), ("A", "z", " "), ("A", "unused", "u")], "Original_table_name string, Variable_name string, Description string")
    found = {(r[0], r[1]): r[2] for r in metrics.describe_variables(long, words).collect()}
    assert found == {("LABEVENTS", "Glucose"): "Clinical measurement: Glucose", ("A", "x"): "x of a", ("B", "x"): "any x", ("A", "y"): "Column y of the table A", ("A", "z"): "Column z of the table A"}
    assert {r[2] for r in metrics.describe_variables(long).where("Variable_name = 'x'").collect()} == {"Column x of the table A", "Column x of the table B"}
    assert metrics.describe_variables(long, words.drop("Original_table_name")).count() == 5
