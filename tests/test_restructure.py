"""Rewritten queries over renamed tables, and merged tables given back, by the rows that come out."""

from datetime import datetime

import pytest

from tessera.operators import compare, restructure

T = datetime(2150, 1, 1)
TABLES = {
    "patients": ("subject_id long, gender string", [(1, "F"), (2, "M"), (3, "F")]),
    "admissions": ("subject_id long, hadm_id long, admittime timestamp_ntz", [(1, 10, T), (1, 11, None), (2, 20, T)]),
    "icustays": ("subject_id long, hadm_id long, stay_id long, los double", [(1, 10, 100, 1.5), (1, 10, 101, None)]),
    "chartevents": ("subject_id long, stay_id long, itemid long, charttime timestamp_ntz, value string", [(1, 100, 5, T, "subject_id"), (1, 100, 5, T, "subject_id"), (1, 101, 6, None, None)]),
    "labevents": ("subject_id long, itemid long, charttime timestamp_ntz, value string, flag string", [(2, 7, T, "x", "abnormal")]),
    "inputevents": ("stay_id long, amount double", [(100, 1.0)]),
    "outputevents": ("stay_id long, value double", [(100, 2.0), (None, None)]),
    "d_items": ("itemid long, label string, unit string", [(5, "rate", "bpm")]),
    "d_labitems": ("itemid long, label string", [(7, "gas")]),
}
COLUMNS = {"subject_id": "zk1", "hadm_id": "zk2", "stay_id": "zk3", "charttime": "zt", "value": "zv", "gender": "zg", "admittime": "za", "itemid": "zi"}
GOLDEN = [
    "SELECT subject_id, count(*) AS n FROM chartevents WHERE value = 'subject_id' GROUP BY subject_id",
    """WITH first AS (SELECT c.stay_id, min(c.charttime) AS charttime -- value of subject_id
       FROM icu.chartevents c GROUP BY c.stay_id), value AS (SELECT 1 AS one)
       SELECT p.gender, i.stay_id, first.charttime, CAST(i.hadm_id AS STRING) AS text FROM hosp.patients p JOIN icu.icustays i USING (subject_id) LEFT JOIN first ON first.stay_id = i.stay_id, value""",
    "SELECT icustays.`stay_id`, (SELECT max(value) FROM chartevents WHERE chartevents.stay_id = icustays.stay_id) AS value FROM icustays",
    "SELECT icustays.`stay_id` FROM icustays WHERE EXISTS (SELECT 1 FROM admissions a WHERE a.hadm_id = icustays.hadm_id)",
    "SELECT VALUE, Stay_Id AS stay FROM (SELECT value, stay_id FROM chartevents UNION ALL SELECT value, NULL FROM labevents) u ORDER BY value NULLS FIRST",
    "SELECT hosp.admissions.hadm_id, year(admittime) AS y, date_trunc('DAY', admittime) AS d, DATE '2150-01-01' AS date FROM hosp.admissions",
]


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.createDataFrame(rows, schema) for n, (schema, rows) in TABLES.items()}


def schema_of(name):
    return "icu" if name in ("chartevents", "icustays") else "hosp"


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_texts_over_renamed_tables(spark, tables, text):
    names = {n: f"rn_{i}" for i, n in enumerate(tables)}
    for name, table in compare.renamed(tables, names, COLUMNS).items():
        table.createOrReplaceTempView(name)
    for name, table in tables.items():
        table.createOrReplaceTempView(f"native_{name}")
    bare = {**names, **{f"{schema_of(n)}.{n}": v for n, v in names.items()}}
    both = {}
    for key, target in (("native", {k: f"native_{k.split('.')[-1]}" for k in bare}), ("renamed", bare)):
        found = {k: v for k, v in target.items() if k in text.lower() and (("." in k) == (f"{schema_of(k.split('.')[-1])}.{k.split('.')[-1]}" in text.lower()))}
        sql = restructure.rewrite_sql(spark, text, found, COLUMNS if key == "renamed" else {})
        both[key] = spark.sql(sql)
    back = restructure.names_back(both["renamed"], COLUMNS)
    assert [c.lower() for c in back.columns] == [c.lower() for c in both["native"].columns]
    rows, others = (sorted(map(tuple, df.collect()), key=repr) for df in (both["native"], back))
    assert rows and rows == others


def test_strings_comments_functions_and_types_stay(spark):
    sql = "SELECT date(`value`) AS date, CAST(a AS date) AS c, 'value' AS d, DATE '2020-01-01' /* value */ FROM t1 x WHERE x.value > 1 -- value"
    got = restructure.rewrite_sql(spark, sql, {"t1": "s.t 2"}, {"value": "v`1", "date": "dd"})
    assert got == "SELECT date(`v``1`) AS `dd`, CAST(a AS date) AS c, 'value' AS d, DATE '2020-01-01' /* value */ FROM `s`.`t 2` x WHERE x.`v``1` > 1 -- value"
    assert restructure.rewrite_sql(spark, "WITH t1 AS (SELECT 1 AS a) SELECT * FROM t1", {"t1": "other"}, {}) == "WITH t1 AS (SELECT 1 AS a) SELECT * FROM t1"
    assert restructure.rewrite_sql(spark, "SELECT t1.a FROM t1", {"t1": "o"}, {"a": "b"}) == "SELECT t1.`b` FROM `o` AS `t1`"
    with pytest.raises(ValueError, match="fall together"):
        restructure.rewrite_sql(spark, "SELECT 1", {}, {"a": "x", "b": "x"})


def test_merged_tables_give_the_single_ones_back(spark, tables):
    merged, back = restructure.restructured(tables)
    assert sorted(merged) == ["encounters", "flows", "item_reference", "observations"] and sorted(back) == sorted(tables)
    assert merged["observations"].columns == ["source", "subject_id", "itemid", "charttime", "value", "stay_id", "flag"]
    assert sorted(map(tuple, merged["encounters"].select("subject_id", "hadm_id", "stay_id").collect()), key=repr) == [(1, 10, 100), (1, 10, 101), (1, 11, None), (2, 20, None)]
    for name, table in tables.items():
        given = table.where("subject_id <> 3") if name == "patients" else table  # a patient without an admission has no row
        assert back[name].columns == table.columns and compare.equivalent([given, back[name]]) == [True], name
    with pytest.raises(ValueError, match="told apart"):
        restructure.stacked(tables["chartevents"], tables["outputevents"], "source", ["a", "b"])
    with pytest.raises(ValueError, match="two tables"):
        restructure.denormalised(tables["patients"], tables["admissions"].selectExpr("*", "'x' AS gender"), tables["icustays"])
    assert set(restructure.restructured({"d_items": tables["d_items"]})[0]) == {"d_items"}
