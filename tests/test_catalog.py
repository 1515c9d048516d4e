import pytest
from pyspark.sql import functions as F

from tessera.functions import compat
from tessera.operators import compare
from tessera.sources import catalog


def test_guard_accepts_queries_only(spark):
    catalog.check_sql(spark, "select 1 as x")
    catalog.check_sql(spark, "with a as (select 1 as x) select * from a where x = 1")
    for bad in ("drop table x", "create table t as select 1", "insert into t values (1)", "select 1; select 2", "set a=b", "nonsense"):
        with pytest.raises(catalog.QueryError):
            catalog.check_sql(spark, bad)


def test_names_limits_and_registry():
    assert catalog.check_name("hosp.admissions")
    for bad in ("a b", "a.b.c", "x;y", ""):
        with pytest.raises(catalog.QueryError):
            catalog.check_name(bad)
    registry = catalog.Registry()
    registry.add(catalog.Dataset.from_json('{"name": "Demo", "modalities": ["tabular"]}'))
    assert registry.get("demo").name == "Demo"
    with pytest.raises(catalog.QueryError):
        registry.get("demo", frozenset({"NOTES"}))


def test_ingest_turns_coded_missing_values_to_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,NA\n2,___\n3,x\n4,\n")
    out = catalog.ingest_csv(spark, f"file://{tmp_path}/a.csv", f"file://{tmp_path}/a.parquet")
    assert [r["v"] for r in out.orderBy("id").collect()] == [None, None, "x", None]


def test_match_rate_counts_extra_and_repeated_keys(spark):
    truth = spark.createDataFrame([(1, 4), (2, 5)], "stay_id int, score int")
    extra = spark.createDataFrame([(1, 4), (2, 5), (3, 99)], "stay_id int, score int")
    twice = spark.createDataFrame([(1, 4), (1, 4), (2, 5)], "stay_id int, score int")
    for candidate in (extra, twice):
        assert compare.match_rates(candidate, truth, ["stay_id"], ["score"]).first()["match_rate"] == pytest.approx(2 / 3)


def test_rounding_and_sequences(spark):
    row = spark.range(1).select(compat.round_scaled(F.lit(1.0005), 3).alias("r"), compat.round_scaled(F.lit(4.0005), 3).alias("q"), F.size(compat.integer_sequence(F.lit(-24).cast("long"), F.lit(-30).cast("long"))).alias("n")).first()
    assert (row["r"], row["q"], row["n"]) == (1.001, 4.0, 0)  # 4.0005 * 1000 is a little less than 4000.5 as a double
