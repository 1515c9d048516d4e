"""Scores by group against the metric run over each group's rows alone."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.quality import bias, metrics
from tessera.quality.metrics import LONG_COLUMNS


@pytest.fixture(scope="module")
def long(spark):
    rng, rows = random.Random(9), []
    for i in range(900):
        patient = f"p{i % 60}" if i % 50 else None
        for name, value, kind in (("unit", rng.choice(["A", "B", "C", "", "A"]), "1"), ("level", str(round(rng.gauss(50, 20) + (i % 3) * 30, rng.choice([0, 1]))), "0"), ("code", f"c{rng.randrange(4)}", "1")):
            rows.append((i, f"T{i % 2}", name, rng.choice(["2150-01-02 03:04:05", "2150-13-01", "2150-02-03 00:00:00"]), value, kind, patient))
    for p in range(60):
        rows += [(p, "P", "sex", None, "F" if p % 3 else "M", "1", f"p{p}"), (p, "P", "age", None, "" if p == 7 else str(p), "0", f"p{p}")]
    named = ["Primary_key", "Original_table_name", "Variable_name", "Event_date", "Value", "Is_categorical", "Patient_id"]
    df = spark.createDataFrame(rows, "Primary_key long, " + ", ".join(f"{c} string" for c in named[1:]))
    return df.select(*[F.col(c) if c in named else F.lit(None).cast("string").alias(c) for c in LONG_COLUMNS]).cache()


def test_every_metric_over_every_group(spark, long, monkeypatch):
    for function in ("range_validity", "preciseness"):
        monkeypatch.setitem(bias.SCORES, function, (lambda t, f=getattr(metrics, function): f(t, 20), bias.SCORES[function][1]))
    people = bias.demographics(long, {"sex": "sex", "age": "years"})
    people = people.select("Patient_id", "sex", bias.age_group(F.col("years").cast("int")).alias("age"))
    assert {r["Patient_id"] for r in people.where("age is null").collect()} == {"p7"} and people.count() == 60
    found = {(r["metric"], r["grouping"], r["group_name"]): r["score"] for r in bias.scores_by_group(long, people, ["sex", "age"]).collect()}
    groups = [("sex", "F"), ("sex", "M"), *[("age", f"{a}0-{a}9".replace("00-09", "0-9")) for a in range(6)]]
    assert set(found) == {(m, *g) for m in bias.SCORES for g in groups}
    known = people.dropna()
    for metric, (table, score) in bias.SCORES.items():
        for grouping, group in groups if metric in ("completeness", "range_validity") else groups[:3]:
            alone = long.join(known.where(F.col(grouping) == group).select("Patient_id"), "Patient_id", "left_semi")
            assert found[metric, grouping, group] == pytest.approx(score(table(alone)).first()["score"]), (metric, group)


def test_disparity_is_the_largest_distance_from_the_mean(spark):
    rows = [("m", "sex", "F", 90.0), ("m", "sex", "M", 70.0), ("m", "sex", "X", None), ("n", "age", "a", 10.0), ("n", "age", "b", 20.0), ("n", "age", "c", 60.0)]
    found = bias.group_disparities(spark.createDataFrame(rows, "metric string, grouping string, group_name string, score double"))
    assert sorted(map(tuple, found.collect())) == [("m", "sex", 2, 80.0, 10.0), ("n", "age", 3, 30.0, 30.0)]


def test_weighted_totals(spark):
    classes = spark.createDataFrame([(50.0, 1), (80.0, 3)], "diversity double, n long")
    assert bias.class_diversity_total(classes).first()["score"] == 72.5
    instances = spark.createDataFrame([(2, 2, 0.5), (1, 4, 0.25)], "patients long, occurrences long, gini double")
    assert tuple(bias.instance_diversity_total(instances).first()) == (50.0, 50.0)
    judged = spark.createDataFrame([("a", 0.5, 10, 0.9, 0.8, 0.7, 0.6), ("b", None, 30, 0.5, 0.4, 0.3, 0.2)], "k string, auc double, n long, accuracy double, macro_precision double, macro_recall double, macro_f1 double")
    assert tuple(bias.classification_total(judged).first()) == (40, 0.5, 0.6, 0.5, 0.4, 0.3)
    assert [bias_name for bias_name in map(lambda a: spark.range(1).select(bias.age_group(F.lit(a)).alias("g")).first()["g"], (-1, 0, 9, 10, 79, 80, 119, 120))] == [None, "0-9", "0-9", "10-19", "70-79", "80+", "80+", None]
