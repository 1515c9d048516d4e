"""Models of data quality: areas against all pairs, lines against the optimum's conditions, planted changes and planted outliers."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tessera.quality import accuracy, consistency
from tessera.quality.metrics import LONG_COLUMNS


def test_area_by_ranks_against_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.25, 0.5, rng.random()])) for _ in range(300)]
    ones, zeros = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))
    assert consistency.area_by_ranks(spark.createDataFrame(rows, "y int, s double"), "y", "s") == pytest.approx(want)
    assert consistency.area_by_ranks(spark.createDataFrame(rows[:0], "y int, s double"), "y", "s") is None


def long_rows(spark):
    """Laboratory events of 2001 to 2007; from 2004 on another set of names is in use, 2005 has few records, and some dates are spoilt."""
    rng, rows = random.Random(2), []
    for year in range(2001, 2008):
        for i in range(12 if year == 2005 else 120):
            date = datetime(year, 1, 1) + timedelta(days=rng.randrange(360))
            names = ["na", "k", "cl", "hb"] if year < 2004 else ["sodium", "k", "cl", "hb"]
            for name in rng.sample(names, 3):
                rows.append((f"p{i}", "bad" if rng.random() < 0.02 else f"{date}", name, "1", "event", "lab_event"))
            rows.append((f"p{i}", f"{date}", "icd", rng.choice("ABC"), "Diagnosis", None))
    frame = pd.DataFrame(rows, columns=["Patient_id", "Event_date", "Variable_name", "Value", "Mapping_info_1", "Mapping_info_2"]).reindex(columns=LONG_COLUMNS)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} string" for c in LONG_COLUMNS))


def test_changes_over_the_years(spark):
    found = consistency.time_series_consistency(long_rows(spark), ["event", "diagnosis"], trees=5)
    areas = {(r["category"], r["year"]): r for r in found.collect()}
    assert sorted(y for c, y in areas if c == "event") == [2002, 2003, 2004, 2005]
    assert areas["event", 2004]["is_change_point"] == 1 and areas["event", 2004]["auroc"] > 0.8 and {"na", "sodium"} & set(areas["event", 2004]["leading"][:2])
    assert areas["event", 2005]["auroc"] == -0.1 and areas["event", 2005]["is_change_point"] == 0  # one year is too small
    assert all(r["is_change_point"] == 0 for (c, y), r in areas.items() if (c, y) != ("event", 2004))
    again = consistency.time_series_consistency(long_rows(spark).repartition(3), ["event"], trees=5)
    assert [(r["year"], r["auroc"]) for r in again.collect()] == [(y, pytest.approx(areas["event", y]["auroc"])) for y in (2002, 2003, 2004, 2005)]
    total = {r["category"]: (r["points"], r["changes"], r["consistency"]) for r in consistency.consistency_summary(found).collect()}
    assert total == {"event": (4, 1, 75.0), "diagnosis": (4, 0, 100.0)}


def test_years_without_records_and_short_histories(spark):
    rows = [(f"p{i}", datetime(y, 1, 1), ["a"], y) for i, y in enumerate([2000, 2000, 2001, 2004, 2004, 2006])]
    found = consistency.year_pairs(spark.createDataFrame(rows, "patient string, date timestamp_ntz, items array<string>, year int"))
    assert sorted(map(tuple, found.collect())) == [(2001, 2, 1, False), (2002, 1, 0, False), (2003, 0, 0, False), (2004, 0, 2, False)]
    few = spark.createDataFrame(rows[:2], "patient string, date timestamp_ntz, items array<string>, year int")
    assert consistency.yearly_areas(few).count() == 0


def pinball(y, line, x, q):
    r = y - line[0] - x @ line[1:]
    return np.where(r >= 0, q * r, (q - 1) * r).sum()


def test_quantile_lines_are_optimal(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 2)) * [1, 50]
    y = 3 + 2 * x[:, 0] - 0.1 * x[:, 1] + rng.standard_normal(600) * (1 + np.abs(x[:, 0]))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).repartition(3)
    for q, line in zip((0.1, 0.5, 0.99), accuracy.quantile_lines(df, ["a", "b"], "y", (0.1, 0.5, 0.99)), strict=True):
        r = y - line[0] - x @ line[1:]
        assert np.mean(r < -1e-3) - 0.006 <= q <= np.mean(r < 1e-3) + 0.006
        best = pinball(y, line, x, q)
        for _ in range(200):
            assert best <= pinball(y, line + rng.standard_normal(3) * [0.05, 0.05, 0.001], x, q) + 1e-3 * abs(best)


def test_isolation_scores_tell_rows_apart():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.standard_normal((500, 3)), [[8, 8, 8], [-9, 0, 9]]])
    scores = accuracy.Forest(x).scores(x)
    assert set(np.argsort(-scores)[:2]) == {500, 501} and scores[500] > 0.6 and 0.35 < np.median(scores) < 0.5
    same = np.ones((50, 2))
    assert np.allclose(accuracy.Forest(same).scores(same), accuracy.Forest(same).scores(same)[0])


def test_planted_outliers_are_found_and_others_left_alone(spark):
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(3000), rng.standard_normal(3000)
    y = 10 + 3 * a - 2 * b + 0.3 * rng.standard_normal(3000)
    y[[7, 70, 700]] += 25
    y[[9, 90]] -= 25
    frame = pd.DataFrame({"id": np.arange(3000), "a": a, "b": b, "y": y})
    frame.loc[5, "a"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "id long, a double, b double, y double")
    judged = accuracy.numeric_accuracy(df, "y", ["a", "b"])
    found = {r["id"]: r["direction"] for r in judged.where("direction is not null").collect()}
    assert {i: found.pop(i) for i in (7, 70, 700, 9, 90)} == {7: "Upper", 70: "Upper", 700: "Upper", 9: "Under", 90: "Under"} and len(found) <= 30
    assert judged.count() == 2999
    (total,) = accuracy.accuracy_summary(judged, "direction is not null").collect()
    assert (total["total"], total["outliers"]) == (2999, 5 + len(found)) and total["accuracy"] == round((2994 - len(found)) / 2999 * 100, 2)
    mixed = pd.DataFrame({"id": np.arange(1000), "a": a[1000:2000], "b": b[1000:2000], "y": y[1000:2000]})
    mixed.loc[[3, 33], ["a", "b", "y"]] = [6.0, -6.0, -40.0]
    marks = accuracy.categorical_accuracy(spark.createDataFrame(mixed), ["a", "b", "y"])
    assert {r["id"] for r in marks.where("outlier").collect()} >= {3, 33} and marks.where("outlier").count() <= 20


def test_models_take_tables_without_rows_and_without_spread(spark):
    none = spark.createDataFrame([], "a double, y double")
    assert accuracy.numeric_accuracy(none, "y", ["a"]).count() == 0
    assert accuracy.accuracy_summary(accuracy.categorical_accuracy(none, ["a"]), "outlier").first()["accuracy"] is None
    flat = spark.createDataFrame([(1.0, 2.0)] * 20, "a double, y double")
    assert accuracy.numeric_accuracy(flat, "y", ["a"]).where("direction is not null").count() == 0


def test_later_rounds_read_only_rows_near_the_lines(spark, monkeypatch):
    """every round read all rows; far rows are added up once, and the line is that of all rows."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 2))
    y = 1 + x @ [2, -1] + rng.standard_normal(4000)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})).repartition(2)
    read, summed = [], accuracy.summed
    monkeypatch.setattr(accuracy, "summed", lambda rows, names, sums: read.append(rows.count()) or summed(rows, names, sums))
    lines = accuracy.quantile_lines(df, ["a", "b"], "y")
    assert read.count(4000) < 25 and 0 < min(read) < 800
    monkeypatch.setattr(accuracy, "NEAR", 0.0)  # no row is ever far
    for q, line, whole in zip(accuracy.QUANTILES, lines, accuracy.quantile_lines(df, ["a", "b"], "y"), strict=True):
        assert line == pytest.approx(whole, abs=2e-2) and pinball(y, line, x, q) <= pinball(y, whole, x, q) * (1 + 1e-5)
