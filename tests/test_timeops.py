"""Joins in time against plain loops over all pairs."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.concepts import infection, infusions
from tessera.operators import relational, timeops

T, MINUTE = datetime(2150, 3, 1), timedelta(minutes=1)
KNOWN = {"both": lambda t, a, b: a <= t <= b, "left": lambda t, a, b: a <= t < b, "right": lambda t, a, b: a < t <= b}


def at(rng, far=5000):
    return None if rng.random() < 0.05 else T + MINUTE * rng.randrange(0, far, 5)


def same(found, want):
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(5)
    keys = [1] * 6 + [2, 3, None]  # key 1 has most of the rows
    points = [(i, rng.choice(keys), at(rng)) for i in range(300)] + [(900, 1, datetime(1969, 12, 31, 23, 59))]
    spans = []
    for i in range(120):
        low, length = at(rng), rng.choice([0, 5, 30, 60, 240, 20000])
        high = None if low is None or rng.random() < 0.05 else low + MINUTE * length
        spans.append((i, rng.choice(keys), low, high if i % 17 else low and low - MINUTE))
    return points, [*spans, (900, 1, datetime(1960, 1, 1), datetime(1970, 1, 2))]


POINTS, SPANS = "p long, k long, t timestamp_ntz", "s long, k long, low timestamp_ntz, high timestamp_ntz"


@pytest.mark.parametrize(("closed", "how", "width"), list(product(KNOWN, ["left", "inner"], [None, 7_000_000])))
def test_binned_interval_join(spark, sides, closed, how, width):
    points, spans = sides
    if width:
        spans = [s for s in spans if s[2] and s[3] and s[3] - s[2] < MINUTE * 100]  # narrow bins, short intervals
    want = []
    for p, k, t in points:
        found = [(s, a, b) for s, j, a, b in spans if k is not None and j == k and None not in (t, a, b) and KNOWN[closed](t, a, b)]
        want += [(p, k, t, *f) for f in found or ([(None, None, None)] if how == "left" else [])]
    same(timeops.binned_interval_join(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), "k", "t", "low", "high", closed, how, width), want)


def test_binned_join_of_numbers_and_of_no_intervals(spark):
    points = spark.createDataFrame([(i, 1, float(i) - 0.5) for i in range(40)], "p long, k long, t double")
    spans = spark.createDataFrame([(1, 1, -3.0, 2.5), (2, 1, 30.0, 30.5)], "s long, k long, low double, high double")
    found = timeops.binned_interval_join(points, spans, "k", "t", "low", "high", "both", "inner")
    assert sorted((r["p"], r["s"]) for r in found.collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (31, 2)]
    assert timeops.binned_interval_join(points, spans.limit(0), "k", "t", "low", "high", "both").count() == 40


def test_a_hot_key_spreads_over_bins(spark):
    points = spark.range(20_000).select(F.col("id").alias("p"), F.lit(1).alias("k"), F.col("id").alias("t"))
    spans = spark.range(4_000).select(F.col("id").alias("s"), F.lit(1).alias("k"), (F.col("id") * 5).alias("low"), (F.col("id") * 5 + 3).alias("high"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = timeops.binned_interval_join(points, spans, "k", "t", "low", "high", "both", "inner")
        assert "_bin_l" in found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning", 1)[1][:80]
        assert found.count() == 16_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlap_join(spark, sides):
    _, spans = sides
    first, second = spans[::2], spans[1::2]
    want = [(s, k, a, b, r, c, d) for s, k, a, b in first for r, j, c, d in second if k is not None and j == k and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b]
    right = spark.createDataFrame(second, "r long, k long, c timestamp_ntz, d timestamp_ntz")
    same(timeops.overlap_join(spark.createDataFrame(first, SPANS), right, "k", ("low", "high"), ("c", "d")), want)


def test_event_pairs_anchored_windows_and_histories(spark, sides):
    points, _ = sides
    left, right = points[:150], points[150:]
    pairs = [(p, k, t, q, u) for p, k, t in left for q, j, u in right if k is not None and j == k and t and u and t - 72 * MINUTE <= u <= t + 24 * MINUTE]
    other = spark.createDataFrame(right, "q long, k long, u timestamp_ntz")
    same(timeops.event_pairs(spark.createDataFrame(left, POINTS), other, "k", "t", "u", "72 MINUTE", "24 MINUTE"), pairs)
    near = [(p, k, t, sum(1 for q, j, u in right if k is not None and j == k and t and u and t - 60 * MINUTE < u <= t + 60 * MINUTE)) for p, k, t in left]
    found = timeops.anchored_window(other, spark.createDataFrame(left, POINTS), "k", "u", "t", "1 HOUR", "1 HOUR", [F.count("q").alias("n")], closed="right")
    same(found, near)
    dated = [(p, k, t and T + (t - T) * 700) for p, k, t in points[:300]]
    history = [(p, q) for p, k, t in dated for q, j, u in dated if k is not None and j == k and t and u and q % 3 and t.replace(year=t.year - 2) <= u < t] + [(p, p) for p, _, _ in dated]
    same(relational.qualifying_history(spark.createDataFrame(dated, POINTS), "k", "p", "t", F.col("p") % 3 != 0), history)


def test_vasoactive_sweep_against_all_pairs(spark):
    rng, rows = random.Random(3), []
    for i in range(220):
        low = at(rng, 800)
        high = None if rng.random() < 0.05 or low is None else low + MINUTE * rng.choice([-5, 0, 10, 45, 200])
        rows.append((rng.choice([1, 1, 1, 2, 3]), i, rng.choice([*infusions.AGENTS.values(), 1]), rng.choice([None, 0.5, 2.0]), rng.choice(["mcg/min", "units/min", "mg/kg/min", None]), 1.0, rng.choice([1.0, 50.0, None]), low, high))
    given = spark.createDataFrame(rows, "stay_id long, linkorderid long, itemid int, rate double, rateuom string, amount double, patientweight double, starttime timestamp_ntz, endtime timestamp_ntz")
    rates = {}
    for name in infusions.AGENTS:
        for r in infusions.infusion(given, name).collect():
            rates.setdefault((r["stay_id"], name), []).append((r["starttime"], r["endtime"], r["vaso_rate"]))
    want = []
    for stay in {r[0] for r in rows}:
        cuts = sorted({t for r in rows if r[0] == stay and r[2] != 1 for t in r[-2:] if t})
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            every = [[x for a, b, x in rates.get((stay, n), []) if a and b and a <= low and high <= b] or [None] for n in infusions.AGENTS]
            want += [(stay, low, high, *chosen) for chosen in product(*every)]
    found = infusions.vasoactive_agent(given)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Scan ") == 1
    same(found, want)


def test_antibiotics_count_by_drug_and_route(spark):
    given = [
        (1, 7, T, "MAIN", "Vancomycin", "IV"), (1, 7, T + MINUTE, "BASE", "Vancomycin", "IV"), (1, 7, T, "BASE", "Cefazolin", "IV"), (1, 7, T, None, "Vancomycin", "IV"), (1, 7, T, "MAIN", "Vancomycin", "TP"),
        (1, 8, T, "MAIN", "Vancomycin", None), (1, 8, T, "MAIN", "Erythromycin ophth oint", "IV"), (1, 8, T, "MAIN", "Aspirin", "PO"), (1, 8, T - 9 * MINUTE, "MAIN", "CIPROFLOXACIN", "PO"),
    ]
    rows = spark.createDataFrame([(*r[:3], r[2], *r[3:]) for r in given], "subject_id long, hadm_id long, starttime timestamp_ntz, stoptime timestamp_ntz, drug_type string, drug string, route string")
    stays = spark.createDataFrame([(7, 70, T, T + MINUTE), (8, 80, T, T + MINUTE)], "hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    found = sorted(tuple(r) for r in infection.antibiotic(rows, stays).select("hadm_id", "antibiotic", F.coalesce("stay_id", F.lit(0))).collect())
    assert found == [(7, "Vancomycin", 0), (7, "Vancomycin", 70), (7, "Vancomycin", 70), (8, "CIPROFLOXACIN", 0)]
