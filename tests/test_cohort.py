"""Admission cohorts against plain tests of each admission, and refusals."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.operators import cohort


def test_criteria_against_plain_tests(spark):
    rng = random.Random(4)
    people = [(i, rng.choice("FM"), rng.randrange(20, 90)) for i in range(30)]
    admissions = [(rng.randrange(32), 100 + i, rng.choice([0, 1, None])) for i in range(80)]
    codes = [(rng.choice(admissions)[1], rng.choice(["E11.9", "E10", "I50", "i50", "428", None])) for _ in range(160)]
    stays = [(rng.choice(admissions)[1], 1000 + i) for i in range(40)]
    tables = [
        spark.createDataFrame(people, "subject_id int, gender string, anchor_age int"), spark.createDataFrame(admissions, "subject_id int, hadm_id int, hospital_expire_flag int"),
        spark.createDataFrame(codes, "hadm_id int, icd_code string"), spark.createDataFrame(stays, "hadm_id int, stay_id int"),
    ]
    known = {p: (g, a) for p, g, a in people}
    for wanted, every, stay, died in product([(), ("E1", "I5"), ("E11.9", "428")], [False, True], [None, True, False], [None, True]):
        rules = cohort.AdmissionCriteria(age_min=30, age_max=80, gender="F" if stay else None, codes=wanted, match_all=every, has_stay=stay, died=died)
        want = set()
        for p, h, flag in admissions:
            mine = [c for x, c in codes if x == h and c]
            has = [any(c.startswith(w) for c in mine) for w in wanted]
            ok = p in known and 30 <= known[p][1] <= 80 and (rules.gender is None or known[p][0] == rules.gender) and (not wanted or (all if every else any)(has))
            if ok and (stay is None or (h in {x for x, _ in stays}) == stay) and (died is None or flag == 1):
                want.add(h)
        chosen = cohort.select_admissions(*tables, rules)
        assert sorted(r["hadm_id"] for r in chosen.collect()) == sorted(want)
    counts = cohort.admission_counts(chosen, tables[3]).first()
    assert counts["admission_count"] == len(want) and counts["icu_stay_count"] == sum(h in want for h, _ in stays)


@pytest.mark.parametrize("bad", [{"age_min": 50, "age_max": 40}, {"age_min": -1}, {"age_max": True}, {"gender": "x"}, {"codes": ("a'b",)}, {"codes": ("",)}, {"died": 1}, {"match_all": "yes"}])
def test_bad_criteria_are_refused(bad):
    with pytest.raises(ValueError):
        cohort.AdmissionCriteria(**bad)


def test_shares_of_categories(spark):
    rows = [("a", 1, True), ("a", 2, True), ("b", 1, True), ("a", 1, False), (None, 2, None), (None, 2, False)]
    found = {(r["variable_name"], r["category"]): tuple(r)[2:] for r in cohort.category_bias(spark.createDataFrame(rows, "x string, y int, kept boolean"), F.col("kept"), ["x", "y"]).collect()}
    assert found["x", "a"][:2] == (2, 1) and found["x", "a"][2:4] == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    assert found["x", None][:2] == (0, 2) and found["x", "b"][:4] == (1, 0, pytest.approx(1 / 3), 0.0)
    assert found["x", "a"][4] == pytest.approx((2 / 3 - 1 / 3) / (2 / 9) ** 0.5) and found["y", "1"][:2] == (2, 1) and len(found) == 5
