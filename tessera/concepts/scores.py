"""Severity and organ-failure scores: rules over first-day and hourly tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.concepts.firstday import _near
from tessera.functions.compat import decimal_text, seconds_between
from tessera.operators.relational import spread
from tessera.operators.score import logistic
from tessera.operators.timeops import interval_join

Rules = list[tuple[str, object]]


def case(rules: Rules, otherwise: object = 0) -> str:
    """The points of the first rule that holds, as SQL."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {'NULL' if points is None else points}" for condition, points in rules) + f" ELSE {otherwise} END"


# Published thresholds and points, in the order in which they are tried. Points of None: nothing was measured.
PLATELETS: Rules = [("platelet_min < 20", 4), ("platelet_min < 50", 3), ("platelet_min < 100", 2), ("platelet_min < 150", 1), ("platelet_min IS NULL", None)]
LIVER: Rules = [("bilirubin_max >= 12.0", 4), ("bilirubin_max >= 6.0", 3), ("bilirubin_max >= 2.0", 2), ("bilirubin_max >= 1.2", 1), ("bilirubin_max IS NULL", None)]
CIRCULATION: Rules = [
    ("rate_dopamine > 15 OR rate_epinephrine > 0.1 OR rate_norepinephrine > 0.1", 4), ("rate_dopamine > 5 OR rate_epinephrine <= 0.1 OR rate_norepinephrine <= 0.1", 3),
    ("rate_dopamine > 0 OR rate_dobutamine > 0", 2), ("mbp_min < 70", 1), ("coalesce(mbp_min, rate_dopamine, rate_dobutamine, rate_epinephrine, rate_norepinephrine) IS NULL", None),
]
COMA: Rules = [("gcs_min BETWEEN 13 AND 14", 1), ("gcs_min BETWEEN 10 AND 12", 2), ("gcs_min BETWEEN 6 AND 9", 3), ("gcs_min < 6", 4), ("gcs_min IS NULL", None)]
KIDNEY: Rules = [
    ("creatinine_max >= 5.0", 4), ("urine < 200", 4), ("creatinine_max >= 3.5", 3), ("urine < 500", 3), ("creatinine_max >= 2.0", 2), ("creatinine_max >= 1.2", 1), ("coalesce(urine, creatinine_max) IS NULL", None),
]
BREATH_DAY: Rules = [("vent < 100", 4), ("vent < 200", 3), ("novent < 300", 2), ("novent < 400", 1), ("coalesce(vent, novent) IS NULL", None)]
BREATH_HOUR: Rules = [("vent < 100", 4), ("vent < 200", 3), ("novent < 300 OR vent < 300", 2), ("novent < 400 OR vent < 400", 1), ("coalesce(vent, novent) IS NULL", None)]
ORGANS = {"coagulation": PLATELETS, "liver": LIVER, "cardiovascular": CIRCULATION, "cns": COMA, "renal": KIDNEY}
SIRS: dict[str, Rules] = {
    "temp_score": [("temperature_min < 36.0 OR temperature_max > 38.0", 1), ("temperature_min IS NULL", None)], "heart_rate_score": [("heart_rate_max > 90.0", 1), ("heart_rate_max IS NULL", None)],
    "resp_score": [("resp_rate_max > 20.0 OR paco2_min < 32.0", 1), ("coalesce(resp_rate_max, paco2_min) IS NULL", None)],
    "wbc_score": [("wbc_min < 4.0 OR wbc_max > 12.0 OR bands_max > 10", 1), ("coalesce(wbc_min, bands_max) IS NULL", None)],
}
OASIS: dict[str, Rules] = {
    "preiculos_score": [("preiculos IS NULL", None), ("preiculos < 10.2", 5), ("preiculos < 297", 3), ("preiculos < 1440", 0), ("preiculos < 18708", 2), ("true", 1)],
    "age_score": [("age IS NULL", None), ("age < 24", 0), ("age <= 53", 3), ("age <= 77", 6), ("age <= 89", 9), ("age >= 90", 7)],
    "gcs_score": [("gcs_min IS NULL", None), ("gcs_min <= 7", 10), ("gcs_min < 14", 4), ("gcs_min = 14", 3)],
    "heart_rate_score": [("heart_rate_max IS NULL", None), ("heart_rate_max > 125", 6), ("heart_rate_min < 33", 4), ("heart_rate_max BETWEEN 107 AND 125", 3), ("heart_rate_max BETWEEN 89 AND 106", 1)],
    "mbp_score": [("mbp_min IS NULL", None), ("mbp_min < 20.65", 4), ("mbp_min < 51", 3), ("mbp_max > 143.44", 3), ("mbp_min < 61.33", 2)],
    "resp_rate_score": [("resp_rate_min IS NULL", None), ("resp_rate_min < 6", 10), ("resp_rate_max > 44", 9), ("resp_rate_max > 30", 6), ("resp_rate_max > 22", 1), ("resp_rate_min < 13", 1)],
    "temp_score": [
        ("temperature_max IS NULL", None), ("temperature_max > 39.88", 6), ("temperature_min BETWEEN 33.22 AND 35.93", 4), ("temperature_max BETWEEN 33.22 AND 35.93", 4), ("temperature_min < 33.22", 3),
        ("temperature_min > 35.93 AND temperature_min <= 36.39", 2), ("temperature_max BETWEEN 36.89 AND 39.88", 2),
    ],
    "urineoutput_score": [("urineoutput IS NULL", None), ("urineoutput < 671.09", 10), ("urineoutput > 6896.80", 8), ("urineoutput BETWEEN 671.09 AND 1426.99", 5), ("urineoutput BETWEEN 1427.00 AND 2544.14", 1)],
    "mechvent_score": [("mechvent = 1", 9)], "electivesurgery_score": [("electivesurgery IS NULL", None), ("electivesurgery = 1", 0), ("true", 6)],
}
#: Which end of a pair of extremes each rule of OASIS has judged; the mean of both where none holds.
OASIS_WORST = {
    "heartrate": ("heart_rate", "heart_rate_score", ("max", "min", "max", "max")), "meanbp": ("mbp", "mbp_score", ("min", "min", "max", "min")),
    "resprate": ("resp_rate", "resp_rate_score", ("min", "max", "max", "max", "min")), "temp": ("temperature", "temp_score", ("max", "min", "max", "min", "min", "max")),
}
CREATININE_STAGE: Rules = [
    ("creat >= creat_low_past_7day * 3.0", 3), ("creat >= 4 AND (creat_low_past_48hr <= 3.7 OR creat >= 1.5 * creat_low_past_7day)", 3), ("creat >= creat_low_past_7day * 2.0", 2),
    ("creat >= creat_low_past_48hr + 0.3", 1), ("creat >= creat_low_past_7day * 1.5", 1),
]
URINE_STAGE: Rules = [
    ("uo_rt_6hr IS NULL", None), ("early", 0), ("uo_tm_24hr >= 24 AND uo_rt_24hr < 0.3", 3), ("uo_tm_12hr >= 12 AND uo_rt_12hr = 0", 3), ("uo_tm_12hr >= 12 AND uo_rt_12hr < 0.5", 2),
    ("uo_tm_6hr >= 6 AND uo_rt_6hr < 0.5", 1),
]
PRESSORS = ("norepinephrine", "epinephrine", "dopamine", "dobutamine")


def _points(rules: Rules, name: str) -> Column:
    return F.expr(case(rules)).cast("int").alias(name)


def _total(names: list[str]) -> Column:
    return sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))


def _worst(values: str, score: str, ends: tuple[str, ...]) -> str:
    rules = [r for r in OASIS[score] if r[1] is not None]
    return case([(f"{OASIS[score][0][0]}", None), *[(c, f"{values}_{end}") for (c, _), end in zip(rules, ends, strict=True)]], f"({values}_min + {values}_max) / 2")


def _by_stay(icustays: DataFrame, *tables: DataFrame) -> DataFrame:
    out = icustays
    for table in tables:
        out = out.join(table.drop("subject_id", "hadm_id"), "stay_id", "left")
    return out


def _invasive(ventilation: DataFrame) -> DataFrame:
    return ventilation.where("ventilation_status = 'InvasiveVent'").select(F.col("stay_id").alias("v_stay"), F.col("starttime").alias("v_start"), F.col("endtime").alias("v_end"))


def ventilated_first_day(icustays: DataFrame, ventilation: DataFrame) -> DataFrame:
    """stay_id, mechvent: 1 where invasive ventilation begins or ends on the first day, or covers it."""
    day, low, high = F.expr("interval 1 day"), F.col("v_start"), F.col("v_end")
    touches = (low.between(F.col("intime"), F.col("intime") + day)) | (high.between(F.col("intime"), F.col("intime") + day)) | ((low <= F.col("intime")) & (high >= F.col("intime") + day))
    joined = icustays.select("stay_id", "intime").join(_invasive(ventilation), (F.col("stay_id") == F.col("v_stay")) & touches, "left")
    return joined.groupBy("stay_id").agg(F.max(F.col("v_stay").isNotNull().cast("int")).alias("mechvent"))


def _ratios(rows: DataFrame, ventilation: DataFrame, by: list[str]) -> DataFrame:
    """Least oxygenation ratio with and without invasive ventilation; rows: stay_id, charttime, pao2fio2ratio."""
    inside = (F.col("stay_id") == F.col("v_stay")) & (F.col("charttime") >= F.col("v_start")) & (F.col("charttime") <= F.col("v_end"))
    joined = rows.join(_invasive(ventilation), inside, "left")
    held = F.col("v_stay").isNotNull()
    return joined.groupBy(*by).agg(F.min(F.when(~held, F.col("pao2fio2ratio"))).alias("novent"), F.min(F.when(held, F.col("pao2fio2ratio"))).alias("vent"))


def first_day_sofa(icustays, bg, ventilation, vitals, labs, urine, scale, *pressors) -> DataFrame:
    """Organ failure over the first day; gases of every specimen count. pressors: norepinephrine, epinephrine, dopamine, dobutamine."""
    given = None
    for name, table in zip(PRESSORS, pressors, strict=True):
        rows = table.select("stay_id", F.col("starttime").alias("charttime"), F.col("vaso_rate").alias(f"rate_{name}"))
        given = rows if given is None else given.unionByName(rows, allowMissingColumns=True)
    rates = _near(icustays, given, "stay_id").groupBy("stay_id").agg(*[F.max(f"rate_{n}").alias(f"rate_{n}") for n in PRESSORS])
    ratios = _ratios(_near(icustays, bg, "subject_id").select("stay_id", "charttime", "pao2fio2ratio"), ventilation, ["stay_id"])
    labs = labs.select("stay_id", "creatinine_max", F.col("bilirubin_total_max").alias("bilirubin_max"), F.col("platelets_min").alias("platelet_min"))
    parts = _by_stay(icustays, rates, ratios, vitals.select("stay_id", "mbp_min"), labs, urine.select("stay_id", F.col("urineoutput").alias("urine")), scale.select("stay_id", "gcs_min"))
    names = ["respiration", *ORGANS]
    scored = parts.select("subject_id", "hadm_id", "stay_id", _points(BREATH_DAY, "respiration"), *[_points(r, n) for n, r in ORGANS.items()])
    return scored.select("subject_id", "hadm_id", "stay_id", _total(names).alias("sofa"), *names)


def urine_of_day() -> Column:
    """Urine of 24 hours from that of the 22 to 30 hours that it took."""
    return F.when(F.col("uo_tm_24hr").between(22, 30), F.col("urineoutput_24hr") / F.col("uo_tm_24hr") * 24).alias("urine")


def _stacked(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables, null in the columns that a table lacks."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def sofa(icustays, hourly, bg, ventilation, vitals, scales, enzyme, chemistry, blood_count, urine_rate, *pressors) -> DataFrame:
    """Hourly organ failure and the worst of each organ over 24 rows; hours from 0 on. pressors: norepinephrine, epinephrine, dopamine, dobutamine."""
    stays = icustays.select("subject_id", "hadm_id", "stay_id")
    grid = hourly.where("hr = 0").join(stays, "stay_id").select("hadm_id", "stay_id", F.col("endtime").alias("first"))
    art = stays.join(bg.where("specimen = 'ART.'").select("subject_id", "charttime", "pao2fio2ratio"), "subject_id").select("stay_id", "charttime", "pao2fio2ratio")
    # Points in time of one key are one table, so that each meets the grid once; an hour's number takes the place of a join on ranges.
    by_stay = _stacked([
        _ratios(art, ventilation, ["stay_id", "charttime"]), vitals.select("stay_id", "charttime", F.col("mbp").alias("mbp_min")), scales.select("stay_id", "charttime", F.col("gcs").alias("gcs_min")),
        urine_rate.select("stay_id", "charttime", urine_of_day()),
    ]).join(grid.drop("hadm_id"), "stay_id")
    by_admission = _stacked([
        enzyme.select("hadm_id", "charttime", F.col("bilirubin_total").alias("bilirubin_max")), chemistry.select("hadm_id", "charttime", F.col("creatinine").alias("creatinine_max")),
        blood_count.select("hadm_id", "charttime", F.col("platelet").alias("platelet_min")),
    ]).join(grid, "hadm_id").drop("hadm_id")
    points = by_stay.unionByName(by_admission, allowMissingColumns=True).withColumn("hr", _hour("charttime")).drop("first", "charttime")
    # An infusion covers the hours whose end lies in (start, end]: they are listed, and met by their number.
    given = _stacked([t.select("stay_id", F.col("starttime").alias("low"), F.col("endtime").alias("high"), F.col("vaso_rate").alias(f"rate_{n}")) for n, t in zip(PRESSORS, pressors, strict=True)])
    spans = given.join(grid.drop("hadm_id"), "stay_id").withColumns({"from": (F.floor(_hours_from("low")) + 1).cast("long"), "to": F.floor(_hours_from("high")).cast("long")}).where("`from` <= `to`")
    rates = spans.withColumn("hr", F.explode(F.sequence("from", "to"))).select("stay_id", "hr", *[f"rate_{n}" for n in PRESSORS])
    # The grid's hours and all that is measured go to the stay's partition once; hours, windows and scores follow there without another shuffle.
    hours = hourly.join(stays.select("stay_id"), "stay_id", "left_semi").select("stay_id", F.col("hr").cast("long").alias("hr"), "endtime")
    return _scored_hours(hours.unionByName(points, allowMissingColumns=True).unionByName(rates, allowMissingColumns=True).repartition("stay_id"))


def sofa_of(icustays, first_hour, hourly, gases, ventilation, pressure, scales, labs, urine, given) -> DataFrame:
    """sofa from arterial gases, one table of laboratory values, urine of 24 hours and one table of infusions. Tables of a stay's rows are dealt by the stay already: they meet its hours there, so that only
    gases and laboratory values are moved, and neither hours nor points are."""
    stays = icustays.select("subject_id", "hadm_id", "stay_id")
    grid = first_hour.join(stays, "stay_id")
    first = first_hour.hint("shuffle_hash")  # one row for each stay, so rows that meet it are not sorted

    def in_hours(rows: DataFrame) -> DataFrame:
        return rows.withColumn("hr", _hour("charttime")).where(F.col("hr").between(-24, F.col("last"))).drop("first", "last")

    art = spread(in_hours(grid.drop("hadm_id").join(gases.select("subject_id", "charttime", "pao2fio2ratio"), "subject_id")).drop("subject_id"), "stay_id")
    tested = labs.select("hadm_id", "charttime", F.col("bilirubin_total").alias("bilirubin_max"), F.col("creatinine").alias("creatinine_max"), F.col("platelet").alias("platelet_min"))
    tested = spread(in_hours(tested.join(grid.drop("subject_id"), "hadm_id")).drop("hadm_id", "charttime"), "stay_id")
    charted = [pressure.select("stay_id", "charttime", F.col("mbp").alias("mbp_min")), scales.select("stay_id", "charttime", F.col("gcs").alias("gcs_min")), urine.select("stay_id", "charttime", urine_of_day())]
    points = [_ratios(art, ventilation, ["stay_id", "hr"]), tested, *[in_hours(x.join(first, "stay_id")).drop("charttime") for x in charted]]
    spans = given.join(first, "stay_id").withColumns({"from": (F.floor(_hours_from("starttime")) + 1).cast("long"), "to": F.floor(_hours_from("endtime")).cast("long")}).where("`from` <= `to`")
    rates = spans.withColumn("hr", F.explode(F.sequence("from", "to"))).select("stay_id", "hr", *[f"rate_{n}" for n in PRESSORS])
    hours = hourly.join(stays.select("stay_id").hint("shuffle_hash"), "stay_id", "left_semi").select("stay_id", F.col("hr").cast("long").alias("hr"), "endtime")
    return _scored_hours(_stacked([hours, *points, rates]))


def _hours_from(time: str) -> Column:
    """Hours from the end of a stay's hour 0 to a time."""
    return seconds_between(F.col("first"), F.col(time)) / 3600


def _hour(time: str) -> Column:
    return F.ceil(_hours_from(time)).cast("long")


def _scored_hours(every: DataFrame) -> DataFrame:
    """sofa from the hours of the stays, which have an end, and what is measured in them."""
    least, most = ("novent", "vent", "mbp_min", "gcs_min", "platelet_min"), ("urine", "bilirubin_max", "creatinine_max", *[f"rate_{n}" for n in PRESSORS])
    extremes = [F.min(c).alias(c) for c in least] + [F.max(c).alias(c) for c in most]
    parts = every.groupBy("stay_id", "hr").agg(F.max("endtime").alias("endtime"), *extremes).where("endtime is not null").withColumn("starttime", F.col("endtime") - F.expr("interval 1 hour"))
    names = ["respiration", *ORGANS]
    scored = parts.select("*", _points(BREATH_HOUR, "respiration"), *[_points(r, n) for n, r in ORGANS.items()])
    # A frame counts its rows again for each row: one number with a bit for each organ and score (1 to 4) is counted in place of six; the highest bit of an organ is its worst score.
    bits = sum((F.when(F.col(n) > 0, F.expr(f"shiftleft(1, {4 * i - 1} + {n})")).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    frame = Window.partitionBy("stay_id").orderBy("hr").rowsBetween(-23, 0)
    scored = scored.withColumn("_bits", bits).withColumn("_seen", F.bit_or("_bits").over(frame))
    worst = {f"{n}_24hours": F.element_at(F.array(*[F.lit(x.bit_length()) for x in range(16)]), F.shiftright("_seen", 4 * i).bitwiseAND(15) + 1) for i, n in enumerate(names)}
    scored = scored.withColumns(worst).withColumn("sofa_24hours", _total([f"{n}_24hours" for n in names])).where("hr >= 0")
    return scored.select(
        "stay_id", "hr", "starttime", "endtime", F.col("novent").alias("pao2fio2ratio_novent"), F.col("vent").alias("pao2fio2ratio_vent"), "rate_epinephrine", "rate_norepinephrine", "rate_dopamine",
        "rate_dobutamine", F.col("mbp_min").alias("meanbp_min"), "gcs_min", F.col("urine").alias("uo_24hr"), "bilirubin_max", "creatinine_max", "platelet_min", *names, *[f"{n}_24hours" for n in names], "sofa_24hours",
    )


def sirs(icustays: DataFrame, gases: DataFrame, vitals: DataFrame, labs: DataFrame) -> DataFrame:
    parts = _by_stay(
        icustays, gases.select("stay_id", F.col("pco2_min").alias("paco2_min")), vitals.select("stay_id", "temperature_min", "temperature_max", "heart_rate_max", "resp_rate_max"),
        labs.select("stay_id", "wbc_min", "wbc_max", "bands_max"),
    ).select("subject_id", "hadm_id", "stay_id", *[_points(r, n) for n, r in SIRS.items()])
    return parts.select("subject_id", "hadm_id", "stay_id", _total(list(SIRS)).alias("sirs"), *SIRS)


def meld(icustays: DataFrame, labs: DataFrame, dialysis: DataFrame) -> DataFrame:
    """Liver score from logarithms of creatinine, bilirubin and clotting, floored at 1, at most 40; sodium counts beyond 11."""
    rows = _by_stay(icustays, labs.select("stay_id", "creatinine_max", "bilirubin_total_max", "inr_max", "sodium_min"), dialysis.select("stay_id", F.col("dialysis_present").alias("rrt")))

    def floored(name: str) -> Column:
        return F.when(F.col(name) < 1, 0.0).otherwise(F.coalesce(F.ln(name), F.lit(0.0)))

    creatinine = 0.957 * F.when((F.col("rrt") == 1) | (F.col("creatinine_max") > 4.0), F.ln(F.lit(4.0))).otherwise(floored("creatinine_max"))
    raw = creatinine + 0.378 * floored("bilirubin_total_max") + (1.120 * floored("inr_max") + 0.643)
    sodium = F.when(F.col("sodium_min").isNull() | (F.col("sodium_min") > 137), 0.0).when(F.col("sodium_min") < 125, 12.0).otherwise(137.0 - F.col("sodium_min"))
    initial = F.when(raw > 4, 40.0).otherwise(F.round(decimal_text(raw), 1).cast("double") * 10)
    rows = rows.withColumns({"meld_initial": initial, "sodium_score": sodium})
    full = F.when(F.col("meld_initial") > 11, F.col("meld_initial") + 1.32 * F.col("sodium_score") - 0.033 * F.col("meld_initial") * F.col("sodium_score")).otherwise(F.col("meld_initial"))
    return rows.select("subject_id", "hadm_id", "stay_id", "meld_initial", full.alias("meld"), "rrt", "creatinine_max", "bilirubin_total_max", "inr_max", "sodium_min")


def kdigo_stages(icustays: DataFrame, creatinine: DataFrame, urine: DataFrame, dialysis: DataFrame) -> DataFrame:
    """Stages of kidney injury from creatinine, urine and dialysis, and the worst of the patient's rows within six hours of time since the stay began."""
    creatinine = creatinine.select("stay_id", "charttime", "creat_low_past_7day", "creat_low_past_48hr", "creat", _points(CREATININE_STAGE, "aki_stage_creat"))
    urine = urine.join(icustays.select("stay_id", "intime"), "stay_id").withColumn("early", F.col("charttime") <= F.col("intime") + F.expr("interval 6 hour"))
    urine = urine.select("stay_id", "charttime", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", _points(URINE_STAGE, "aki_stage_uo"))
    dialysis = dialysis.where("crrt_mode is not null").select("stay_id", "charttime", F.when(F.col("charttime").isNotNull(), 3).alias("aki_stage_crrt"))
    # Each table is met once, by full joins; its rows without a time say only that there are such, once for a stay.
    timed = []
    for table in (creatinine, urine, dialysis):
        known = F.col("charttime").isNotNull()
        at = F.coalesce("charttime", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at")
        timed.append(table.select("stay_id", at, known.alias("known"), *[F.when(known, F.col(c)).alias(c) for c in table.columns[2:]]))
    times = reduce(lambda x, y: x.join(y, ["stay_id", "at", "known"], "full"), timed)
    rows = icustays.select("subject_id", "hadm_id", "stay_id", "intime").join(times, "stay_id", "left").withColumn("charttime", F.when(F.col("known"), F.col("at")))
    stages = ("aki_stage_creat", "aki_stage_uo", "aki_stage_crrt")
    rows = rows.withColumns({"aki_stage": F.greatest(*[F.coalesce(F.col(s), F.lit(0)) for s in stages]), "second": seconds_between(F.col("intime"), F.col("charttime"))})
    frame = Window.partitionBy("subject_id").orderBy("second").rangeBetween(-21600, 0)
    return rows.select(
        "subject_id", "hadm_id", "stay_id", "charttime", "creat_low_past_7day", "creat_low_past_48hr", "creat", "aki_stage_creat", "uo_rt_6hr", "uo_rt_12hr", "uo_rt_24hr", "aki_stage_uo", "aki_stage_crrt",
        "aki_stage", F.max("aki_stage").over(frame).alias("aki_stage_smoothed"),
    )


def oasis(icustays, admissions, age, services, ventilation, scale, vitals, urine) -> DataFrame:
    """Ten components of the first day and the probability that goes with their sum."""
    day = F.expr("interval 1 day")
    stays = icustays.select("stay_id", "hadm_id", "intime")
    wards = services.select(F.col("hadm_id").alias("h"), "transfertime", "curr_service")
    surgical = F.lower("curr_service").contains("surg") | (F.col("curr_service") == "ORTHO")
    flags = stays.join(wards, (F.col("hadm_id") == F.col("h")) & (F.col("transfertime") < F.col("intime") + day), "left").groupBy("stay_id").agg(F.max(F.when(surgical, 1).otherwise(0)).alias("surgical"))
    vent = ventilated_first_day(icustays, ventilation)
    entered = admissions.select("hadm_id", "admittime", "admission_type")
    rows = icustays.join(entered, "hadm_id").join(age.select("hadm_id", "age"), "hadm_id", "left")
    rows = _by_stay(rows, flags, vent, scale.select("stay_id", "gcs_min"), vitals, urine)
    elective = F.when((F.col("admission_type") == "ELECTIVE") & (F.col("surgical") == 1), 1).when(F.col("admission_type").isNotNull() & F.col("surgical").isNotNull(), 0)
    rows = rows.withColumns({"preiculos": seconds_between(F.col("admittime"), F.col("intime")) / 60, "electivesurgery": elective})
    rows = rows.select("*", *[_points(r, n) for n, r in OASIS.items()], *[F.expr(_worst(*w)).alias(n) for n, w in OASIS_WORST.items()]).withColumn("oasis", _total(list(OASIS)))
    return rows.select(
        "subject_id", "hadm_id", "stay_id", "oasis", logistic(F.lit(-6.1746) + F.lit(0.1275) * F.col("oasis")).alias("oasis_prob"), "age", "preiculos", F.col("gcs_min").alias("gcs"), *OASIS_WORST, "urineoutput",
        "mechvent", "electivesurgery", *OASIS,
    )
