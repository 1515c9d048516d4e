"""Tables with a row for each stay, admission or hour, and first-day summaries of the measurement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import decimal_text, integer_sequence, seconds_between
from tessera.operators.relational import spread

# The heart-rate and creatinine items, seconds of a year, summarised vital signs.
HEART_RATE, CREATININE, YEAR_SECONDS = 220045, 50912, 31556908.8
DAY_VITALS = ("heart_rate", "sbp", "dbp", "mbp", "resp_rate", "temperature", "spo2", "glucose")


def icustay_times(chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """First and last time of a heart rate; null for stays without one."""
    seen = chartevents.where(F.col("itemid") == HEART_RATE).groupBy("stay_id").agg(F.min("charttime").alias("intime_hr"), F.max("charttime").alias("outtime_hr"))
    return icustays.select("subject_id", "hadm_id", "stay_id").join(seen, "stay_id", "left").select("subject_id", "hadm_id", "stay_id", "intime_hr", "outtime_hr")


def icustay_hourly(times: DataFrame) -> DataFrame:
    """A row for each hour from 24 before the first full hour to the last; stays without times have none."""
    first, last = _hour_ends()
    hours = times.select("stay_id", first.alias("first"), F.explode(integer_sequence(F.lit(-24).cast("long"), last)).alias("hr"))
    return hours.select("stay_id", "hr", F.timestamp_add("HOUR", F.col("hr").cast("int"), F.col("first")).alias("endtime"))


def hours_by_stay(times: DataFrame) -> DataFrame:
    """icustay_hourly, dealt by the stay before its hours are laid out."""
    return icustay_hourly(spread(times, "stay_id"))


def times_up_to(times: DataFrame, ends: DataFrame) -> DataFrame:
    """Times of the stays of ends (stay_id, until), the last one cut there, so that all hours that end by then are left."""
    return times.join(ends, "stay_id").withColumn("outtime_hr", F.least("outtime_hr", "until")).drop("until")


def up_to(events: DataFrame, ends: DataFrame, time: str = "charttime") -> DataFrame:
    """Events of the stays of ends (stay_id, until) that are no later. Like near, it neither sorts nor moves events that are dealt by the stay."""
    ends = ends.select(F.col("stay_id").alias("_key"), F.col("until").alias("_until"))
    inside = F.coalesce(F.col(time) <= F.col("_until"), F.lit(False))
    return events.join(ends.hint("shuffle_hash"), (F.col("stay_id") == F.col("_key")) & inside, "left_semi")


def first_hour(times: DataFrame) -> DataFrame:
    """The end of hour 0 of icustay_hourly, and its last hour."""
    first, last = _hour_ends()
    return times.where(last >= 0).select("stay_id", first.alias("first"), last.alias("last"))


def _hour_ends() -> tuple[Column, Column]:
    """The end of hour 0, and the last hour."""
    start = F.date_trunc("hour", F.col("intime_hr")).cast("timestamp_ntz")
    first = F.when(start == F.col("intime_hr"), start).otherwise(start + F.expr("interval 1 hour"))
    return first, F.ceil(seconds_between(F.col("intime_hr"), F.col("outtime_hr")) / 3600).cast("long")


def age(admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """Age in years at admission, counted from the first of January of the anchor year."""
    joined = admissions.select("subject_id", "hadm_id", "admittime").join(patients.select("subject_id", "anchor_age", "anchor_year"), "subject_id")
    anchor = F.make_date("anchor_year", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return joined.withColumn("age", F.col("anchor_age") + seconds_between(anchor, F.col("admittime")) / YEAR_SECONDS)


def kdigo_creatinine(labevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """Mean creatinine by stay and time from seven days before admission on, and the least of the 48 hours and 7 days strictly before; windows in place of self-joins."""
    lab = labevents.where((F.col("itemid") == CREATININE) & (F.col("valuenum") <= 150)).select(F.col("subject_id").alias("s"), "charttime", "valuenum")
    stays = icustays.select("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    inside = (F.col("subject_id") == F.col("s")) & (F.col("charttime") >= F.col("intime") - F.expr("interval 7 day")) & (F.col("charttime") <= F.col("outtime"))
    means = stays.join(lab, inside, "left").groupBy("hadm_id", "stay_id", "charttime").agg(F.avg("valuenum").alias("creat"))
    frame = "min(creat) over (partition by stay_id order by charttime range between interval '{} 00:00:00' day to second preceding and interval '0 00:00:00.000001' day to second preceding)"
    return means.select("*", F.expr(frame.format(2)).alias("creat_low_past_48hr"), F.expr(frame.format(7)).alias("creat_low_past_7day"))


def _first_day(icustays: DataFrame, rows: DataFrame, hours_before: int) -> DataFrame:
    """Every stay with its rows from hours_before its start to one day after, both ends included."""
    ends = (F.col("intime") - F.expr(f"interval {hours_before} hour")).alias("_low"), (F.col("intime") + F.expr("interval 1 day")).alias("_high")  # once for each stay, not for each of its rows
    rows = rows.drop("subject_id").withColumnRenamed("stay_id", "s")
    inside = (F.col("charttime") >= F.col("_low")) & (F.col("charttime") <= F.col("_high"))
    return icustays.select("subject_id", "stay_id", "intime", *ends).join(rows, (F.col("stay_id") == F.col("s")) & F.coalesce(inside, F.lit(False)), "left").drop("_low", "_high")


def near(events: DataFrame, icustays: DataFrame, key: str, before: int, after: int) -> DataFrame:
    """Events from `before` hours ahead of the start of a stay of their key to `after` hours behind it, ends included; each once, however many stays it is near to.

    The stays of a partition are hashed, so events are neither sorted nor moved where they are dealt by the key already.
    """
    spans = icustays.select(F.col(key).alias("_key"), (F.col("intime") - F.expr(f"interval {before} hour")).alias("_low"), (F.col("intime") + F.expr(f"interval {after} hour")).alias("_high"))
    inside = F.coalesce((F.col("charttime") >= F.col("_low")) & (F.col("charttime") <= F.col("_high")), F.lit(False))  # never null, so no test for null times goes ahead of the events' own filters
    return events.join(spans.hint("shuffle_hash"), (F.col(key) == F.col("_key")) & inside, "left_semi")


def first_day_vitalsign(icustays: DataFrame, vitals: DataFrame) -> DataFrame:
    columns = [f(v).alias(f"{v}_{name}") for v in DAY_VITALS for f, name in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    return _first_day(icustays, vitals, 6).groupBy("subject_id", "stay_id").agg(*columns)


def first_day_urine_output(icustays: DataFrame, urine: DataFrame) -> DataFrame:
    return _first_day(icustays, urine, 0).groupBy("subject_id", "stay_id").agg(F.sum("urineoutput").alias("urineoutput"))


def first_day_height(icustays: DataFrame, heights: DataFrame) -> DataFrame:
    return _first_day(icustays, heights, 6).groupBy("subject_id", "stay_id").agg(F.round(decimal_text(F.avg("height")), 2).alias("height"))
