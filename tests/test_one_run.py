"""Tables that are made otherwise in one run: the same rows, from fewer scans and shuffles of events."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.concepts import CONCEPTS, ONE_RUN, bedside, firstday, measurements, scores, stays
from tessera.plans.registry import queries

FOLDER = "/root/testdata/sf0.001"
T = datetime(2150, 1, 1)
LABS = "specimen_id long, subject_id long, hadm_id long, charttime timestamp_ntz, itemid long, value string, valuenum double"
CHART = "subject_id long, stay_id long, charttime timestamp_ntz, storetime timestamp_ntz, itemid long, value string, valuenum double"


def plan_of(spark, name):
    return queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def stays_of(spark):
    return spark.createDataFrame([(s, 10 + s, 100 + s, T + timedelta(hours=5 * s)) for s in range(6)] + [(1, 20, 120, T + timedelta(hours=30)), (2, 21, 121, None)], "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def charted(spark, items, seed):
    rnd, out = random.Random(seed), []
    for _ in range(1500):
        person, hours = rnd.choice([None, *range(6)]), rnd.choice([None, *range(-14, 60)])
        stay = rnd.choice([None, 120, 121, *[100 + (person or 0)] * 6])
        at = None if hours is None else T + timedelta(hours=hours)
        code, text = rnd.choice(items)
        number = rnd.choice([None, *[float(x) for x in range(1, 6)]])
        out.append((person, stay, at, rnd.choice([None, T, T + timedelta(minutes=rnd.randrange(9000))]), code, text if text else None if number is None else str(number), number))
    return spark.createDataFrame(out, CHART)


@pytest.mark.parametrize(("name", "scans", "deals"), [("concept_first_day_sofa", 13, 6), ("concept_sapsii", 10, 8), ("concept_sofa_12h", 17, 5), ("concept_sirs_12h", 7, 1), ("concept_apsiii", 11, 9), ("concept_lods", 10, 7)])
def test_events_are_laid_out_few_times(spark, name, scans, deals):
    """each of the laboratory tables laid out all laboratory events, and the slots of lines were shuffled in place of the lines."""
    plan = plan_of(spark, name)
    assert len(re.findall("Generate explode", plan)) <= scans
    assert len(re.findall("RepartitionByExpression", plan)) >= deals


def test_first_day_tables_of_near_events(spark):
    units = stays_of(spark)
    chart = charted(spark, [(220045, None), (220052, None), (223900, None), (223900, "No Response-ETT"), (223901, None), (220739, None)], 3)
    out = chart.select("stay_id", "charttime", F.when(F.col("itemid") > 222000, 227488).otherwise(226559).alias("itemid"), F.col("valuenum").alias("value"))
    for part, whole in ((chart, chart.where("charttime is not null")), (chart, chart)):
        near = ONE_RUN["chartevents_day"][0](part, units)
        assert 0 < near.count() < part.count()
        assert rows(stays.first_day_vitalsign(units, measurements.vitalsign(near))) == rows(stays.first_day_vitalsign(units, measurements.vitalsign(whole)))
    # of equal scales at one time the order is open, so one row for each stay and time
    scale = chart.dropDuplicates(["stay_id", "charttime"])
    assert rows(firstday.first_day_gcs(bedside.gcs(ONE_RUN["chartevents_scale_day"][0](scale, units)), units)) == rows(firstday.first_day_gcs(bedside.gcs(scale), units))
    near = ONE_RUN["outputevents_day"][0](out, units)
    assert rows(stays.first_day_urine_output(units, measurements.urine_output(near))) == rows(stays.first_day_urine_output(units, measurements.urine_output(out)))


def test_laboratory_tables_of_one_scan(spark):
    """Specimens whose rows disagree on the patient or the time, or lack them, count in each table by themselves."""
    rnd, events = random.Random(7), []
    codes = [50912, 51006, 50868, 51301, 51300, 51265, 51237, 51275, 50885, 50861, 51244, 51256, 51146, 51144, 51199, 52069, 51218, 99999]
    for specimen in [None, *range(150)]:
        person, at = rnd.randrange(6), T + timedelta(hours=rnd.randrange(-10, 50))
        for code in rnd.choices(codes, k=9):
            odd = (specimen or 0) % 3 == 0
            events.append((
                specimen, rnd.choice([person, None, (person + 1) % 6]) if odd else person, None, rnd.choice([at, None, at + timedelta(hours=20)]) if odd else at, code, None, rnd.choice([None, -4.0, 0.0, 0.5, 3.0, 12.0, 160.0, 800.0]),
            ))
    events, units = spark.createDataFrame(events, LABS), stays_of(spark)
    tables = [CONCEPTS[x][0](events) for x in firstday.LABS]
    assert rows(firstday.first_day_lab_of(measurements.laboratory(events, "subject_id"), units)) == rows(firstday.first_day_lab(*tables, units))


def test_first_device_and_support(spark):
    items = [(223834, None), (227582, None), (227287, None), (223849, "CMV"), (223849, "Standby"), (229314, "NIV"), (224690, None)] + [(226732, x) for x in ("None", "Bipap mask ", "Endotracheal tube", "Nasal cannula", "Other", None)]
    chart = charted(spark, items, 5)
    whole = bedside.oxygen_delivery(chart)
    found = bedside.first_device(chart)
    # rows of a flow that are equal but for their stay leave it open whose stay counts
    assert rows(found) == rows(whole.select("stay_id", "charttime", "o2_delivery_device_1"))
    assert found.where("o2_delivery_device_1 is not null").count() > 0
    setting = measurements.ventilator_setting(chart)
    assert rows(bedside.ventilation(setting, found)) == rows(bedside.ventilation(setting, whole)) != []


@pytest.mark.parametrize(("name", "scans"), [("concept_apsiii", 10), ("concept_lods", 9)])
def test_vitals_and_scale_share_a_scan(spark, name, scans):
    """vitals and coma scale each laid out the slots of all charts, ordered them and met the stays by themselves."""
    plan = plan_of(spark, name)
    assert len(re.findall("Generate explode", plan)) <= scans
    assert not re.search(r"max\(CASE WHEN \(itemid#\d+L = 52033\) THEN value#", plan)


def test_first_day_of_charts_by_one_aggregation(spark):
    """a stay's row before counts for the scale only where it has a part of it, whatever else was charted between."""
    units = stays_of(spark)
    items = [(220045, None), (220052, None), (220210, None), (223761, None), (223762, None), (225664, None), (223900, None), (223900, "No Response-ETT"), (223901, None), (220739, None), (1, None)]
    chart = charted(spark, items, 11)
    chart = chart.withColumn("valuenum", F.when(F.col("itemid") == 223761, F.col("valuenum") + 95).when(F.col("itemid") == 223762, F.col("valuenum") + 35).otherwise(F.col("valuenum")))
    owner = chart.groupBy("stay_id").agg(F.max("subject_id").alias("owner"))
    # of equal scales at one time the order is open, so one patient for each stay
    chart = chart.join(owner, "stay_id").withColumn("subject_id", F.col("owner")).drop("owner")
    vitals = ("heart_rate", "mbp", "resp_rate", "temperature", "glucose")
    near = ONE_RUN["chartevents_scale_day"][0](chart, units)
    found = firstday.first_day_chart(near, units, vitals)
    signs = stays.first_day_vitalsign(units, measurements.vitalsign(chart)).select("stay_id", *[f"{v}_{end}" for v in vitals for end in ("min", "max")])
    whole = scores._by_stay(units.select("stay_id"), signs, firstday.first_day_gcs(bedside.gcs(chart), units))
    assert rows(found) == rows(whole)
    assert found.where("gcs_min is not null and heart_rate_min is not null").count() > 0


def test_arterial_gases(spark):
    """the largest name of a specimen decides, null names and names beyond the arterial one included."""
    rnd, events = random.Random(13), []
    for specimen in [None, *range(120)]:
        person, at = rnd.choice([None, *range(5)]), rnd.choice([None, T, T + timedelta(hours=rnd.randrange(5))])
        names = rnd.choices(["ART.", "VEN.", "ABC", None, "", "ART", "art."], k=rnd.randrange(4))
        events += [(specimen, person, 10, at, 52033, x, rnd.choice([None, 3.0])) for x in names]
        events += [(specimen, person, 10, at, code, None, float(rnd.randrange(1, 90))) for code in rnd.choices([50821, 50818, 50820, 50816], k=5)]
    events, chart = spark.createDataFrame(events, LABS), charted(spark, [(223835, None), (220277, None)], 17)
    whole = bedside.bg(events, chart).where("specimen = 'ART.'")
    assert rows(bedside.bg_art(events, chart)) == rows(whole) != []
