"""Kidney stages: tables that are taken once, and rows without a time."""

from datetime import datetime, timedelta

from tessera.concepts import scores

BEGIN = datetime(2020, 1, 1)


def test_stages_take_each_table_once(spark):
    """times were gathered from all three tables first, and the tables were made again for the joins."""
    stays = spark.createDataFrame([(s, 10 + s, 100 + s, BEGIN) for s in (1, 2, 3, 4)], "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz")
    hour = [BEGIN + timedelta(hours=h) for h in range(12)]
    creatinine = [(11, 101, hour[1], 1.0, 1.0, 1.0), (11, 101, hour[2], 3.1, 1.0, 1.0), (12, 102, None, None, None, None), (13, 103, None, None, None, None)]
    urine = [(101, hour[2], None, None, None, 2.0, 2.0, 2.0), (102, hour[8], 0.4, None, None, 7.0, 7.0, 7.0), (102, hour[8], 0.9, None, None, 7.0, 7.0, 7.0), (102, None, None, None, None, None, None, None)]
    dialysis = [(101, hour[5], "CVVH"), (103, None, "CVVH")]
    tables = [
        spark.createDataFrame(creatinine, "hadm_id long, stay_id long, charttime timestamp_ntz, creat double, creat_low_past_48hr double, creat_low_past_7day double").repartition(2),
        spark.createDataFrame(urine, "stay_id long, charttime timestamp_ntz, uo_rt_6hr double, uo_rt_12hr double, uo_rt_24hr double, uo_tm_6hr double, uo_tm_12hr double, uo_tm_24hr double"),
        spark.createDataFrame(dialysis, "stay_id long, charttime timestamp_ntz, crrt_mode string"),
    ]
    taken = spark.sparkContext.accumulator(0)

    def counted(batches):
        taken.add(1)
        yield from batches

    tables[0] = tables[0].coalesce(1).mapInArrow(counted, tables[0].schema)
    found = scores.kdigo_stages(stays, *tables).select("stay_id", "charttime", "creat", "aki_stage_creat", "uo_rt_6hr", "aki_stage_uo", "aki_stage_crrt", "aki_stage", "aki_stage_smoothed").collect()
    assert sorted(map(tuple, found), key=str) == sorted([
        (101, hour[1], 1.0, 0, None, None, None, 0, 0), (101, hour[2], 3.1, 3, None, None, None, 3, 3), (101, hour[5], None, None, None, None, 3, 3, 3), (102, None, None, None, None, None, None, 0, 0),
        (102, hour[8], None, None, 0.4, 1, None, 1, 1), (102, hour[8], None, None, 0.9, 0, None, 0, 1), (103, None, None, None, None, None, None, 0, 0), (104, None, None, None, None, None, None, 0, 0),
    ], key=str)
    assert taken.value == 1
