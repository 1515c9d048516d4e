"""First-day summaries of gases, coma scale, laboratory, dialysis and weight: from six hours before the stay to one day after its start."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.concepts import bedside, measurements
from tessera.functions.compat import decimal_text
from tessera.operators.pivot import guarded

# What each table is summarised by; abs_ columns have their names turned round.
GASES = (
    "lactate", "ph", "so2", "po2", "pco2", "aado2", "aado2_calc", "pao2fio2ratio", "baseexcess", "bicarbonate", "totalco2", "hematocrit", "hemoglobin", "carboxyhemoglobin", "methemoglobin", "temperature",
    "chloride", "calcium", "glucose", "potassium", "sodium",
)
LABS = {
    "complete_blood_count": {"hematocrit": "hematocrit", "hemoglobin": "hemoglobin", "platelet": "platelets", "wbc": "wbc"},
    "chemistry": {x: x for x in ("albumin", "globulin", "total_protein", "aniongap", "bicarbonate", "bun", "calcium", "chloride", "creatinine", "glucose", "sodium", "potassium")},
    "blood_differential": {
        **{f"{x}_abs": f"abs_{x}" for x in ("basophils", "eosinophils", "lymphocytes", "monocytes", "neutrophils")}, "atypical_lymphocytes": "atyps", "bands": "bands", "immature_granulocytes": "imm_granulocytes",
        "metamyelocytes": "metas", "nrbc": "nrbc",
    },
    "coagulation": {"d_dimer": "d_dimer", "fibrinogen": "fibrinogen", "thrombin": "thrombin", "inr": "inr", "pt": "pt", "ptt": "ptt"},
    "enzyme": {x: x for x in ("alt", "alp", "ast", "amylase", "bilirubin_total", "bilirubin_direct", "bilirubin_indirect", "ck_cpk", "ck_mb", "ggt", "ld_ldh")},
}


def _near(icustays: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    # the ends of the window are counted once for each stay, not for each of its rows
    stays = icustays.select("subject_id", "stay_id", "intime", (F.col("intime") - F.expr("interval 6 hour")).alias("_low"), (F.col("intime") + F.expr("interval 1 day")).alias("_high"))
    rows = rows.withColumnRenamed(key, "_key").drop("subject_id", "stay_id", "hadm_id")
    window = (F.col("charttime") >= F.col("_low")) & (F.col("charttime") <= F.col("_high"))
    return stays.join(rows, (F.col(key) == F.col("_key")) & F.coalesce(window, F.lit(False)), "left").drop("_low", "_high")


def _extremes(columns: dict[str, str]) -> list:
    return [f(c).alias(f"{name}_{end}") for c, name in columns.items() for f, end in ((F.min, "min"), (F.max, "max"))]


def first_day_bg(gases: DataFrame, icustays: DataFrame, specimen: str | None = None) -> DataFrame:
    some = gases.where(F.col("specimen") == specimen) if specimen else gases
    return _near(icustays, some, "subject_id").groupBy("subject_id", "stay_id").agg(*_extremes({x: x for x in GASES}))


first_day_bg_art = partial(first_day_bg, specimen="ART.")


def first_day_gcs(scales: DataFrame, icustays: DataFrame) -> DataFrame:
    """The lowest scale of the day; of equal ones the earliest."""
    nth = F.row_number().over(Window.partitionBy("stay_id").orderBy(F.col("gcs").asc_nulls_first(), "charttime"))
    rows = _near(icustays, scales, "stay_id").withColumn("nth", nth).where("nth = 1")
    return rows.select("subject_id", "stay_id", F.col("gcs").alias("gcs_min"), "gcs_motor", "gcs_verbal", "gcs_eyes", "gcs_unable")


def first_day_chart(chartevents: DataFrame, icustays: DataFrame, vitals: tuple[str, ...]) -> DataFrame:
    """What first_day_vitalsign (extremes of some vitals) and first_day_gcs take of charts, from one scan and one aggregation by stay and time; one row for each stay. Events from twelve hours ahead of the stay to one day after its start are needed."""
    code = F.col("itemid")
    items = [i for i in measurements.vital_items() if i.name in vitals]
    wanted = {x for i in items for x in i.items} | set(bedside.SCALE)
    events = chartevents.where(code.isin(*sorted(wanted)) & F.col("stay_id").isNotNull()).withColumn("valuenum", measurements.in_celsius())
    means = [F.avg(guarded(i, code, F.col("valuenum"))).alias(i.name) for i in items]
    wide = events.groupBy("subject_id", "stay_id", "charttime").agg(*means, *bedside.scale_parts(), F.max(F.when(code.isin(*bedside.SCALE), 1)).alias("scaled"))
    if "temperature" in vitals:
        wide = wide.withColumn("temperature", F.round(decimal_text(F.col("temperature")), 2))
    # the row before is the last one that has a part of the scale
    line = Window.partitionBy("stay_id").orderBy(F.col("charttime").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    scale = F.when(F.col("scaled") == 1, F.struct("charttime", *bedside.BEST))
    wide = wide.withColumn("_last", F.last(scale, ignorenulls=True).over(line))
    wide = wide.withColumns(bedside.carried_parts(lambda c: F.col(f"_last.{c}")))
    rows = _near(icustays, wide.select("stay_id", "charttime", *vitals, *bedside.scale_columns(), "scaled"), "stay_id")
    parts = [f"gcs_{p}" for p in bedside.BEST]
    least = F.min(F.when(F.col("scaled") == 1, F.struct("gcs", "charttime", *parts, "gcs_unable"))).alias("least")
    days = rows.groupBy("stay_id").agg(*_extremes({x: x for x in vitals}), least)
    return days.select("stay_id", *[f"{x}_{end}" for x in vitals for end in ("min", "max")], F.col("least.gcs").alias("gcs_min"), *[f"least.{p}" for p in parts], "least.gcs_unable")


def first_day_lab(*tables: DataFrame) -> DataFrame:
    """Extremes of five laboratory tables, given in the order of LABS, then icustays: one aggregate over their union, not a join for each."""
    *labs, icustays = tables
    rows = [t.select("subject_id", "charttime", *[F.col(c).cast("double").alias(n) for c, n in names.items()]) for t, names in zip(labs, LABS.values(), strict=True)]
    union = rows[0]
    for more in rows[1:]:
        union = union.unionByName(more, allowMissingColumns=True)
    return _lab_extremes(union, icustays)


def _lab_extremes(rows: DataFrame, icustays: DataFrame) -> DataFrame:
    return _near(icustays, rows, "subject_id").groupBy("subject_id", "stay_id").agg(*_extremes({x: x for names in LABS.values() for x in names.values()}))


def first_day_lab_of(rows: DataFrame, icustays: DataFrame) -> DataFrame:
    """The same from rows that hold the columns of all five tables."""
    return _lab_extremes(rows.select("subject_id", "charttime", *[F.col(c).cast("double").alias(n) for names in LABS.values() for c, n in names.items()]), icustays)


def first_day_rrt(dialysis: DataFrame, icustays: DataFrame) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.collect_set("dialysis_type")), ", ")
    return _near(icustays, dialysis, "stay_id").groupBy("subject_id", "stay_id").agg(
        F.max("dialysis_present").alias("dialysis_present"), F.max("dialysis_active").alias("dialysis_active"), F.when(F.count("dialysis_type") > 0, kinds).alias("dialysis_type")
    )


def first_day_weight(weights: DataFrame, icustays: DataFrame) -> DataFrame:
    """Weights whose interval begins by the end of the first day, however early."""
    stays = icustays.select("subject_id", "stay_id", "intime")
    rows = stays.join(weights.withColumnRenamed("stay_id", "s"), (F.col("stay_id") == F.col("s")) & (F.col("starttime") <= F.col("intime") + F.expr("interval 1 day")), "left")
    admit = F.avg(F.when(F.col("weight_type") == "admit", F.col("weight")))
    return rows.groupBy("subject_id", "stay_id").agg(admit.alias("weight_admit"), F.avg("weight").alias("weight"), F.min("weight").alias("weight_min"), F.max("weight").alias("weight_max"))
