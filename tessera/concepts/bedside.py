"""Tables of the bedside record: weights, gases, consciousness, oxygen, ventilation, urine rates, dialysis and lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.concepts import measurements
from tessera.functions.compat import decimal_text, divide, ordered_choice, seconds_between, synonyms
from tessera.operators.pivot import Item, guarded_pivot
from tessera.operators.relational import spread
from tessera.operators.timeops import DAY, asof_latest, binned_interval_join, close_with_lead, interval_join, rolling

# Item codes, text values and bounds.
ADMIT_WEIGHT, DAILY_WEIGHT, HEART_RATE = 226512, 224639, 220045
GAS = {
    "aado2": (50801, None), "baseexcess": (50802, None), "bicarbonate": (50803, None), "totalco2": (50804, None), "carboxyhemoglobin": (50805, None), "chloride": (50806, None), "calcium": (50808, None),
    "glucose": (50809, 10000), "hematocrit": (50810, 100), "hemoglobin": (50811, None), "lactate": (50813, 10000), "methemoglobin": (50814, None), "so2": (50817, 100), "pco2": (50818, None),
    "ph": (50820, None), "po2": (50821, None), "potassium": (50822, None), "sodium": (50824, None), "temperature": (50825, None),
}
SPECIMEN, GAS_FIO2, CHART_SPO2, CHART_FIO2 = 52033, 50816, 220277, 223835
ARTERIAL = "ART."
MOTOR, VERBAL, EYES, INTUBATED = 223901, 223900, 220739, "No Response-ETT"
SCALE, BEST = (MOTOR, VERBAL, EYES), {"motor": 6, "verbal": 5, "eyes": 4}
OXYGEN_FLOW, OXYGEN_FLOW_OTHER, OXYGEN_FLOW_MORE, OXYGEN_DEVICE = 223834, 227582, 227287, 226732
TRACHEOSTOMY = ("Tracheostomy tube", "Trach mask ")
TUBE = ("Endotracheal tube",)
INVASIVE_MODES = (
    "(S) CMV", "APRV", "APRV/Biphasic+ApnPress", "APRV/Biphasic+ApnVol", "APV (cmv)", "Ambient", "Apnea Ventilation", "CMV", "CMV/ASSIST", "CMV/ASSIST/AutoFlow", "CMV/AutoFlow", "CPAP/PPS", "CPAP/PSV",
    "CPAP/PSV+Apn TCPL", "CPAP/PSV+ApnPres", "CPAP/PSV+ApnVol", "MMV", "MMV/AutoFlow", "MMV/PSV", "MMV/PSV/AutoFlow", "P-CMV", "PCV+", "PCV+/PSV", "PCV+Assist", "PRES/AC", "PRVC/AC", "PRVC/SIMV", "PSV/SBT",
    "SIMV", "SIMV/AutoFlow", "SIMV/PRES", "SIMV/PSV", "SIMV/PSV/AutoFlow", "SIMV/VOL", "SYNCHRON MASTER", "SYNCHRON SLAVE", "VOL/AC",
)
INVASIVE_HAMILTON = ("APRV", "APV (cmv)", "Ambient", "(S) CMV", "P-CMV", "SIMV", "APV (simv)", "P-SIMV", "VS", "ASV")
MASKS = ("Bipap mask ", "CPAP mask ")
NONINVASIVE_HAMILTON = ("DuoPaP", "NIV", "NIV-ST")
HIGH_FLOW = ("High flow nasal cannula",)
SUPPLEMENTAL = ("Non-rebreather", "Face tent", "Aerosol-cool", "Venti mask ", "Medium conc mask ", "Ultrasonic neb", "Vapomist", "Oxymizer", "High flow neb", "Nasal cannula")
CRRT_NUMBERS = {
    "access_pressure": 224149, "blood_flow": 224144, "citrate": 228004, "current_goal": 225183, "dialysate_rate": 224154, "effluent_pressure": 224151, "filter_pressure": 224150, "heparin_dose": 224145,
    "hourly_patient_fluid_removal": 224191, "prefilter_replacement_rate": 228005, "postfilter_replacement_rate": 228006, "replacement_rate": 224153, "return_pressure": 224152, "ultrafiltrate_output": 226457,
}
CRRT_TEXTS = {"crrt_mode": 227290, "dialysate_fluid": 225977, "heparin_concentration": 225958, "replacement_fluid": 225976}
CRRT_STATE = 224146
STATES = {
    "system_active": {"Active": 1, "Initiated": 1, "Reinitiated": 1, "New Filter": 1, "Recirculating": 0, "Discontinued": 0}, "clots": {"Clots Present": 1, "No Clot Present": 0},
    "clots_increasing": {"Clots Increasing": 1, "Clot Increasing": 1}, "clotted": {"Clotted": 1},
}
DIALYSIS_ACTIVE = (226499, 224154, 225183, 227438, 224191, 225806, 225807, 228004, 228005, 228006, 224144, 224145, 224153, 226457)
DIALYSIS_ACCESS = (226118, 227357, 225725)
DIALYSIS_NUMBERS = (225810, 225959, 227639, 224149, 224150, 224151, 224152, 224404, 224406)
DIALYSIS_TEXTS = (224135, 224139, 224146, 225323, 225740, 225776, 225951, 225952, 225953, 225954, 225956, 225958, 225961, 225963, 225965, 225976, 225977, 227124, 227290, 227638, 227640, 227753)
PERITONEAL = (225810, 225806, 225807, 227639, 225959, 225951, 225952, 225961, 225953, 225963, 225965, 227638, 227640)
IN_USE, CRRT_MODE, HEMODIALYSIS = 225965, 227290, 226499
DIALYSIS_INPUTS = (227536, 227525)
DIALYSIS_PROCEDURES = {225441: "IHD", 225802: "CRRT", 225803: "CVVHD", 225805: "Peritoneal", 225809: "CVVHDF", 225955: "SCUF", 224270: None, 225436: None}
IDLE_PROCEDURES = (224270, 225436)
LINES = (
    227719, 225752, 224269, 224267, 224270, 224272, 226124, 228169, 225202, 228286, 225204, 224263, 224560, 224264, 225203, 224273, 225789, 225761, 228201, 228202, 224268, 225199, 225315, 225205,
)
LINE_TYPES = {
    "Arterial Line": "Arterial", "A-Line": "Arterial", "CCO PA Line": "Continuous Cardiac Output PA", "CCO PAC": "Continuous Cardiac Output PA", "Dialysis Catheter": "Dialysis", "Dialysis Line": "Dialysis",
    "Tunneled (Hickman) Line": "Hickman", "IABP line": "IABP", "Multi-lumen": "Multi Lumen", "PA Catheter": "PA", "PA line": "PA", "PICC Line": "PICC", "PICC line": "PICC", "Pre-Sep Catheter": "Pre-Sep",
    "Presep Catheter": "Pre-Sep", "Trauma Line": "Trauma", "Trauma line": "Trauma", "TripleIntroducer": "Triple Introducer", "Indwelling Port (PortaCath)": "Portacath",
}
LINE_SITES = {
    "Left Antecub": "Left Antecube", "Left Axilla.": "Left Axilla", "Left Brachial.": "Left Brachial", "Left Femoral.": "Left Femoral", "Right Antecub": "Right Antecube", "Right Axilla.": "Right Axilla",
    "Right Brachial.": "Right Brachial", "Right Femoral.": "Right Femoral",
}


def _hours(n: int) -> Column:
    return F.expr(f"interval {n} hour")


def weight_durations(chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """Weights as intervals: the first admission weight counts from two hours before the stay, each lasts to the next, the last to two hours after the stay.

    Where the first weight comes after the start of the stay, it also fills the time before. Equal times are taken by type, then by weight.
    """
    kind = F.when(F.col("itemid") == ADMIT_WEIGHT, "admit").otherwise("daily")
    rows = chartevents.where(F.col("itemid").isin(ADMIT_WEIGHT, DAILY_WEIGHT) & (F.col("valuenum") > 0)).select("stay_id", "charttime", kind.alias("weight_type"), F.col("valuenum").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("stay_id", "weight_type").orderBy(F.col("charttime").asc_nulls_first(), "weight"))
    rows = rows.withColumn("nth", nth).join(icustays.select("stay_id", "intime", "outtime"), "stay_id")
    rows = rows.withColumn("starttime", F.when((F.col("weight_type") == "admit") & (F.col("nth") == 1), F.col("intime") - _hours(2)).otherwise(F.col("charttime")))
    order = ["starttime", "weight_type", "weight"]
    spans = close_with_lead(rows, "stay_id", order, "starttime", F.col("outtime") + _hours(2)).withColumn("place", F.row_number().over(Window.partitionBy("stay_id").orderBy(*order)))
    columns = ("stay_id", "starttime", "endtime", "weight", "weight_type")
    early = spans.where("place = 1 and intime < starttime").select("stay_id", (F.col("intime") - _hours(2)).alias("begin"), "starttime", "weight", "weight_type")
    return spans.select(*columns).union(early)


def bg(labevents: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Blood gases with an oxygen pressure, one for each patient and time (the least specimen), with the latest charted saturation and FiO2 before them."""
    return _gases(labevents, chartevents, Item("specimen", (SPECIMEN,), text=True))


def bg_art(labevents: DataFrame, chartevents: DataFrame) -> DataFrame:
    """The arterial rows of bg. The largest name of a specimen is arterial where one is and none is beyond it: marks of that are aggregated in place of names, which Spark would sort all events for."""
    place = F.when(F.col("value") > ARTERIAL, 2.0).when(F.col("value") == ARTERIAL, 1.0).when(F.col("value").isNotNull(), 0.0)
    marked = labevents.withColumn("valuenum", F.when(F.col("itemid") == SPECIMEN, place).otherwise(F.col("valuenum")))
    return _gases(marked, chartevents, Item("specimen", (SPECIMEN,)), F.col("specimen") == 1).withColumn("specimen", F.lit(ARTERIAL))


def _gases(labevents: DataFrame, chartevents: DataFrame, specimen: Item, kept: Column | None = None) -> DataFrame:
    """bg with the given item of the specimen; kept: a condition on rows that are the least of their patient and time."""
    v = F.col("valuenum")
    fraction = F.when((v > 20) & (v <= 100), v).when((v > 0.2) & (v <= 1.0), v * 100.0)
    numbers = labevents.withColumn("valuenum", F.when(F.col("itemid") == GAS_FIO2, fraction).otherwise(v))
    items = [Item(name, (code,), high=high) for name, (code, high) in GAS.items()] + [specimen, Item("fio2", (GAS_FIO2,))]
    gases = guarded_pivot(numbers, ["specimen_id"], "itemid", "valuenum", items, text="value", largest=("subject_id", "hadm_id", "charttime")).where("po2 is not null")
    gases = spread(gases, "subject_id")  # rows of one time are in the patient's partition, in which charts are met
    gases = gases.withColumn("nth", F.row_number().over(Window.partitionBy("subject_id", "charttime").orderBy("specimen_id"))).where("nth = 1").drop("nth")
    gases = gases.where(kept) if kept is not None else gases
    charted = F.when((v > 0.2) & (v <= 1), v * 100).when((v >= 20) & (v <= 100), v)
    oxygen = chartevents.where((F.col("itemid") == CHART_FIO2) & (v > 0) & (v <= 100)).groupBy("subject_id", F.col("charttime").alias("at")).agg(F.max(charted).alias("fio2_chartevents"))
    gases = asof_latest(gases, oxygen.where("fio2_chartevents > 0"), "subject_id", "charttime", "at", 4 * 3600, ["fio2_chartevents"], "at")
    share = F.coalesce("fio2", "fio2_chartevents")
    return gases.select(
        "subject_id", "hadm_id", "charttime", "specimen", "so2", "po2", "pco2", "fio2_chartevents", "fio2", "aado2", (share / 100 * (760 - 47) - F.col("pco2") / 0.8 - F.col("po2")).alias("aado2_calc"),
        (100 * F.col("po2") / share).alias("pao2fio2ratio"), "ph", "baseexcess", "bicarbonate", "totalco2", "hematocrit", "hemoglobin", "carboxyhemoglobin", "methemoglobin", "chloride", "calcium",
        "temperature", "potassium", "sodium", "lactate", "glucose",
    )


def gcs(chartevents: DataFrame) -> DataFrame:
    """Coma scale by stay and time. A part that is missing is carried from a row less than six hours before; who is intubated counts as 15."""
    wide = chartevents.where(F.col("itemid").isin(*SCALE)).groupBy("subject_id", "stay_id", "charttime").agg(*scale_parts())
    line = Window.partitionBy("stay_id").orderBy(F.col("charttime").asc_nulls_first())
    return wide.withColumns(carried_parts(lambda c: F.lag(c).over(line))).select("subject_id", "stay_id", "charttime", *scale_columns())


def scale_parts() -> list[Column]:
    """Aggregates of the parts of the coma scale."""
    code, v = F.col("itemid"), F.col("valuenum")
    tube = (code == VERBAL) & (F.col("value") == INTUBATED)
    return [F.max(F.when(code == MOTOR, v)).alias("motor"), F.max(F.when(tube, 0).when(code == VERBAL, v)).alias("verbal"), F.max(F.when(code == EYES, v)).alias("eyes"), F.max(F.when(tube, 1).otherwise(0)).alias("gcs_unable")]


def carried_parts(before: Callable[[str], Column]) -> dict[str, Column]:
    """What the stay's row before says of each part, where it is less than six hours older; before: a column of that row."""
    recent = before("charttime") > F.col("charttime") - _hours(6)
    return {f"{p}_before": F.when(recent, before(p)) for p in BEST}


def scale_columns() -> list[Column]:
    """The scale and its parts from the parts of a row and what is carried to it."""
    plain = sum((F.coalesce(F.col(p), F.lit(best)) for p, best in BEST.items()), F.lit(0))
    carried = sum((F.coalesce(F.col(p), F.col(f"{p}_before"), F.lit(best)) for p, best in BEST.items()), F.lit(0))
    before = F.coalesce(F.col("verbal_before") == 0, F.lit(False))
    score = F.when((F.col("verbal") == 0) | (F.col("verbal").isNull() & before), 15).when(before, plain).otherwise(carried)
    return [score.alias("gcs"), *[F.coalesce(p, f"{p}_before").alias(f"gcs_{p}") for p in BEST], F.col("gcs_unable")]


def oxygen_delivery(chartevents: DataFrame) -> DataFrame:
    """Oxygen flows, the latest stored of each time, with up to four devices in order of their names."""
    code = F.when(F.col("itemid") == OXYGEN_FLOW_OTHER, OXYGEN_FLOW).otherwise(F.col("itemid"))
    flows = chartevents.where(F.col("value").isNotNull() & F.col("itemid").isin(OXYGEN_FLOW, OXYGEN_FLOW_OTHER, OXYGEN_FLOW_MORE)).withColumn("itemid", code)
    flows = flows.groupBy("subject_id", "charttime", "itemid").agg(F.max(F.struct("storetime", "valuenum", "stay_id")).alias("r")).groupBy("subject_id", "charttime").agg(
        F.max("r.stay_id").alias("stay_id"), F.max(F.when(F.col("itemid") == OXYGEN_FLOW, F.col("r.valuenum"))).alias("o2_flow"),
        F.max(F.when(F.col("itemid") == OXYGEN_FLOW_MORE, F.col("r.valuenum"))).alias("o2_flow_additional"),
    )
    named = chartevents.where(F.col("itemid") == OXYGEN_DEVICE)
    named = named.withColumn("nth", F.row_number().over(Window.partitionBy("subject_id", "charttime").orderBy(F.col("value").asc_nulls_first()))).where("nth <= 4")
    devices = named.groupBy("subject_id", "charttime").agg(*[F.max(F.when(F.col("nth") == n, F.col("value"))).alias(f"o2_delivery_device_{n}") for n in range(1, 5)])
    wide = flows.join(devices, ["subject_id", "charttime"], "left")
    return wide.select("subject_id", "stay_id", "charttime", "o2_flow", "o2_flow_additional", *[f"o2_delivery_device_{n}" for n in range(1, 5)])


def first_device(chartevents: DataFrame) -> DataFrame:
    """What ventilation takes of oxygen_delivery, by one aggregation of flows and devices: stay_id, charttime, o2_delivery_device_1."""
    code = F.col("itemid")
    flow = code.isin(OXYGEN_FLOW, OXYGEN_FLOW_OTHER, OXYGEN_FLOW_MORE) & F.col("value").isNotNull()
    more, device, row = code == OXYGEN_FLOW_MORE, code == OXYGEN_DEVICE, F.struct("storetime", "valuenum", "stay_id")
    wide = chartevents.where(code.isin(OXYGEN_FLOW, OXYGEN_FLOW_OTHER, OXYGEN_FLOW_MORE, OXYGEN_DEVICE)).groupBy("subject_id", "charttime").agg(
        F.max(F.when(flow & ~more, row)).alias("flow"), F.max(F.when(flow & more, row)).alias("additional"),
        F.min(F.when(device, F.col("value"))).alias("least"), F.count(F.when(device & F.col("value").isNull(), 1)).alias("unnamed"),
    )
    known = (F.col("unnamed") == 0) & F.col("subject_id").isNotNull() & F.col("charttime").isNotNull()  # devices meet flows of a known patient and time; a null name comes first
    rows = wide.where("flow is not null or additional is not null")
    return rows.select(F.greatest("flow.stay_id", "additional.stay_id").alias("stay_id"), "charttime", F.when(known, F.col("least")).alias("o2_delivery_device_1"))


def ventilation(ventilator_setting: DataFrame, oxygen_delivery: DataFrame) -> DataFrame:
    """Episodes of one kind of breathing support: a change of kind or 14 hours without a row of it begin another; episodes of one time go."""
    device, mode, hamilton = F.col("device"), F.col("ventilator_mode"), F.col("ventilator_mode_hamilton")
    # Only modes and devices that make a kind of support meet: another one says as much as none.
    settings = ventilator_setting.select("stay_id", "charttime", "ventilator_mode", "ventilator_mode_hamilton").where(mode.isin(*INVASIVE_MODES) | hamilton.isin(*INVASIVE_HAMILTON, *NONINVASIVE_HAMILTON))
    devices = oxygen_delivery.select("stay_id", "charttime", F.col("o2_delivery_device_1").alias("device")).where(device.isin(*TRACHEOSTOMY, *TUBE, *MASKS, *HIGH_FLOW, *SUPPLEMENTAL, "None"))
    rows = settings.join(devices, ["stay_id", "charttime"], "full")
    status = ordered_choice([
        (device.isin(*TRACHEOSTOMY), "Tracheostomy"), (device.isin(*TUBE) | mode.isin(*INVASIVE_MODES) | hamilton.isin(*INVASIVE_HAMILTON), "InvasiveVent"),
        (device.isin(*MASKS) | hamilton.isin(*NONINVASIVE_HAMILTON), "NonInvasiveVent"), (device.isin(*HIGH_FLOW), "HFNC"), (device.isin(*SUPPLEMENTAL), "SupplementalOxygen"), (device == "None", "None"),
    ])
    rows = rows.select("stay_id", "charttime", status.alias("status")).where("status is not null and stay_id is not null")
    line, same = Window.partitionBy("stay_id").orderBy("charttime"), Window.partitionBy("stay_id", "status").orderBy("charttime")
    rows = rows.withColumns({"following": F.lead("charttime").over(line), "before": F.lag("status").over(line), "last": F.lag("charttime").over(same)})
    new = F.col("before").isNull() | F.coalesce(seconds_between(F.col("last"), F.col("charttime")) >= 14 * 3600, F.lit(False)) | (F.col("before") != F.col("status"))
    rows = rows.withColumn("episode", F.sum(new.cast("int")).over(line))  # the default frame: rows of one time share
    far = F.col("following").isNull() | (seconds_between(F.col("charttime"), F.col("following")) >= 14 * 3600)
    ends = rows.groupBy("stay_id", "episode").agg(
        F.min("charttime").alias("starttime"), F.max(F.when(far, F.col("charttime")).otherwise(F.col("following"))).alias("endtime"), F.max("status").alias("ventilation_status"), F.max("charttime").alias("latest")
    )
    return ends.where("starttime != latest").select("stay_id", "starttime", "endtime", "ventilation_status")


def _rate(amount: str, hours: str) -> Column:
    return F.round(decimal_text(divide(F.col(amount) / F.col("weight"), F.col(hours))), 4)


def _urine_in_time(urine_output: DataFrame, chartevents: DataFrame, icustays: DataFrame, spans: tuple[tuple[str, int], ...]) -> DataFrame:
    """Rows of urine with the sums of the last hours and the row itself, and the hours that they took; spans: name and hours before the row."""
    beats = chartevents.where(F.col("itemid") == HEART_RATE).select(F.col("stay_id").alias("s"), "charttime")
    near = (F.col("stay_id") == F.col("s")) & (F.col("charttime") > F.col("intime") - F.expr("interval 1 month")) & (F.col("charttime") < F.col("outtime") + F.expr("interval 1 month"))
    first = icustays.join(beats, near).groupBy("stay_id").agg(F.min("charttime").alias("first_beat"))
    line = Window.partitionBy("stay_id").orderBy("charttime")
    rows = urine_output.join(first, "stay_id").withColumn("minutes", seconds_between(F.coalesce(F.lag("charttime").over(line), "first_beat"), F.col("charttime")) / 60)
    for name, hours in spans:
        rows = rolling(rows, "stay_id", "charttime", hours * 3600, {f"urineoutput_{name}": F.sum("urineoutput"), f"tm_{name}": F.sum("minutes")}).withColumn(f"tm_{name}", F.col(f"tm_{name}") / 60)
    return rows


def _hours_taken(name: str) -> Column:
    return F.round(decimal_text(F.col(f"tm_{name}")), 2).alias(f"uo_tm_{name}")


def urine_day(outputevents: DataFrame, chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """What sofa takes of urine_output_rate, without weights, which add no row of another time and take none away."""
    rows = _urine_in_time(measurements.urine_output(outputevents), chartevents, icustays.hint("shuffle_hash"), (("24hr", 23),))
    return rows.select("stay_id", "charttime", "urineoutput_24hr", _hours_taken("24hr"))


def urine_output_rate(urine_output: DataFrame, weights: DataFrame, chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """Urine of the last 5, 11 and 23 hours and the row itself by range frames, over the hours that it took and the weight then (start open, end closed)."""
    rows = _urine_in_time(spread(urine_output, "stay_id"), chartevents, icustays, (("6hr", 5), ("12hr", 11), ("24hr", 23)))
    rows = interval_join(rows, weights.where("weight > 0").select("stay_id", "starttime", "endtime", "weight"), "stay_id", "charttime", "starttime", "endtime", "right")
    spans = ("6hr", "12hr", "24hr")
    return rows.select(
        "stay_id", "charttime", "weight", F.col("urineoutput").alias("uo"), *[f"urineoutput_{s}" for s in spans],
        *[F.when(F.col(f"tm_{s}") >= int(s[:-2]), _rate(f"urineoutput_{s}", f"tm_{s}")).alias(f"uo_mlkghr_{s}") for s in spans], *[_hours_taken(s) for s in spans],
    )


def kdigo_uo(urine_output: DataFrame, weights: DataFrame, icustays: DataFrame) -> DataFrame:
    """Urine and hours of the last 6, 12 and 24 hours, counted in whole seconds since admission; the first row stands for one hour."""
    line = Window.partitionBy("stay_id").orderBy("charttime")
    rows = icustays.select("stay_id", "intime").join(spread(urine_output, "stay_id"), "stay_id").withColumn("second", F.bround(seconds_between(F.col("intime"), F.col("charttime")), 0).cast("long"))
    rows = rows.withColumn("hours", F.coalesce(seconds_between(F.lag("charttime").over(line), F.col("charttime")) / 3600, F.lit(1.0)))
    for n in (6, 12, 24):
        frame = Window.partitionBy("stay_id").orderBy("second").rangeBetween(-n * 3600, 0)
        rows = rows.withColumns({f"urineoutput_{n}hr": F.sum("urineoutput").over(frame), f"uo_tm_{n}hr": F.sum("hours").over(frame)})
    rows = interval_join(rows, weights.select("stay_id", "starttime", "endtime", "weight"), "stay_id", "charttime", "starttime", "endtime", "left")
    enough = {6: (F.col("uo_tm_6hr") >= 6) & (F.col("uo_tm_6hr") < 12), 12: F.col("uo_tm_12hr") >= 12, 24: F.col("uo_tm_24hr") >= 24}
    return rows.select(
        "stay_id", "charttime", "weight", *[f"urineoutput_{n}hr" for n in enough], *[F.when(x, _rate(f"urineoutput_{n}hr", f"uo_tm_{n}hr")).alias(f"uo_rt_{n}hr") for n, x in enough.items()], *[f"uo_tm_{n}hr" for n in enough]
    )


def crrt(chartevents: DataFrame) -> DataFrame:
    """Settings of continuous dialysis by stay and time, and what its state says."""
    code, state = F.col("itemid"), F.col("value")
    numbers = [F.max(F.when(code == c, F.col("valuenum"))).alias(n) for n, c in CRRT_NUMBERS.items()]
    texts = [F.max(F.when(code == c, F.col("value"))).alias(n) for n, c in CRRT_TEXTS.items()]
    states = [F.max(F.when(code == CRRT_STATE, ordered_choice([(state == x, flag) for x, flag in values.items()]))).cast("int").alias(n) for n, values in STATES.items()]
    wanted = [*CRRT_NUMBERS.values(), *CRRT_TEXTS.values(), CRRT_STATE]
    return chartevents.where(code.isin(*wanted) & state.isNotNull()).groupBy("stay_id", "charttime").agg(*texts, *numbers, *states)


def rrt(chartevents: DataFrame, inputevents: DataFrame, procedureevents: DataFrame) -> DataFrame:
    """Dialysis by stay and time: what charts, infusions and procedures say; an infusion or procedure that covers a time overrules the chart."""
    code = F.col("itemid")
    active = code.isin(*DIALYSIS_ACTIVE) | ((code == IN_USE) & (F.col("value") == "In use"))
    kind = F.when(code == CRRT_MODE, F.col("value")).when(code.isin(*PERITONEAL), "Peritoneal").when(code == HEMODIALYSIS, "IHD")
    charted = chartevents.where(code.isin(*DIALYSIS_ACCESS, *DIALYSIS_ACTIVE, *DIALYSIS_NUMBERS, *DIALYSIS_TEXTS) & F.col("value").isNotNull())
    charted = charted.select("stay_id", "charttime", active.cast("int").alias("dialysis_active"), kind.alias("dialysis_type"))
    infused = inputevents.where(code.isin(*DIALYSIS_INPUTS) & (F.col("amount") > 0)).select("stay_id", "starttime", "endtime", F.lit(1).alias("active"), F.lit("CRRT").alias("kind"))
    named = ordered_choice([(code == c, n) for c, n in DIALYSIS_PROCEDURES.items() if n])
    done = procedureevents.where(code.isin(*DIALYSIS_PROCEDURES) & F.col("value").isNotNull()).select("stay_id", "starttime", "endtime", (~code.isin(*IDLE_PROCEDURES)).cast("int").alias("active"), named.alias("kind"))
    ranges = infused.union(done).distinct()
    points = charted.union(ranges.select("stay_id", "starttime", "active", "kind")).distinct()
    joined = binned_interval_join(points, ranges, "stay_id", "charttime", "starttime", "endtime", "both", width=DAY)
    return joined.select("stay_id", "charttime", F.lit(1).alias("dialysis_present"), F.coalesce("active", "dialysis_active").alias("dialysis_active"), F.coalesce("kind", "dialysis_type").alias("dialysis_type"))


def invasive_line(procedureevents: DataFrame, d_items: DataFrame) -> DataFrame:
    """Lines in place, with one name for each type and site."""
    lines = procedureevents.where(F.col("itemid").isin(*LINES)).join(F.broadcast(d_items.where(F.col("itemid").isin(*LINES))), "itemid")
    return lines.select("stay_id", synonyms(F.col("label"), LINE_TYPES).alias("line_type"), synonyms(F.col("location"), LINE_SITES).alias("line_site"), "starttime", "endtime")
