"""Measurement tables: one pivot over laboratory or chart events each, so a table costs one scan with its codes pushed down and one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import decimal_text
from tessera.operators.pivot import AGGREGATES, Item, guarded, guarded_pivot

# Item codes and upper bounds of the laboratory tables.
CHEMISTRY = {
    "albumin": (50862, 10), "globulin": (50930, 10), "total_protein": (50976, 20), "aniongap": (50868, 10000), "bicarbonate": (50882, 10000), "bun": (51006, 300),
    "calcium": (50893, 10000), "chloride": (50902, 10000), "creatinine": (50912, 150), "glucose": (50931, 10000), "sodium": (50983, 200), "potassium": (50971, 30),
}
BLOOD_COUNT = {"hematocrit": 51221, "hemoglobin": 51222, "mch": 51248, "mchc": 51249, "mcv": 51250, "platelet": 51265, "rbc": 51279, "rdw": 51277, "rdwsd": 52159, "wbc": 51301}
COAGULATION = {"d_dimer": 51196, "fibrinogen": 51214, "thrombin": 51297, "inr": 51237, "pt": 51274, "ptt": 51275}
ENZYME = {
    "alt": 50861, "alp": 50863, "ast": 50878, "amylase": 50867, "bilirubin_total": 50885, "bilirubin_direct": 50883, "bilirubin_indirect": 50884, "ck_cpk": 50910, "ck_mb": 50911,
    "ggt": 50927, "ld_ldh": 50954,
}
CARDIAC_MARKER = {"troponin_t": 51003, "ck_mb": 50911, "ntprobnp": 50963}
INFLAMMATION = {"crp": 50889}
RHYTHM = {"heart_rhythm": 220048, "ectopy_type": 224650, "ectopy_frequency": 224651, "ectopy_type_secondary": 226479, "ectopy_frequency_secondary": 226480}
VENTILATOR_NUMBERS = {
    "respiratory_rate_set": (224688,), "respiratory_rate_total": (224690,), "respiratory_rate_spontaneous": (224689,), "minute_volume": (224687,), "tidal_volume_set": (224684,),
    "tidal_volume_observed": (224685,), "tidal_volume_spontaneous": (224686,), "plateau_pressure": (224696,), "peep": (220339, 224700), "fio2": (223835,), "flow_rate": (224691,),
}
VENTILATOR_TEXTS = {"ventilator_mode": 223849, "ventilator_mode_hamilton": 229314, "ventilator_type": 223848}
VITALS = {
    "heart_rate": ((220045,), 300), "sbp": ((220179, 220050, 225309), 400), "dbp": ((220180, 220051, 225310), 300), "mbp": ((220052, 220181, 225312), 300), "sbp_ni": ((220179,), 400),
    "dbp_ni": ((220180,), 300), "mbp_ni": ((220181,), 300), "resp_rate": ((220210, 224690), 70),
}
FAHRENHEIT, CELSIUS, TEMPERATURE_SITE = 223761, 223762, 224642
URINE = (226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489)
IRRIGANT_IN = 227488
PRESSURE_IN_SKULL = (220765, 227989)
HEIGHT_CM, HEIGHT_INCH = 226730, 226707


def _specimens(events: DataFrame, items: list[Item]) -> DataFrame:
    """A row for each specimen with one of the items; the other ids are the largest that its rows carry."""
    wide = guarded_pivot(events.where("valuenum is not null"), ["specimen_id"], "itemid", "valuenum", items, largest=("subject_id", "hadm_id", "charttime"))
    return wide.select("subject_id", "hadm_id", "charttime", "specimen_id", *[i.name for i in items])


def _plain(codes: dict[str, int]) -> list[Item]:
    return [Item(name, (code,)) for name, code in codes.items()]


def chemistry(labevents: DataFrame) -> DataFrame:
    """Values above zero, but for the anion gap."""
    some = labevents.where((F.col("valuenum") > 0) | (F.col("itemid") == CHEMISTRY["aniongap"][0]))
    return _specimens(some, [Item(name, (code,), high=high) for name, (code, high) in CHEMISTRY.items()])


def complete_blood_count(labevents: DataFrame) -> DataFrame:
    return _specimens(labevents.where("valuenum > 0"), _plain(BLOOD_COUNT))


def coagulation(labevents: DataFrame) -> DataFrame:
    return _specimens(labevents, _plain(COAGULATION))


def enzyme(labevents: DataFrame) -> DataFrame:
    return _specimens(labevents.where("valuenum > 0"), _plain(ENZYME))


def cardiac_marker(labevents: DataFrame) -> DataFrame:
    return _specimens(labevents, _plain(CARDIAC_MARKER))


def inflammation(labevents: DataFrame) -> DataFrame:
    return _specimens(labevents.where("valuenum > 0"), _plain(INFLAMMATION))


LAB_TABLES = ("complete_blood_count", "chemistry", "blood_differential", "coagulation", "enzyme")


def laboratory(labevents: DataFrame, key: str, tables: tuple[str, ...] = LAB_TABLES) -> DataFrame:
    """Rows of several laboratory tables in one, from one scan and one shuffle: key, charttime and the columns of the tables, null in those of other tables.

    A specimen is one row where its rows in all of the tables have the same key and time, else one for each table. White cells are those of the blood count.
    """
    code, v = F.col("itemid"), F.col("valuenum")
    known = {"chemistry": (v > 0) | (code == CHEMISTRY["aniongap"][0]), "complete_blood_count": v > 0, "coagulation": v.isNotNull(), "enzyme": v > 0, "blood_differential": v >= 0}
    items = {
        "chemistry": [Item(name, (x,), high=high) for name, (x, high) in CHEMISTRY.items()], "complete_blood_count": _plain(BLOOD_COUNT), "coagulation": _plain(COAGULATION), "enzyme": _plain(ENZYME),
        "blood_differential": _cells(),
    }
    found, columns = labevents.where(v.isNotNull()).withColumn("valuenum", _thousands(code, v)), []
    wanted = {t: known[t] & code.isin(*{x for i in items[t] for x in i.items}) for t in tables}
    for t in tables:
        columns += [F.max(F.when(wanted[t], F.col(c))).alias(f"{t}.{c}") for c in (key, "charttime")]
        columns += [AGGREGATES[i.agg](F.when(wanted[t], guarded(i, code, v))).alias(f"{t}.{i.name}") for i in items[t]]
    wide = found.where(code.isin(*{x for t in tables for i in items[t] for x in i.items})).groupBy("specimen_id").agg(*columns)
    of = {c: [F.col(f"`{t}.{c}`") for t in tables] for c in (key, "charttime")}
    one = F.lit(True)
    for parts in of.values():
        one = one & F.coalesce(F.least(*parts) == F.greatest(*parts), F.lit(True)) if len(parts) > 1 else one
    each = F.array(*[F.lit(i) for i in range(len(tables))])
    rows = wide.withColumn("_of", F.explode(F.when(one, F.array(F.lit(-1))).otherwise(each)))
    place = {c: F.when(F.col("_of") < 0, F.coalesce(*parts)).otherwise(F.element_at(F.array(*parts), F.greatest(F.col("_of"), F.lit(0)) + 1)) for c, parts in of.items()}
    rows = rows.select("*", *[x.alias(c) for c, x in place.items()])
    out = []
    for i, t in enumerate(tables):
        # a row without a key or time in this table meets nothing, so its values count in no other table's row either
        mine = F.col("_of").isin(-1, i) & F.col(f"`{t}.{key}`").isNotNull() & F.col(f"`{t}.charttime`").isNotNull()
        names = [n.name for n in items[t]] if t != "blood_differential" else [*[f"{n}_abs" for n in ABSOLUTE], *PERCENT, *OTHER_CELLS]
        made = {n: F.col(f"`{t}.{n}`") for n in names} | (_counts(f"{t}.") if t == "blood_differential" else {})
        out += [F.when(mine, x).alias(n) for n, x in made.items()]
    return rows.select(key, "charttime", *out).where(F.col(key).isNotNull() & F.col("charttime").isNotNull())


def rhythm(chartevents: DataFrame) -> DataFrame:
    items = [Item(name, (code,), text=True) for name, code in RHYTHM.items()]
    return guarded_pivot(chartevents.where("stay_id is not null"), ["subject_id", "charttime"], "itemid", "valuenum", items, text="value")


def ventilator_setting(chartevents: DataFrame) -> DataFrame:
    """FiO2 as a percentage, from fractions too; PEEP within 0 to 100."""
    code, v = F.col("itemid"), F.col("valuenum")
    oxygen = F.when(v.between(0.2, 1), v * 100).when(v.between(20, 100), v)
    number = F.when(code == 223835, oxygen).when(code.isin(220339, 224700), F.when(v.between(0, 100), v)).otherwise(v)
    items = [Item(n, c) for n, c in VENTILATOR_NUMBERS.items()] + [Item(n, (c,), text=True) for n, c in VENTILATOR_TEXTS.items()]
    events = chartevents.where("value is not null and stay_id is not null").withColumn("valuenum", number)
    wide = guarded_pivot(events, ["subject_id", "charttime"], "itemid", "valuenum", items, text="value", largest=("stay_id",))
    return wide.select("subject_id", "stay_id", "charttime", *[i.name for i in items])


def vitalsign(chartevents: DataFrame) -> DataFrame:
    """Means of plausible values; temperatures in degrees Celsius, to two digits."""
    events = chartevents.where("stay_id is not null").withColumn("valuenum", in_celsius())
    wide = guarded_pivot(events, ["subject_id", "stay_id", "charttime"], "itemid", "valuenum", vital_items(), text="value")
    return wide.withColumn("temperature", F.round(decimal_text(F.col("temperature")), 2))


def mean_pressure(chartevents: DataFrame) -> DataFrame:
    """vitalsign where a mean pressure was charted: mbp by stay and time."""
    return vitalsign(chartevents.where(F.col("itemid").isin(*VITALS["mbp"][0]))).select("subject_id", "stay_id", "charttime", "mbp")


def in_celsius() -> Column:
    """Values of charted items, plausible temperatures in degrees Celsius."""
    code, v = F.col("itemid"), F.col("valuenum")
    return F.when(code == FAHRENHEIT, F.when((v > 70) & (v < 120), (v - 32) / 1.8)).when(code == CELSIUS, F.when((v > 10) & (v < 50), v)).otherwise(v)


def vital_items() -> list[Item]:
    items = [Item(n, c, low=0, high=high, high_in=False, agg="avg") for n, (c, high) in VITALS.items()]
    return items + [
        Item("temperature", (FAHRENHEIT, CELSIUS), agg="avg"), Item("temperature_site", (TEMPERATURE_SITE,), text=True),
        Item("spo2", (220277,), low=0, high=100, agg="avg"), Item("glucose", (225664, 220621, 226537), low=0, agg="avg"),
    ]


def icp(chartevents: DataFrame) -> DataFrame:
    item = Item("icp", PRESSURE_IN_SKULL, low=0, high=100, high_in=False)
    return guarded_pivot(chartevents, ["subject_id", "stay_id", "charttime"], "itemid", "valuenum", [item])


def height(chartevents: DataFrame) -> DataFrame:
    """Heights in centimetres between 120 and 230. Rows in inches count only by what they add to a row in centimetres, whose value wins; alone they have no stay and no time."""
    events = chartevents.where("valuenum is not null")
    cm = events.where(F.col("itemid") == HEIGHT_CM).select("subject_id", "stay_id", "charttime", F.round(decimal_text(F.col("valuenum")), 2).alias("cm"))
    inch = events.where(F.col("itemid") == HEIGHT_INCH).select("subject_id", "charttime", F.round(decimal_text(F.col("valuenum") * 2.54), 2).alias("inch"))
    joined = cm.alias("c").join(inch.alias("i"), (F.col("c.subject_id") == F.col("i.subject_id")) & (F.col("c.charttime") == F.col("i.charttime")), "full")
    return joined.select("c.subject_id", "c.stay_id", "c.charttime", F.coalesce("cm", "inch").alias("height")).where("height > 120 and height < 230")


def urine_output(outputevents: DataFrame) -> DataFrame:
    """Sums by stay and time; what is put in to irrigate counts against the output."""
    signed = F.when((F.col("itemid") == IRRIGANT_IN) & (F.col("value") > 0), -F.col("value")).otherwise(F.col("value"))
    return outputevents.where(F.col("itemid").isin(*URINE)).groupBy("stay_id", "charttime").agg(F.sum(signed).alias("urineoutput"))


# Items of the differential count; absolute counts given per microlitre are scaled to thousands.
WHITE_CELLS = (51300, 51301, 51755)
PER_MICROLITRE = (51199, 52769, 51253, 51218)
ABSOLUTE = {"basophils": (52069,), "eosinophils": (52073, 51199), "lymphocytes": (51133, 52769), "monocytes": (52074, 51253), "neutrophils": (52075,)}
PERCENT = {"basophils": (51146,), "eosinophils": (51200,), "lymphocytes": (51244, 51245), "monocytes": (51254,), "neutrophils": (51256,)}
OTHER_CELLS = {"atypical_lymphocytes": (51143,), "bands": (51144,), "immature_granulocytes": (52135,), "metamyelocytes": (51251,), "nrbc": (51257,)}
GRANULOCYTES = 51218


def blood_differential(labevents: DataFrame) -> DataFrame:
    """Shares and absolute counts of white cells; a missing count follows from its share where the specimen has white cells and shares above zero."""
    v = F.col("valuenum")
    wide = _specimens(labevents.where(v >= 0).withColumn("valuenum", _thousands(F.col("itemid"), v)), _cells())
    return wide.select("subject_id", "hadm_id", "charttime", "specimen_id", "wbc", *[x.alias(n) for n, x in _counts("").items()], *PERCENT, *OTHER_CELLS)


def _thousands(code: Column, value: Column) -> Column:
    return F.when(code.isin(*PER_MICROLITRE), value / 1000.0).otherwise(value)


def _cells() -> list[Item]:
    items = [Item("wbc", WHITE_CELLS)] + [Item(f"{n}_abs", c) for n, c in ABSOLUTE.items()] + [Item(n, c) for n, c in (PERCENT | OTHER_CELLS).items()]
    return [*items, Item("granulocytes_abs", (GRANULOCYTES,)), Item("shares", tuple(x for c in PERCENT.values() for x in c), agg="sum")]


def _counts(prefix: str) -> dict[str, Column]:
    """Absolute counts, given or from shares; prefix: of the columns' names."""
    given = lambda n: F.col(f"`{prefix}{n}`")
    imputable = (given("wbc") > 0) & (given("shares") > 0)
    return {f"{n}_abs": F.round(decimal_text(F.coalesce(given(f"{n}_abs"), F.when(imputable, given(n) * given("wbc") / 100))), 4) for n in ABSOLUTE}
