"""Base tables of the clinical schemas, bound to the given tables: a row of each is a row of orders or lineitem, or one of its time slots.

Admissions are orders, patients are customers, stays are orders of the first or last priority that are in progress; the lines of an
order give the events of its stay. Values, items and times are whole-number arithmetic over keys, so they are the same in every engine
and grow with the given tables. The texts below are valid for Spark and for the SQL twins but for the slots of an event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import spread
from tessera.session import materialize

# (item, low, high, steps of a unit, text). Several rows of an item make it, or its texts, more frequent.
CHART = [
    *[(220045, 40, 170, 1, None)] * 4, *[(220050, 60, 200, 1, None)] * 2, (220051, 20, 120, 1, None), *[(220052, 40, 150, 1, None)] * 3, (220181, 35, 140, 1, None), *[(220210, 4, 50, 1, None)] * 2,
    *[(223761, 91, 106, 10, None)] * 2, (223762, 32, 41, 10, None), (224642, 0, 0, 1, "Oral"), *[(220277, 80, 100, 1, None)] * 2, (225664, 30, 420, 1, None), *[(223900, 1, 5, 1, None)] * 2,
    (223900, 1, 1, 1, "No Response-ETT"), *[(223901, 1, 6, 1, None)] * 3, *[(220739, 1, 4, 1, None)] * 3, (226512, 40, 130, 1, None), *[(224639, 40, 130, 1, None)] * 2, (226730, 110, 235, 1, None),
    (226707, 50, 80, 1, None), *[(223835, 15, 100, 1, None)] * 2, (223835, 0, 1, 100, None), (220339, 0, 25, 1, None), (224684, 300, 600, 1, None), (224690, 5, 40, 1, None),
    *[(223849, 0, 0, 1, x) for x in ("CMV/ASSIST", "CPAP/PSV", "Standby")], *[(229314, 0, 0, 1, x) for x in ("NIV", "APRV")], (223848, 0, 0, 1, "Drager"), *[(223834, 1, 15, 1, None)] * 3,
    (227582, 1, 60, 1, None), (227287, 1, 15, 1, None), *[(226732, 0, 0, 1, x) for x in ("Nasal cannula", "Endotracheal tube", "High flow nasal cannula", "None", "Bipap mask ", "Trach mask ", "Face tent", "CPAP mask ")],
    (220048, 0, 0, 1, "SR (Sinus Rhythm)"), (224650, 0, 0, 1, "PVCs"), (220765, -5, 60, 1, None), *[(227290, 0, 0, 1, x) for x in ("CVVH", "CVVHDF")], (224144, 50, 250, 1, None),
    *[(224146, 0, 0, 1, x) for x in ("Active", "Clots Present", "Clotted", "Recirculating")], (224191, 0, 400, 1, None), (226499, 0, 4000, 1, None), (225965, 0, 0, 1, "In use"),
]
LABS = [
    (50862, 1, 6, 10, None), (50868, -5, 35, 1, None), (50882, 5, 45, 1, None), *[(51006, 4, 150, 1, None)] * 2, (50893, 6, 12, 10, None), (50902, 80, 125, 1, None), *[(50912, 0, 9, 10, None)] * 4,
    (50931, 30, 500, 1, None), *[(50983, 110, 210, 1, None)] * 2, (50971, 2, 8, 10, None), (51221, 15, 60, 1, None), (51222, 5, 18, 10, None), *[(51265, 5, 500, 1, None)] * 2,
    *[(51301, 0, 45, 10, None)] * 2, (51279, 2, 6, 10, None), *[(51237, 0, 7, 10, None)] * 2, (51274, 9, 60, 10, None), (51275, 20, 120, 10, None), (51214, 50, 700, 1, None), (50861, 5, 900, 1, None),
    (50878, 5, 900, 1, None), *[(50885, 0, 25, 10, None)] * 3, (50910, 5, 3000, 1, None), (50954, 80, 900, 1, None), (51003, 0, 5, 100, None), (50911, 0, 90, 1, None), (50889, 0, 300, 10, None),
    (51146, 0, 3, 10, None), (51200, 0, 8, 10, None), (51244, 5, 60, 10, None), (51254, 1, 15, 10, None), (51256, 20, 95, 10, None), (51144, 0, 20, 1, None), (52075, 0, 30, 10, None),
    *[(52033, 0, 0, 1, x) for x in ("ART.", "ART.", "ART.", "VEN.")], *[(50821, 30, 300, 1, None)] * 5, *[(50818, 15, 90, 1, None)] * 4, *[(50820, 7, 8, 100, None)] * 3, *[(50816, 15, 110, 1, None)] * 2,
    (50816, 0, 1, 100, None), *[(50813, 0, 15, 10, None)] * 2, (50817, 60, 105, 1, None), (50802, -15, 15, 1, None), (50804, 10, 50, 1, None), (50809, 30, 500, 1, None), (50810, 15, 110, 1, None),
    (50808, 0, 2, 100, None), (50822, 2, 7, 10, None), (50824, 120, 160, 1, None), (50801, 0, 600, 1, None),
]
INPUTS = [
    (221906, "mcg/kg/min"), (221906, "mg/kg/min"), (221289, "mcg/kg/min"), (221662, "mcg/kg/min"), (221653, "mcg/kg/min"), (222315, "units/hour"), (222315, "units/min"), (221749, "mcg/kg/min"),
    (221749, "mcg/min"), (221986, "mcg/kg/min"), (222062, "mg/hour"), (221555, "mg/kg/hour"), (227536, "mL/hour"), (227525, "mL/hour"),
]
OUTPUTS = [226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489, 226559, 226559, 226633]
PROCEDURES = [
    (225441, "Hemodialysis", None), (225802, "Dialysis - CRRT", None), (225803, "Dialysis - CVVHD", None), (225805, "Peritoneal Dialysis", None), (224270, "Dialysis Catheter", "Right Femoral."),
    (225752, "Arterial Line", "Left Radial"), (225752, "Arterial Line", "Left Brachial."), (224269, "CCO PAC", "RIJ"), (224263, "Multi Lumen", "Right Antecub"), (225202, "Indwelling Port (PortaCath)", None),
    (225436, "CRRT Filter Change", None), (225792, "Invasive Ventilation", None),
]
CODES = [
    ("41071", 9), ("4280", 9), ("39891", 9), ("4439", 9), ("4359", 9), ("2901", 9), ("496", 9), ("7140", 9), ("5319", 9), ("5715", 9), ("07054", 9), ("25000", 9), ("25040", 9), ("3420", 9), ("5859", 9),
    ("1749", 9), ("4560", 9), ("1985", 9), ("042", 9), ("4019", 9), ("I214", 10), ("I509", 10), ("I739", 10), ("G459", 10), ("F019", 10), ("J449", 10), ("M069", 10), ("K259", 10), ("K7460", 10), ("K7030", 10),
    ("E119", 10), ("E1122", 10), ("G8190", 10), ("N189", 10), ("C349", 10), ("C9100", 10), ("I8500", 10), ("C787", 10), ("B20", 10), ("I10", 10), ("F0390", 10), ("R4182", 10), ("E860", 10), ("27651", 9),
]
DRUGS = [
    ("Vancomycin", "IV", "MAIN"), ("CeftriaXONE", "IV", "MAIN"), ("Piperacillin-Tazobactam", "IV", "MAIN"), ("Ciprofloxacin 0.3% Ophth Soln", "OU", "MAIN"), ("Gentamicin Cream", "IV", "MAIN"),
    ("Metronidazole Gel", "VG", "MAIN"), ("Lisinopril", "PO", "MAIN"), ("Captopril", "PO", "MAIN"), ("Ibuprofen", "PO", "MAIN"), ("Aspirin EC", "PO", "MAIN"), ("Ketorolac", "IV", "MAIN"), ("Vancomycin", "IV", "BASE"),
    ("Erythromycin", "LEFT EYE", "MAIN"), ("0.9% Sodium Chloride", "IV", "BASE"), ("Meropenem", None, "MAIN"), ("Heparin", "SC", "MAIN"),
]
CULTURES = [("BLOOD CULTURE", 80002, "ESCHERICHIA COLI"), ("URINE", None, None), ("SPUTUM", 80023, "STAPH AUREUS COAG +"), ("BLOOD CULTURE", 90856, "CANCELLED"), ("MRSA SCREEN", None, None), ("STOOL", 80004, "")]
SERVICES = ["MED", "CSURG", "ORTHO", "NSURG", "CMED", "TRAUM"]


def _values(rows: list, columns: str) -> str:
    def text(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    listed = [x if isinstance(x, tuple) else (x,) for x in rows]
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(text, x))})" for i, x in enumerate(listed)) + f") AS v(i, {columns})"


def base_sql(slots: str, line: str = "lineitem JOIN icustays ON l_orderkey = hadm_id") -> dict[str, str]:
    """The text of each base table. slots: a template with {n} that follows a table in FROM and gives a column k from 0 to n - 1. line: the lines of orders that are stays, with their stay."""
    hour, minute = "INTERVAL '1' HOUR", "INTERVAL '1' MINUTE"
    number = "CAST(floor((v.low + (v.high - v.low) * (CAST((l_partkey * 7919 + e.k * 541 + l_linenumber * 31) % 1001 AS DOUBLE) / 1000)) * v.steps) AS DOUBLE) / v.steps"

    def events(table: str, n: int, items: list, name: str) -> str:
        return f"""(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k, subject_id, hadm_id, stay_id, intime, (l_partkey + l_linenumber * 13 + k * 7) % {len(items)} AS pick
  FROM {line} {slots.format(n=n)}) e JOIN {_values(items, name)} ON e.pick = v.i"""

    return {
        "patients": """SELECT c_custkey AS subject_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, CAST(14 + c_custkey % 80 AS INTEGER) AS anchor_age, CAST(1994 + c_custkey % 3 AS INTEGER) AS anchor_year,
  CAST(NULL AS DATE) AS dod FROM customer""",
        "admissions": f"""SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate + (o_orderkey % 1440) * {minute} AS admittime, o_orderdate + (o_orderkey % 1440 + 2880 + o_custkey % 9000) * {minute} AS dischtime,
  CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + (o_orderkey % 1440 + 2880) * {minute} END AS deathtime, CASE o_orderpriority WHEN '5-LOW' THEN 'ELECTIVE' WHEN '1-URGENT' THEN 'URGENT' ELSE 'EW EMER.' END AS admission_type,
  CASE WHEN o_orderkey % 9 = 0 THEN 'DEAD/EXPIRED' ELSE 'HOME' END AS discharge_location, 'UNKNOWN' AS race, CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS INTEGER) AS hospital_expire_flag, o_orderpriority AS priority, o_orderstatus AS status
  FROM orders""",
        "icustays": f"""SELECT subject_id, hadm_id, hadm_id * 10 + 1 AS stay_id, admittime + (hadm_id % 311 * 7) * {minute} AS intime, admittime + (hadm_id % 311 * 7 + 1200 + subject_id * 7 % 2400) * {minute} AS outtime
  FROM admissions WHERE status = 'P' AND priority IN ('1-URGENT', '5-LOW')""",
        "chartevents": f"""SELECT subject_id, hadm_id, stay_id, intime + ((l_linenumber * 5 + k * 3 + l_partkey % 4) - 9) * {hour} AS charttime, intime + ((l_linenumber * 5 + k * 3 + l_partkey % 4) * 60 - 540 + (l_suppkey * 7 + k) % 50) * {minute} AS storetime,
  CAST(v.itemid AS BIGINT) AS itemid, CASE WHEN v.words IS NULL THEN CAST(CAST(floor({number} * 100 + 0.5) AS BIGINT) AS VARCHAR(30)) ELSE v.words END AS value, CASE WHEN v.words IS NULL OR v.low > 0 THEN {number} END AS valuenum
  FROM {events("chart", 28, CHART, "itemid, low, high, steps, words")}""",
        "labevents": f"""SELECT subject_id, hadm_id, l_orderkey * 8 + (k + l_linenumber) % 7 AS specimen_id, intime + (((k + l_linenumber) % 7) * 7 - 9) * {hour} AS charttime, intime + (((k + l_linenumber) % 7) * 7 - 8) * {hour} AS storetime,
  CAST(v.itemid AS BIGINT) AS itemid, CASE WHEN v.words IS NULL THEN CAST(CAST(floor({number} * 100 + 0.5) AS BIGINT) AS VARCHAR(30)) ELSE v.words END AS value, CASE WHEN v.words IS NULL THEN {number} END AS valuenum
  FROM {events("lab", 30, LABS, "itemid, low, high, steps, words")}""",
        "inputevents": f"""SELECT subject_id, hadm_id, stay_id, intime + (l_linenumber * 4 + k * 5 - 6) * {hour} AS starttime, intime + ((l_linenumber * 4 + k * 5 - 6) * 60 + 35 + l_suppkey * 11 % 400) * {minute} AS endtime, CAST(v.itemid AS BIGINT) AS itemid,
  CAST(l_partkey % 50 AS DOUBLE) AS amount, CAST(l_suppkey * 3 % 40 AS DOUBLE) / 100 AS rate, v.unit AS rateuom, l_orderkey * 100 + l_linenumber AS orderid, l_orderkey * 100 + k AS linkorderid, CAST(CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 50 + l_partkey % 60 END AS DOUBLE) AS patientweight
  FROM {events("input", 3, INPUTS, "itemid, unit")}""",
        "outputevents": f"""SELECT subject_id, hadm_id, stay_id, intime + ((l_linenumber * 7 + k * 4 + l_partkey % 3) * 60 - 120 + l_suppkey % 2 * 30) * {minute} AS charttime, CAST(v.itemid AS BIGINT) AS itemid, CAST((l_partkey * 37 + k * 11) % 400 AS DOUBLE) AS value
  FROM {events("output", 12, OUTPUTS, "itemid")}""",
        "procedureevents": f"""SELECT subject_id, hadm_id, stay_id, intime + (l_linenumber * 3 + k * 9 - 4) * {hour} AS starttime, intime + (l_linenumber * 3 + k * 9 + l_suppkey % 6) * {hour} AS endtime, CAST(v.itemid AS BIGINT) AS itemid,
  CASE WHEN l_partkey % 17 <> 0 THEN CAST(l_suppkey % 300 AS DOUBLE) END AS value, v.place AS location
  FROM {events("procedure", 1, PROCEDURES, "itemid, label, place")}""",
        "d_items": f"SELECT DISTINCT CAST(v.itemid AS BIGINT) AS itemid, v.label FROM {_values(PROCEDURES, 'itemid, label, place')}",
        "diagnoses_icd": f"""SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, CAST(l_linenumber AS INTEGER) AS seq_num, v.code AS icd_code, CAST(v.version AS INTEGER) AS icd_version
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN {_values(CODES, "code, version")} ON (l_partkey * 7 + l_suppkey) % {len(CODES)} = v.i""",
        "prescriptions": f"""SELECT subject_id, hadm_id, intime + (l_linenumber * 9 + k * 17 - 20) * {hour} AS starttime, intime + (l_linenumber * 9 + k * 17 + 4 + l_suppkey % 50) * {hour} AS stoptime, v.kind AS drug_type, v.drug AS drug, v.way AS route
  FROM {events("drug", 2, DRUGS, "drug, way, kind")}""",
        "microbiologyevents": f"""SELECT subject_id, hadm_id, l_orderkey * 10 + l_linenumber AS micro_specimen_id, CAST(intime + (l_linenumber * 11 + k - 30) * {hour} AS DATE) AS chartdate,
  CASE WHEN l_orderkey % 4 <> 0 THEN intime + (l_linenumber * 11 + k - 30) * {hour} END AS charttime, v.spec AS spec_type_desc, CAST(v.org AS BIGINT) AS org_itemid, v.name AS org_name
  FROM {events("culture", 2, CULTURES, "spec, org, name")}""",
        "services": f"""SELECT subject_id, hadm_id, admittime + (hadm_id % 50) * {hour} AS transfertime, v.service AS curr_service FROM admissions JOIN {_values(SERVICES, "service")} ON (subject_id + hadm_id) % {len(SERVICES)} = v.i""",
    }


#: Base tables whose rows are time slots of a line of a stay. In Spark they are views of staylines, the join that the twins write out in each of them: it shuffles lineitem once, and a slot costs less to count again than to store.
EVENTS = ("chartevents", "labevents", "inputevents", "outputevents", "procedureevents", "prescriptions", "microbiologyevents")
#: What a base table is made of.
SOURCES = {
    "patients": ("customer",), "admissions": ("orders",), "icustays": ("admissions",), "d_items": (), "diagnoses_icd": ("lineitem", "orders"), "services": ("admissions",),
    "staylines": ("lineitem", "icustays"), **{x: ("staylines",) for x in EVENTS},
}
#: The same for the twins, which know no staylines.
TWIN_SOURCES = {name: ("lineitem", "icustays") if name in EVENTS else sources for name, sources in SOURCES.items() if name != "staylines"}
SPARK_SLOTS = "LATERAL VIEW explode(sequence(0, {n} - 1)) slots AS k"
TWIN_SLOTS = ", (SELECT unnest(range(0, {n})) AS k) slots"


def base_table(spark: SparkSession, name: str, inputs: list[DataFrame]) -> DataFrame:
    """A base table over its SOURCES."""
    if name == "staylines":
        lines, stays = inputs
        return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(stays.select("subject_id", "hadm_id", "stay_id", "intime"), F.col("l_orderkey") == F.col("hadm_id"))
    if name == "diagnoses_icd":
        inputs = [spread(inputs[0], "l_orderkey"), inputs[1]]  # flags of an admission are counted in the partition of this join
    text = base_sql(SPARK_SLOTS, "staylines")[name]
    views = [f"_tessera_{name}_{source}" for source in SOURCES[name]]
    for source, view, frame in zip(SOURCES[name], views, inputs, strict=True):
        frame.createOrReplaceTempView(view)
        text = " ".join(view if word == source else word for word in text.split(" "))
    table = spark.sql(text)
    for view in views:
        spark.catalog.dropTempView(view)
    return table


def base_tables(spark: SparkSession, names: Iterable[str], read: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The named base tables and those that they are made of; read gives the given tables. Lines of stays are written once where several tables are made of them."""
    names = list(names)
    several = sum(x in EVENTS for x in names) > 1
    tables: dict[str, DataFrame] = {}

    def visit(name: str) -> DataFrame:
        if name not in tables:
            made = base_table(spark, name, [visit(x) if x in SOURCES else read(x) for x in SOURCES[name]])
            tables[name] = materialize(made, name) if name == "staylines" and several else made
        return tables[name]

    for name in names:
        visit(name)
    return tables
