"""The long format built from clinical source tables: one row for each value of each source row, with what it is and when it was."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.functions.compat import value_kind
from tessera.operators.relational import surrogate_keys
from tessera.quality.metrics import LONG_COLUMNS

# Names whose values are classes, and what the values of each source's columns are.
CLASSES = (
    "gender", "race", "admission_type", "admission_location", "discharge_location", "insurance", "language", "marital_status", "hospital_expire_flag", "eventtype", "careunit", "drg_type", "event_txt", "drug_type",
    "proc_type", "status", "route", "frequency", "infusion_type", "sliding_scale", "priority", "flag", "interpretation", "order_type", "order_subtype", "transaction_type", "order_status", "arrival_transport",
    "disposition", "rhythm", "acuity", "icd_version", "icd_code", "hcpcs_cd", "curr_service", "prev_service", "first_careunit", "last_careunit", "statusdescription", "param_type", "barcode_type",
    "complete_dose_not_given", "will_remainder_be_given", "new_iv_bag_hung", "continued_infusion_in_other_location", "infusion_complete", "non_formulary_visual_verification", "spec_type_desc", "ab_name", "sex",
    "linksto", "category", "fluid", "administration_type", "gsn", "ndc", "etccode",
)


@dataclass(frozen=True)
class Source:
    """A source table. columns: those that become rows, in order; kinds: "Mapping_info_1/Mapping_info_2" -> their columns; date: the column that dates the columns in dated ("*": all)
    ; units: column -> the column that holds its unit."""

    columns: str
    kinds: Mapping[str, str] = field(default_factory=dict)
    date: str | None = None
    dated: str = ""
    units: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Events:
    """A table of items. Its first row for each source row is the value itself, named by the item's label; kind: its Mapping_info_2; classes: text values are classes; others: further columns as in Source."""

    kind: str
    others: Source
    classes: bool = False
    labels: str = "d_items"


VITALS = "temperature heartrate resprate o2sat sbp dbp"
WIDE: dict[str, Source] = {
    "admissions": Source(
        "admittime dischtime deathtime admission_type admission_location discharge_location insurance language marital_status race edregtime edouttime hospital_expire_flag",
        {"date": "admittime dischtime deathtime edregtime edouttime", "event/chart_event": "admission_type admission_location discharge_location insurance language marital_status race hospital_expire_flag"},
    ),
    "patients": Source("gender anchor_age anchor_year anchor_year_group dod", {"date": "dod"}),
    "transfers": Source("eventtype careunit intime outtime", {"date": "intime outtime"}),
    "omr": Source("seq_num result_name result_value", {"event/chart_event": "result_value"}, "chartdate", "result_name result_value"),
    "drgcodes": Source("drg_type drg_code description drg_severity drg_mortality", {"medical_code": "drg_code"}),
    "prescriptions": Source(
        "poe_seq starttime stoptime drug_type drug formulary_drug_cd gsn ndc prod_strength form_rx dose_val_rx form_val_disp doses_per_24_hrs route",
        {
            "date": "starttime stoptime", "prescription/drug": "drug", "medical_code": "formulary_drug_cd gsn ndc",
            "prescription/prescription_info": "prod_strength form_rx dose_val_rx form_val_disp doses_per_24_hrs route",
        },
        "starttime", "drug_type drug formulary_drug_cd gsn ndc", {"dose_val_rx": "dose_unit_rx", "form_val_disp": "form_unit_disp"},
    ),
    "microbiologyevents": Source(
        "spec_type_desc test_seq storedate storetime test_name org_name isolate_num quantity ab_name dilution_text dilution_comparison dilution_value interpretation comments",
        {"date": "storedate storetime", "event/lab_event": "test_name org_name quantity ab_name interpretation"}, "charttime", "*",
    ),
    "services": Source("transfertime prev_service curr_service", {"date": "transfertime"}),
    "icustays": Source("first_careunit last_careunit intime outtime los", {"date": "intime outtime"}),
    "diagnoses_icd": Source("seq_num icd_code icd_version", {"medical_code": "icd_code"}),
    "procedures_icd": Source("seq_num icd_code icd_version", {"medical_code": "icd_code"}, "chartdate", "icd_code"),
    "edstays": Source("intime outtime gender race arrival_transport disposition", {"date": "intime outtime"}),
    "diagnosis": Source("seq_num icd_code icd_version icd_title", {"medical_code": "icd_code", "diagnosis": "icd_title"}),
    "medrecon": Source("name gsn ndc etc_rn etccode etcdescription", {"prescription/drug": "name", "medical_code": "gsn ndc etccode"}, "charttime", "name gsn ndc"),
    "pyxis": Source("med_rn name gsn_rn gsn", {"prescription/drug": "name", "medical_code": "gsn"}, "charttime", "med_rn name gsn"),
    "triage": Source(f"{VITALS} pain acuity chiefcomplaint", {"event/chart_event": f"{VITALS} pain acuity", "diagnosis": "chiefcomplaint"}),
    "vitalsign": Source(f"{VITALS} rhythm pain", {"event/chart_event": f"{VITALS} rhythm pain"}, "charttime", "*"),
}
NUMBER, STORED = "valuenum", "storetime"
EVENTS: dict[str, Events] = {
    "labevents": Events(
        "lab_event", Source("storetime valuenum ref_range_lower ref_range_upper flag priority comments", {"date": STORED, "event/lab_event": NUMBER}, "charttime", "valuenum flag priority",
        {"valuenum": "valueuom", "ref_range_lower": "valueuom", "ref_range_upper": "valueuom"}), labels="d_labitems",
    ),
    "chartevents": Events("chart_event", Source("storetime valuenum warning", {"date": STORED, "event/chart_event": NUMBER}, "charttime", "valuenum warning", {"valuenum": "valueuom"}), classes=True),
    "datetimeevents": Events("chart_event", Source("storetime warning", {"date": STORED}, "charttime", "warning")),
    "outputevents": Events("chart_event", Source("storetime", {"date": STORED}, "charttime")),
}
#: Columns of events whose values are classes, beside CLASSES.
EVENT_CLASSES = ("warning", "flag", "priority")
# Kinds of notes and what they stand for.
NOTE_KINDS = {"discharge": {"DS": "note_clinical"}, "radiology": {"RR": "note_rad", "AR": "note_rad"}}
CLINICAL_NOTES = {"DS": "DIS", "AD": "ADM", "PN": "ADM", "SU": "SUR", "EC": "EME"}


def _text(df: DataFrame, name: str | None) -> Column:
    """A column as text; null where the table has none of that name."""
    if not name or name not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema[name].dataType.typeName()
    if kind.startswith("timestamp"):
        return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
    return F.col(name).cast("string")


def _kind(df: DataFrame, name: str, value: Column) -> Column:
    """value_kind of a column's text, by its type where that decides."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        return F.when(F.col(name).isNull(), "").otherwise("numeric")
    if kind.typeName().startswith("timestamp"):
        return F.when(F.col(name).isNull(), "").when(value.rlike(r"^\d{4}-"), "timestamp").otherwise(value_kind(value))
    return value_kind(value)


def _entry(name: Column, value: Column, kind: Column, classes: Column, date: Column, unit: Column, first: str | Column | None, second: str | Column | None, item: Column | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        name.alias("Variable_name"), value.alias("Value"), kind.alias("Variable_type"), classes.alias("Is_categorical"), date.alias("Event_date"), unit.alias("Unit"),
        text(first).alias("Mapping_info_1"), text(second).alias("Mapping_info_2"), F.coalesce(item if item is not None else F.lit(""), F.lit("")).alias("Variable_ID"),
    )


def _entries(df: DataFrame, source: Source, classes: tuple[str, ...] = CLASSES, variables: Collection[str] | None = None) -> list[Column]:
    """An entry for each column that the table has, or of those asked for; a null is a blank value."""
    kinds = {c: kind for kind, names in source.kinds.items() for c in names.split()}
    date = F.coalesce(_text(df, source.date), _text(df, "chartdate")) if source.date == "charttime" else _text(df, source.date)
    out = []
    for c in source.columns.split():
        if c in df.columns and (variables is None or c in variables):
            value = F.coalesce(_text(df, c), F.lit(""))
            first, _, second = kinds.get(c, "").partition("/")
            dated = source.dated == "*" or c in source.dated.split()
            out.append(_entry(F.lit(c), value, _kind(df, c, value), F.lit("1" if c in classes else "0"), date if dated else F.lit(None).cast("string"), _text(df, source.units.get(c)), first or None, second or None))
    return out


def _laid_out(df: DataFrame, table: str, entries: list[Column], order: list[str], keyed: bool = True) -> DataFrame:
    """Rows numbered from 0 in the order of patient and all other columns, and their entries as rows of the long format: one pass after the numbering. Without keys no row is moved."""
    keyed = surrogate_keys(df, order, "Primary_key").withColumn("Primary_key", F.col("Primary_key") - 1) if keyed else df.withColumn("Primary_key", F.lit(None).cast("long"))
    rows = keyed.select("Primary_key", _text(df, "subject_id").alias("Patient_id"), _text(df, "hadm_id").alias("Admission_id"), F.explode(F.array(*entries)).alias("e")).select("Primary_key", "Patient_id", "Admission_id", "e.*")
    rows = rows.withColumns({"Original_table_name": F.lit(table.upper()), **{c: F.lit("") for c in ("Recorder", "Recorder_position", "Recorder_affiliation", "Ground_truth")}})
    return rows.select(*LONG_COLUMNS)


def _ordered(df: DataFrame) -> list[str]:
    first = [c for c in ("subject_id", "hadm_id", "charttime", "seq_num", "note_seq") if c in df.columns]
    return [*first, *[c for c in df.columns if c not in first]]


def wide_rows(df: DataFrame, table: str, keyed: bool = True, variables: Collection[str] | None = None) -> DataFrame:
    return _laid_out(df, table, _entries(df, WIDE[table], CLASSES, variables), _ordered(df), keyed)


def event_rows(df: DataFrame, table: str, labels: DataFrame | None = None, keyed: bool = True) -> DataFrame:
    """The value of each event under its item's label (with the fluid, where there is one; the item's code without a label), then its further columns. labels: itemid, label, perhaps fluid; a
    dictionary, so Spark broadcasts it while it is small."""
    events, order = EVENTS[table], _ordered(df)
    df = df.withColumn("_label", F.lit(None).cast("string"))
    if labels is not None:
        named = F.concat_ws("_", "label", "fluid") if "fluid" in labels.columns else F.col("label")
        df = df.drop("_label").join(labels.groupBy("itemid").agg(F.min(F.when(F.col("label").isNotNull(), named)).alias("_label")), "itemid", "left")
    number = F.col("valuenum") if "valuenum" in df.columns else F.lit(None).cast("double")
    value = F.coalesce(number.cast("string"), _text(df, "value"))
    kind = F.when(number.isNotNull(), "numeric").otherwise(value_kind(value))
    classes = F.when(number.isNull() & _text(df, "value").isNotNull(), "1").otherwise("0") if events.classes else F.lit("0")
    item = F.col("itemid").cast("string")
    main = _entry(F.coalesce("_label", item), value, kind, classes, _text(df, events.others.date), _text(df, "valueuom"), "event", events.kind, item)
    return _laid_out(df, table, [main, *_entries(df, events.others, EVENT_CLASSES)], order, keyed)


def note_rows(df: DataFrame, table: str, subtype: Column | None = None, keyed: bool = True) -> DataFrame:
    """Text, time of storage, type and number of each note; subtype: the class of a radiology report, by default none."""
    kinds, text, note = NOTE_KINDS[table], F.coalesce(_text(df, "text"), F.lit("")), F.col("note_type")
    choose = lambda mapping: F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), note)
    second = choose(CLINICAL_NOTES) if table == "discharge" else subtype if subtype is not None else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    main = _entry(F.lit("text"), text, F.lit("string"), F.lit("0"), _text(df, "charttime"), none, choose(kinds), second)
    number = _entry(F.lit("note_seq"), _text(df, "note_seq"), F.lit("numeric"), F.lit("0"), none, none, None, None)
    label = _entry(F.lit("note_type"), _text(df, "note_type"), F.lit("string"), F.lit("1"), none, none, None, None)
    return _laid_out(df, table, [main, *_entries(df, Source(STORED, {"date": STORED})), label, number], _ordered(df), keyed)


def build_long(tables: Mapping[str, DataFrame], radiology: Column | None = None, keyed: bool = True, variables: Collection[str] | None = None) -> DataFrame:
    """The long format of all given tables that it has rules for; dictionaries (d_items, d_labitems) give names to items. Columns that a table lacks give no rows.

    keyed: whether rows get their number, for which each table is sorted; it is null where nobody asks for it. variables: the columns of wide tables that are asked for, by default all."""
    out = None
    for name, df in tables.items():
        if name in WIDE:
            rows = wide_rows(df, name, keyed, variables)
        elif name in EVENTS:
            rows = event_rows(df, name, tables.get(EVENTS[name].labels), keyed)
        elif name in NOTE_KINDS:
            rows = note_rows(df, name, radiology, keyed)
        else:
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("none of the tables has rules")
    return out
