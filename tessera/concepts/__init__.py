"""Derived tables by name: each is a function of base tables and of other derived tables, and is built once, in the order of what it takes."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame

from tessera.concepts import bedside, comorbidity, elixhauser, firstday, infection, infusions, measurements, prescriptions, scores, severity, stays, windows

LAB, CHART, INPUT, STAYS = "labevents", "chartevents", "inputevents", "icustays"

#: category -> name -> (function, the tables that it takes)
CATEGORIES: dict[str, dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]]] = {
    "demographics": {
        "icustay_times": (stays.icustay_times, (CHART, STAYS)), "icustay_hourly": (stays.icustay_hourly, ("icustay_times",)), "age": (stays.age, ("admissions", "patients")),
        "weight_durations": (bedside.weight_durations, (CHART, STAYS)), "icustay_detail": (comorbidity.icustay_detail, (STAYS, "admissions", "patients")),
    },
    "measurement": {
        **{f.__name__: (f, (LAB,)) for f in (
            measurements.chemistry, measurements.complete_blood_count, measurements.coagulation, measurements.enzyme, measurements.cardiac_marker, measurements.inflammation, measurements.blood_differential,
        )},
        **{f.__name__: (f, (CHART,)) for f in (measurements.rhythm, measurements.ventilator_setting, measurements.vitalsign, measurements.icp, measurements.height, bedside.gcs, bedside.oxygen_delivery)},
        "bg": (bedside.bg, (LAB, CHART)), "urine_output": (measurements.urine_output, ("outputevents",)),
        "urine_output_rate": (bedside.urine_output_rate, ("urine_output", "weight_durations", CHART, STAYS)),
        "creatinine_baseline": (comorbidity.creatinine_baseline, ("age", "chemistry", "diagnoses_icd", "patients")),
    },
    "comorbidity": {"charlson": (comorbidity.charlson, ("admissions", "diagnoses_icd", "age"))},
    "medication": {
        **{agent: (partial(infusions.infusion, agent=agent), (INPUT,)) for agent in infusions.AGENTS},
        **{f.__name__: (f, (INPUT,)) for f in (infusions.neuroblock, infusions.vasoactive_agent)},
        **{f.__name__: (f, ("prescriptions",)) for f in (prescriptions.acei, prescriptions.nsaid)},
        "antibiotic": (infection.antibiotic, ("prescriptions", STAYS)),
        "norepinephrine_equivalent_dose": (infusions.norepinephrine_equivalent_dose, ("vasoactive_agent",)),
    },
    "treatment": {
        "crrt": (bedside.crrt, (CHART,)), "rrt": (bedside.rrt, (CHART, INPUT, "procedureevents")), "invasive_line": (bedside.invasive_line, ("procedureevents", "d_items")),
        "ventilation": (bedside.ventilation, ("ventilator_setting", "oxygen_delivery")),
    },
    "firstday": {
        "first_day_vitalsign": (stays.first_day_vitalsign, (STAYS, "vitalsign")), "first_day_urine_output": (stays.first_day_urine_output, (STAYS, "urine_output")),
        "first_day_height": (stays.first_day_height, (STAYS, "height")), "first_day_bg": (firstday.first_day_bg, ("bg", STAYS)), "first_day_bg_art": (firstday.first_day_bg_art, ("bg", STAYS)),
        "first_day_gcs": (firstday.first_day_gcs, ("gcs", STAYS)), "first_day_lab": (firstday.first_day_lab, (*firstday.LABS, STAYS)), "first_day_rrt": (firstday.first_day_rrt, ("rrt", STAYS)),
        "first_day_weight": (firstday.first_day_weight, ("weight_durations", STAYS)),
        "first_day_sofa": (scores.first_day_sofa, (STAYS, "bg", "ventilation", "first_day_vitalsign", "first_day_lab", "first_day_urine_output", "first_day_gcs", *scores.PRESSORS)),
    },
    "organfailure": {
        "kdigo_creatinine": (stays.kdigo_creatinine, (LAB, STAYS)), "kdigo_uo": (bedside.kdigo_uo, ("urine_output", "weight_durations", STAYS)),
        "kdigo_stages": (scores.kdigo_stages, (STAYS, "kdigo_creatinine", "kdigo_uo", "crrt")), "meld": (scores.meld, (STAYS, "first_day_lab", "first_day_rrt")),
    },
    "score": {
        "sofa": (scores.sofa, (STAYS, "icustay_hourly", "bg", "ventilation", "vitalsign", "gcs", "enzyme", "chemistry", "complete_blood_count", "urine_output_rate", *scores.PRESSORS)),
        "sirs": (scores.sirs, (STAYS, "first_day_bg_art", "first_day_vitalsign", "first_day_lab")),
        "lods": (severity.lods, (STAYS, CHART, "bg", "ventilation", "first_day_gcs", "first_day_vitalsign", "first_day_lab", "first_day_urine_output")),
        "sapsii": (severity.sapsii, (
            STAYS, "admissions", "age", "services", "diagnoses_icd", CHART, "bg", "ventilation", "gcs", "vitalsign", "urine_output", "chemistry", "complete_blood_count", "enzyme",
        )),
        "apsiii": (severity.apsiii, (STAYS, "diagnoses_icd", "bg", "ventilation", "first_day_gcs", "first_day_vitalsign", "first_day_urine_output", "first_day_lab")),
        "oasis": (scores.oasis, (STAYS, "admissions", "age", "services", "ventilation", "first_day_gcs", "first_day_vitalsign", "first_day_urine_output")),
    },
    "sepsis": {
        "suspicion_of_infection": (infection.suspicion_of_infection, ("antibiotic", "microbiologyevents")), "sepsis3": (infection.sepsis3, ("sofa", "suspicion_of_infection")),
    },
}
#: Tables made like these on request, but not among those that are written together.
EXTRA = {
    "elixhauser": (elixhauser.elixhauser, ("admissions", "diagnoses_icd")),
    "sofa_12h": (windows.sofa_12h, (STAYS, "bg", "ventilation", "vitalsign", "chemistry", "enzyme", "complete_blood_count", "gcs", *scores.PRESSORS)),
    "sirs_12h": (windows.sirs_12h, (STAYS, "vitalsign", "bg", "complete_blood_count", "blood_differential")),
}
CONCEPTS = {name: entry for group in CATEGORIES.values() for name, entry in group.items()}


def _up_to(function: Callable[..., DataFrame], time: str = "charttime") -> Callable[..., DataFrame]:
    """The function over events, then their ends, of which only events up to the end of their stay count."""
    return lambda events, ends, *rest: function(stays.up_to(events, ends, time), *rest)


#: What is made otherwise where a table is built in one run with all that it takes: from events near the start of a stay (rows of these tables depend on events of their own time, those of the coma scale also on
#: events less than six hours before), or from one scan in place of several.
ONE_RUN = {
    "chartevents_day": (partial(stays.near, key="stay_id", before=6, after=24), (CHART, STAYS)), "vitalsign_day": (measurements.vitalsign, ("chartevents_day",)),
    "first_day_vitalsign": (stays.first_day_vitalsign, (STAYS, "vitalsign_day")),
    "chartevents_scale_day": (partial(stays.near, key="stay_id", before=12, after=24), (CHART, STAYS)), "gcs_day": (bedside.gcs, ("chartevents_scale_day",)), "first_day_gcs": (firstday.first_day_gcs, ("gcs_day", STAYS)),
    "outputevents_day": (partial(stays.near, key="stay_id", before=0, after=24), ("outputevents", STAYS)), "urine_output_day": (measurements.urine_output, ("outputevents_day",)),
    "first_day_urine_output": (stays.first_day_urine_output, (STAYS, "urine_output_day")),
    "laboratory": (partial(measurements.laboratory, key="subject_id"), (LAB,)), "first_day_lab": (firstday.first_day_lab_of, ("laboratory", STAYS)),
    **{f"chartevents_{x}": (partial(stays.near, key=key, before=before, after=after), (CHART, STAYS)) for x, key, before, after in (("patient_day", "subject_id", 0, 24), ("12h", "stay_id", 6, 12), ("scale_12h", "stay_id", 12, 12))},
    "vitalsign_patient_day": (measurements.vitalsign, ("chartevents_patient_day",)), "vitalsign_12h": (measurements.vitalsign, ("chartevents_12h",)), "gcs_12h": (bedside.gcs, ("chartevents_scale_12h",)),
    "laboratory_saps": (partial(measurements.laboratory, key="subject_id", tables=("chemistry", "complete_blood_count", "enzyme")), (LAB,)),
    "laboratory_sofa": (partial(measurements.laboratory, key="hadm_id", tables=("chemistry", "complete_blood_count", "enzyme")), (LAB,)),
    "laboratory_sirs": (partial(measurements.laboratory, key="subject_id", tables=("complete_blood_count", "blood_differential")), (LAB,)),
    "sapsii": (severity.sapsii, (
        STAYS, "admissions", "age", "services", "diagnoses_icd", CHART, "bg", "ventilation", "gcs_day", "vitalsign_patient_day", "urine_output_day", "laboratory_saps",
    )),
    "sofa_12h": (windows.sofa_12h_of, (STAYS, "bg", "ventilation", "vitalsign_12h", "laboratory_sofa", "gcs_12h", *scores.PRESSORS)),
    "sirs_12h": (windows.sirs_12h, (STAYS, "vitalsign_12h", "bg", "laboratory_sirs")),
    "first_device": (bedside.first_device, (CHART,)), "ventilation": (bedside.ventilation, ("ventilator_setting", "first_device")),
    "bg_art": (bedside.bg_art, (LAB, CHART)),
    "chart_day_aps": (partial(firstday.first_day_chart, vitals=("heart_rate", "mbp", "resp_rate", "temperature", "glucose")), ("chartevents_scale_day", STAYS)),
    "apsiii": (severity.apsiii_of, (STAYS, "diagnoses_icd", "bg_art", "ventilation", "first_day_lab", "chart_day_aps", "first_day_urine_output")),
    "chart_day_lods": (partial(firstday.first_day_chart, vitals=("heart_rate", "sbp")), ("chartevents_scale_day", STAYS)),
    "lods": (severity.lods_of, (STAYS, CHART, "bg", "ventilation", "first_day_lab", "first_day_urine_output", "chart_day_lods")),
    "first_hour": (stays.first_hour, ("icustay_times",)), "hours_by_stay": (stays.hours_by_stay, ("icustay_times",)), "mean_pressure": (measurements.mean_pressure, (CHART,)), "gcs_of_stay": (bedside.gcs, (CHART,)), "urine_day": (bedside.urine_day, ("outputevents", CHART, STAYS)),
    "pressors": (partial(infusions.pressors, agents=scores.PRESSORS), (INPUT,)),
    "sofa": (scores.sofa_of, (STAYS, "first_hour", "hours_by_stay", "bg_art", "ventilation", "mean_pressure", "gcs_of_stay", "laboratory_sofa", "urine_day", "pressors")),
    # Sepsis takes no hour of a stay without a suspected infection or later than a day after the last one, and all that is scored looks back.
    "infection_ends": (infection.last_times, ("suspicion_of_infection",)), "times_suspected": (stays.times_up_to, ("icustay_times", "infection_ends")),
    "first_hour_suspected": (stays.first_hour, ("times_suspected",)), "hours_suspected": (stays.hours_by_stay, ("times_suspected",)),
    "mean_pressure_suspected": (_up_to(measurements.mean_pressure), (CHART, "infection_ends")), "gcs_suspected": (_up_to(bedside.gcs), (CHART, "infection_ends")),
    "urine_suspected": (_up_to(bedside.urine_day), ("outputevents", "infection_ends", CHART, STAYS)), "pressors_suspected": (_up_to(partial(infusions.pressors, agents=scores.PRESSORS), "starttime"), (INPUT, "infection_ends")),
    "sofa_suspected": (scores.sofa_of, (
        STAYS, "first_hour_suspected", "hours_suspected", "bg_art", "ventilation", "mean_pressure_suspected", "gcs_suspected", "laboratory_sofa", "urine_suspected", "pressors_suspected",
    )),
    "sepsis3": (infection.sepsis3, ("sofa_suspected", "suspicion_of_infection")),
}
#: table -> events -> the key that it groups or joins them by first.
DEALT = {
    **{x: {CHART: "subject_id"} for x in ("bg", "bg_art", "ventilator_setting", "oxygen_delivery", "first_device")}, **{x: {CHART: "stay_id"} for x in ("lods", "sapsii", "chartevents_day", "chartevents_scale_day", "chartevents_12h", "chartevents_scale_12h")},
    "chartevents_patient_day": {CHART: "subject_id"}, "outputevents_day": {"outputevents": "stay_id"},
    "mean_pressure": {CHART: "stay_id"}, "gcs_of_stay": {CHART: "stay_id"}, "urine_day": {"outputevents": "stay_id", CHART: "stay_id"}, "pressors": {INPUT: "stay_id"},
    "mean_pressure_suspected": {CHART: "stay_id"}, "gcs_suspected": {CHART: "stay_id"}, "urine_suspected": {"outputevents": "stay_id", CHART: "stay_id"}, "pressors_suspected": {INPUT: "stay_id"},
}

def build(name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """The plan of a derived table, its own inputs included; read gives the base tables."""
    if name not in CONCEPTS:
        return read(name)
    function, inputs = CONCEPTS[name]
    return function(*[build(x, read) for x in inputs])


def order(names: Iterable[str] = CONCEPTS) -> list[str]:
    """The derived tables that the named ones need, those that are taken first."""
    found: dict[str, None] = {}

    def visit(name: str) -> None:
        if name in CONCEPTS and name not in found:
            for source in CONCEPTS[name][1]:
                visit(source)
            found[name] = None

    for name in names:
        visit(name)
    return list(found)


def materialize_all(read: Callable[[str], DataFrame], write: Callable[[str, DataFrame], DataFrame], names: Iterable[str] = CONCEPTS) -> dict[str, DataFrame]:
    """Write each derived table once, in order; write stores a table under its name and returns it as stored. The first failure stops the run."""
    tables: dict[str, DataFrame] = {}
    for name in order(names):
        function, inputs = CONCEPTS[name]
        for source in inputs:
            if source not in tables:
                tables[source] = read(source)
        tables[name] = write(name, function(*[tables[x] for x in inputs]))
    return {name: table for name, table in tables.items() if name in CONCEPTS}


def save_as_tables(database: str) -> Callable[[str, DataFrame], DataFrame]:
    """A write for materialize_all: tables of a database, which replace those of the same name; the database is made when the first is written."""

    def write(name: str, table: DataFrame) -> DataFrame:
        spark = table.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        table.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
        return spark.table(f"`{database}`.`{name}`")

    return write


def derived_tables(spark, database: str) -> dict[str, list[str]]:
    """The derived tables of a database by category, sorted; categories without one are left out, as is all of a database that isn't there."""
    there = {t.name for t in spark.catalog.listTables(database)} if spark.catalog.databaseExists(database) else set()
    listed = {category: sorted(there & set(group)) for category, group in CATEGORIES.items()}
    return {category: names for category, names in listed.items() if names}
