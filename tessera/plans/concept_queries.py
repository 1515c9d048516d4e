"""The derived tables over the bound base tables as registered queries, each with its SQL twin."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import concepts
from tessera.functions.compat import round_scaled
from tessera.operators.relational import spread
from tessera.plans.clinical_base import EVENTS, SOURCES, TWIN_SLOTS, TWIN_SOURCES, base_sql, base_table
from tessera.plans.concept_twins import TWINS
from tessera.session import materialize

DIGITS = 6


MADE = concepts.CONCEPTS | concepts.EXTRA | concepts.ONE_RUN


def _needs(name: str) -> tuple[str, ...]:
    """What a base or derived table is made of."""
    return SOURCES[name] if name in SOURCES else MADE[name][1] if name in MADE else ()


def _plan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table by its name. Each run builds all that it takes; what several of its tables take is written once in the run, but for events, which are slots of the lines that are written.

    A table's events are dealt by the key that it groups them by, which costs a shuffle of lines in place of one of their slots.
    """
    takers, waiting = Counter(), [name]
    seen = {name}
    while waiting:
        for x in dict.fromkeys(_needs(waiting.pop())):
            takers[x] += 1
            if x not in seen:
                seen.add(x)
                waiting.append(x)
    built: dict[tuple[str, str | None], DataFrame] = {}

    def table(x: str, key: str | None = None) -> DataFrame:
        if (x, key) not in built:
            if x not in SOURCES and x not in MADE:
                made = spark.read.parquet(f"{folder}/{x}.parquet")
            elif x in SOURCES:
                made = base_table(spark, x, [spread(table(y), key) if key else table(y) for y in SOURCES[x]])
            else:
                made = MADE[x][0](*[table(y, concepts.DEALT.get(x, {}).get(y)) for y in _needs(x)])
            built[x, key] = materialize(made, x) if takers[x] > 1 and x not in EVENTS and (x in SOURCES or x in MADE) else made
        return built[x, key]

    return table(name)


def _plain(table: DataFrame) -> DataFrame:
    """Fractions as doubles of DIGITS digits, so that sums in another order compare equal."""
    fraction = (T.DoubleType, T.DecimalType)
    return table.select(*[round_scaled(F.col(f.name), DIGITS).alias(f.name) if isinstance(f.dataType, fraction) else F.col(f.name) for f in table.schema])


def _query(name: str):
    return lambda spark, folder: _plain(_plan(spark, folder, name))


QUERIES = {f"concept_{name}": _query(name) for name in concepts.CONCEPTS | concepts.EXTRA}


def _twin_order(name: str, base: dict[str, str]) -> list[str]:
    found: dict[str, None] = {}

    def visit(x: str) -> None:
        if x not in found and (x in TWINS or x in base):
            for source in TWINS[x][0] if x in TWINS else TWIN_SOURCES[x]:
                visit(source)
            found[x] = None

    visit(name)
    return list(found)


def _oracle(name: str) -> str:
    base = base_sql(TWIN_SLOTS)
    steps = [f"{x} AS MATERIALIZED (\n{TWINS[x][1] if x in TWINS else base[x]})" for x in _twin_order(name, base)]
    chosen = f"* REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {DIGITS}) AS {c}' for c in FRACTIONS[name])})" if FRACTIONS.get(name) else "*"
    return "WITH " + ",\n".join(steps) + f"\nSELECT {chosen} FROM {name}"


#: Columns of sums, means, quotients and decimals.
FRACTIONS = {name: tuple(columns.split()) for name, columns in {
    "age": "age",
    "icustay_detail": "los_hospital admission_age los_icu",
    "blood_differential": "basophils_abs eosinophils_abs lymphocytes_abs monocytes_abs neutrophils_abs",
    "ventilator_setting": "fio2",
    "vitalsign": "heart_rate sbp dbp mbp mbp_ni resp_rate temperature spo2 glucose",
    "height": "height",
    "bg": "fio2_chartevents fio2 aado2_calc pao2fio2ratio",
    "urine_output_rate": "uo_mlkghr_6hr uo_mlkghr_12hr uo_mlkghr_24hr uo_tm_6hr uo_tm_12hr uo_tm_24hr",
    "creatinine_baseline": "age mdrd_est scr_baseline",
    "phenylephrine": "vaso_rate",
    "vasopressin": "vaso_rate",
    "vasoactive_agent": "phenylephrine vasopressin",
    "norepinephrine_equivalent_dose": "norepinephrine_equivalent_dose",
    "first_day_vitalsign": "heart_rate_max heart_rate_mean sbp_min sbp_max sbp_mean dbp_max dbp_mean mbp_mean resp_rate_min resp_rate_max resp_rate_mean temperature_min temperature_max temperature_mean spo2_mean glucose_mean",
    "first_day_height": "height",
    "first_day_bg": "aado2_calc_min aado2_calc_max pao2fio2ratio_min pao2fio2ratio_max",
    "first_day_bg_art": "aado2_calc_min aado2_calc_max pao2fio2ratio_min pao2fio2ratio_max",
    "first_day_lab": "abs_basophils_min abs_basophils_max abs_eosinophils_min abs_eosinophils_max abs_lymphocytes_min abs_lymphocytes_max abs_monocytes_min abs_monocytes_max abs_neutrophils_min abs_neutrophils_max",
    "first_day_weight": "weight_admit weight",
    "kdigo_creatinine": "creat creat_low_past_48hr creat_low_past_7day",
    "kdigo_uo": "uo_rt_6hr uo_rt_12hr uo_rt_24hr",
    "kdigo_stages": "creat_low_past_7day creat_low_past_48hr creat uo_rt_6hr uo_rt_12hr uo_rt_24hr",
    "meld": "meld",
    "sofa": "pao2fio2ratio_novent pao2fio2ratio_vent meanbp_min uo_24hr",
    "sapsii": "sapsii_prob",
    "apsiii": "apsiii_prob",
    "oasis": "oasis_prob age heartrate resprate",
}.items()}
ORACLES = {f"concept_{name}": _oracle(name) for name in TWINS}
