"""Drugs given at a rate: one table for each, their common segments of time, and the dose that they amount to."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.compat import decimal_text, divide
from tessera.operators.timeops import micros

# Item codes.
AGENTS = {"dobutamine": 221653, "dopamine": 221662, "epinephrine": 221289, "norepinephrine": 221906, "phenylephrine": 221749, "vasopressin": 222315, "milrinone": 221986}
BLOCKERS = (222062, 221555)


def _rate(agent: str) -> Column:
    unit, rate, weight = F.col("rateuom"), F.col("rate"), F.col("patientweight")
    if agent == "norepinephrine":  # a weight of 1 marks rates that are in micrograms already
        return F.when((unit == "mg/kg/min") & ~F.coalesce(weight == 1, F.lit(False)), rate * 1000.0).otherwise(rate)
    if agent == "phenylephrine":
        return F.when(unit == "mcg/min", divide(rate, weight)).otherwise(rate)
    if agent == "vasopressin":
        return F.when(unit == "units/min", rate * 60.0).otherwise(rate)
    return rate


def infusion(inputevents: DataFrame, agent: str) -> DataFrame:
    rows = inputevents.where(F.col("itemid") == AGENTS[agent])
    return rows.select("stay_id", "linkorderid", _rate(agent).alias("vaso_rate"), F.col("amount").alias("vaso_amount"), "starttime", "endtime")


def pressors(inputevents: DataFrame, agents: tuple[str, ...]) -> DataFrame:
    """Infusions of several agents from one scan: stay_id, starttime, endtime and the rate of the row's agent, null for the others."""
    code = F.col("itemid")
    rows = inputevents.where(code.isin(*[AGENTS[a] for a in agents]))
    return rows.select("stay_id", "starttime", "endtime", *[F.when(code == AGENTS[a], _rate(a)).alias(f"rate_{a}") for a in agents])


def neuroblock(inputevents: DataFrame) -> DataFrame:
    rows = inputevents.where(F.col("itemid").isin(*BLOCKERS) & F.col("rate").isNotNull())
    return rows.select("stay_id", "orderid", F.col("rate").alias("drug_rate"), F.col("amount").alias("drug_amount"), "starttime", "endtime")


def vasoactive_agent(inputevents: DataFrame) -> DataFrame:
    """Segments between one start or end and the next of a stay, with the rate of each agent whose infusion covers them; overlapping infusions of an agent give a row each.

    A sweep along each stay's time line: starts and ends are one sorted stream, of which the infusions under way are held. A start or end that is null, or a start that is not before its end, covers nothing; times
    that are known cut the line all the same.
    """
    names = list(AGENTS)
    given = inputevents.where(F.col("itemid").isin(*AGENTS.values()))
    rate, agent = F.lit(None).cast("double"), F.lit(None).cast("int")
    for i, name in enumerate(names):
        mine = F.col("itemid") == AGENTS[name]
        rate, agent = F.when(mine, _rate(name)).otherwise(rate), F.when(mine, i).otherwise(agent)
    given = given.select("stay_id", micros(F.col("starttime")).alias("low"), micros(F.col("endtime")).alias("high"), agent.alias("agent"), rate.alias("rate"))
    # each infusion is a mark at its start, with what it gives, and one at its end; a mark without an agent only cuts
    start = F.struct(F.col("low").alias("at"), F.when(F.col("low") < F.col("high"), F.col("agent")).alias("agent"), "rate", "high")
    end = F.struct(F.col("high").alias("at"), F.lit(None).cast("int").alias("agent"), F.lit(None).cast("double").alias("rate"), F.lit(None).cast("long").alias("high"))
    marks = given.select("stay_id", F.explode(F.array(start, end)).alias("m")).select("stay_id", "m.*").where("at is not null and stay_id is not null")
    line = marks.repartition("stay_id").sortWithinPartitions("stay_id", "at")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay, last, under_way, out = None, None, [], []
        for batch in batches:
            for this, at, kind, rate, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if this != stay:
                    stay, last, under_way = this, None, []
                if last is not None and at > last:
                    rates = [[r for k, r, _ in under_way if k == i] or [None] for i in range(len(names))]
                    out += [(stay, last, at, *chosen) for chosen in product(*rates)]
                    under_way = [x for x in under_way if x[2] > at]
                last = at
                if kind is not None:
                    under_way.append((kind, rate, high))
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.float64()) for c in columns[3:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["stay_id", "low", "high", *names])
                out = []

    found = line.mapInArrow(sweep, "stay_id long, low long, high long, " + ", ".join(f"{n} double" for n in names))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("stay_id", time("low").alias("starttime"), time("high").alias("endtime"), *names)


def norepinephrine_equivalent_dose(agents: DataFrame) -> DataFrame:
    """Rates of the five pressors as one rate of norepinephrine, to four digits of a three-digit decimal."""
    # What a unit of each agent counts.
    parts = {"norepinephrine": F.col("norepinephrine"), "epinephrine": F.col("epinephrine"), "phenylephrine": F.col("phenylephrine") / 10, "dopamine": F.col("dopamine") / 100, "vasopressin": F.col("vasopressin") * 2.5 / 60}
    dose = sum((F.coalesce(x, F.lit(0.0)) for x in parts.values()), F.lit(0.0))
    return agents.where(F.coalesce(*parts).isNotNull()).select("stay_id", "starttime", "endtime", F.round(decimal_text(dose), 4).alias("norepinephrine_equivalent_dose"))
