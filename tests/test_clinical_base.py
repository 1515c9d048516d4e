"""Base tables in Spark: what several event tables share is made once."""

import re

from tessera.plans import concept_queries
from tessera.plans.clinical_base import EVENTS, base_tables

FOLDER = "/root/testdata/sf0.001"


def test_events_shuffle_lines_once(spark, monkeypatch):
    written = []
    keep = concept_queries.materialize
    monkeypatch.setattr(concept_queries, "materialize", lambda df, name: written.append(name) or keep(df, name))
    plan = concept_queries._plan(spark, FOLDER, "rrt")._jdf.queryExecution().optimizedPlan().toString()
    assert "staylines" in written and not set(written) & set(EVENTS)
    assert "l_shipdate" not in plan and not re.search(r"Relation \[l_orderkey#\d+L,l_partkey", plan)


def test_events_are_slots_of_lines(spark):
    tables = base_tables(spark, ["chartevents", "inputevents"], lambda x: spark.read.parquet(f"{FOLDER}/{x}.parquet"))
    lines = tables["staylines"].count()
    assert lines > 0 and (tables["chartevents"].count(), tables["inputevents"].count()) == (28 * lines, 3 * lines)


def test_hours_of_sofa_meet_by_grouping(spark):
    plan = concept_queries._plan(spark, FOLDER, "sofa")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*hr#", plan) and not re.search(r"Window .*max\(", plan)


def test_memory_of_a_task_follows_the_number_of_partitions(spark):
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, key in (("urine_output_rate", "stay_id"), ("kdigo_uo", "stay_id"), ("charlson", "l_orderkey"), ("elixhauser", "l_orderkey")):
        plan = concept_queries._plan(spark, FOLDER, name)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\({key}#\d+L, {wanted}\), REPARTITION_BY_NUM", plan), name
