"""All registered queries of the library with their SQL twins.

Bindings to the given tables: patient = customer, admission = orders, diagnosis = part type reached through lineitem,
charted event = events (stay = user_id, time = ts, item = event_type), note = documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import clinical_queries, concept_queries, quality_queries, relational_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return clinical_queries.QUERIES | quality_queries.QUERIES | relational_queries.QUERIES | concept_queries.QUERIES


def oracles() -> dict[str, str]:
    return clinical_queries.ORACLES | quality_queries.ORACLES | relational_queries.ORACLES | concept_queries.ORACLES
