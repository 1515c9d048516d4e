"""Golden texts asked of three schemas: the base tables are those that the other queries take."""

import builtins
import dis

from tessera.plans import clinical_base, relational_queries

FOLDER = "/root/testdata/sf0.001"


def test_queries_name_what_is_there():
    """three_schemas named a function that the module no longer imported."""
    known = vars(relational_queries) | vars(builtins)
    for name, made in relational_queries.QUERIES.items():
        build = made.__closure__[0].cell_contents
        named = {i.argval for i in dis.get_instructions(build) if i.opname == "LOAD_GLOBAL"}
        assert named <= set(known), name


def test_lines_of_stays_are_written_once_for_all_schemas(spark, monkeypatch):
    written = []
    keep = clinical_base.materialize
    monkeypatch.setattr(clinical_base, "materialize", lambda df, name: written.append(name) or keep(df, name))
    found = relational_queries.QUERIES["three_schemas"](spark, FOLDER)
    assert written == ["staylines"]
    counts = {(r[0], r[1]): r[2] for r in found.groupBy("schema_name", "question").count().collect()}
    assert {s for s, _ in counts} == {"given", "renamed", "merged"} and len(counts) == 6
    assert len({n for (_, q), n in counts.items() if q == "balance"}) == 1
