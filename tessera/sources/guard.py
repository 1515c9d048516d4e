"""The read-only guard: one parsed query, judged node by node, subqueries and common table expressions included."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession

# The logical nodes of a query, functions that reach the host, formats that name a path, names that a query of health records has no use for.
QUERY_NODES = frozenset((
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Distinct", "Deduplicate", "Union", "Except", "Intersect", "Join", "AsOfJoin", "LateralJoin", "Window", "WithWindowDefinition",
    "Generate", "Expand", "Pivot", "Unpivot", "UnpivotTransformer", "Sample", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedHaving", "UnresolvedRelation", "UnresolvedInlineTable",
    "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "ResolvedInlineTable", "LocalRelation", "OneRowRelation", "Range", "UnresolvedHint", "ResolvedHint", "UnresolvedOrdinal", "CTERelationRef", "CTERelationDef",
    "WithCTE", "UnresolvedTranspose",
))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))
HOST_FUNCTIONS = frozenset(("reflect", "try_reflect", "java_method", "sleep", "benchmark", "load_file", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user"))
PATH_FORMATS = frozenset(("parquet", "csv", "json", "orc", "text", "avro", "xml", "binaryfile", "image", "jdbc", "delta", "kafka", "libsvm"))
SUSPECT_NAMES = frozenset(("password", "admin", "login", "auth", "token", "credential", "secret", "hash", "salt", "cookie"))


class QueryError(ValueError):
    """A request that is refused before anything runs."""


def sequence_items(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def plan_nodes(node) -> Iterator:
    """The node, its children, its common table expressions and the plans and parts of its expressions."""
    yield node
    for child in sequence_items(node.children().toSeq()):
        yield from plan_nodes(child)
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        for relation in sequence_items(node.cteRelations().toSeq()):
            yield from plan_nodes(relation.productElement(1))
    if hasattr(node, "expressions") and "plans.logical" in node.getClass().getName() or kind.startswith("Unresolved") and _has(node, "expressions"):
        for expression in sequence_items(node.expressions().toSeq()):
            yield from plan_nodes(expression)
    if _has(node, "plan") and "expressions" in node.getClass().getName():
        yield from plan_nodes(node.plan())


_methods: dict[tuple[str, str], bool] = {}


def _has(node, method: str) -> bool:
    """Whether the node's class has the method; each class is asked once."""
    key = (node.getClass().getName(), method)
    if key not in _methods:
        _methods[key] = any(m.getName() == method and m.getParameterCount() == 0 for m in node.getClass().getMethods())
    return _methods[key]


_known: dict[str, frozenset[str]] = {}


def known_functions(spark: SparkSession) -> frozenset[str]:
    """Spark's own functions; what a session or a catalogue adds is none of them."""
    version = spark.version
    if version not in _known:
        _known[version] = frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())
    return _known[version]


def check_sql(spark: SparkSession, sql: str) -> None:
    """Accept one query. Refused: other statements and several of them, commands wherever they stand, functions that reach the host, files named by
    path, names of credentials, and comparisons of a constant with itself."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise QueryError(f"not a query: {str(error).splitlines()[0]}") from error
    for node in plan_nodes(plan):
        kind, name = node.getClass().getSimpleName(), node.getClass().getName()
        if "expressions" not in name and not re.search(r"analysis\.Unresolved(Attribute|Function|Star|StarExceptOrReplace|Alias|ExtractValue|Ordinal|RegEx|NamedLambda|FunctionName|Identifier|Subquery|LambdaVariable|Generator)$", name) and kind not in QUERY_NODES:
            raise QueryError(f"only queries are allowed, not {kind}")
        parts: list[str] = []
        if kind == "UnresolvedRelation":
            parts = [x.lower() for x in sequence_items(node.multipartIdentifier().toSeq())]
            if len(parts) > 1 and parts[0] in PATH_FORMATS or any("/" in x or "\\" in x for x in parts):
                raise QueryError("tables are named, not read from paths")
        elif kind == "UnresolvedTableValuedFunction":
            called = ".".join(sequence_items(node.name().toSeq())).lower()
            if called not in TABLE_FUNCTIONS:
                raise QueryError(f"table function {called} is not allowed")
        elif kind == "UnresolvedGenerator":
            called = node.name().funcName().lower()
            if called not in TABLE_FUNCTIONS:
                raise QueryError(f"table function {called} is not allowed")
        elif kind == "UnresolvedFunction":
            called = [x.lower() for x in sequence_items(node.nameParts().toSeq())][-1]
            if called in HOST_FUNCTIONS or called not in known_functions(spark):
                raise QueryError(f"function {called} is not allowed")
        elif kind == "UnresolvedAttribute":
            parts = [x.lower() for x in sequence_items(node.nameParts().toSeq())]
        elif kind in ("EqualTo", "EqualNullSafe"):
            left, right = node.left(), node.right()
            if left.getClass().getSimpleName() == right.getClass().getSimpleName() == "Literal" and left.toString() == right.toString():
                raise QueryError("a comparison of a constant with itself is not allowed")
        if SUSPECT_NAMES & set(parts):
            raise QueryError(f"names of credentials are not allowed: {sorted(SUSPECT_NAMES & set(parts))}")
