"""The same data under other names and in other tables: queries rewritten for renamed tables, merged tables and the views that give the single ones back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.guard import plan_nodes, sequence_items

#: What the merged tables are made of: name -> (column that tells the halves apart, ((table, its mark), (table, its mark))).
STACKS = {
    "observations": ("source", (("chartevents", "chart"), ("labevents", "lab"))),
    "flows": ("direction", (("inputevents", "in"), ("outputevents", "out"))),
    "item_reference": ("item_type", (("d_items", "chart"), ("d_labitems", "lab"))),
}
#: Patients, admissions and stays in one table, and their keys.
ENCOUNTERS, PEOPLE, KEYS = "encounters", ("patients", "admissions", "icustays"), ("subject_id", "hadm_id", "stay_id")


def _tokens(spark: SparkSession, sql: str) -> list[tuple[str, int, int]]:
    """Kind, first and last place of every token but white space and comments, as Spark's own lexer cuts the text."""
    jvm = spark._jvm
    lexer = jvm.org.apache.spark.sql.catalyst.parser.SqlBaseLexer(jvm.org.apache.spark.sql.catalyst.parser.UpperCaseCharStream(jvm.org.antlr.v4.runtime.CharStreams.fromString(sql)))
    names, tokens = lexer.getVocabulary(), lexer.getAllTokens()
    every = [tokens.get(i) for i in range(tokens.size())]
    return [(names.getSymbolicName(t.getType()), t.getStartIndex(), t.getStopIndex()) for t in every if t.getChannel() == 0]


def _relations(spark: SparkSession, sql: str) -> list[tuple[str, int, int, bool]]:
    """Name, first and last place of every table that the parsed text reads, and whether it has an alias; its own common table expressions are none."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, own, aliased = [], set(), set()
    for node in plan_nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            own |= {relation.productElement(0).lower() for relation in sequence_items(node.cteRelations().toSeq())}
        elif kind == "SubqueryAlias" and node.child().getClass().getSimpleName() == "UnresolvedRelation":
            aliased.add(node.child().origin().startIndex().get())
        elif kind == "UnresolvedRelation":
            name, at = ".".join(sequence_items(node.multipartIdentifier().toSeq())).lower(), node.origin()
            found.append((name, at.startIndex().get(), at.stopIndex().get()))
    return sorted({(name, low, high, low in aliased) for name, low, high in found if name not in own}, key=lambda x: x[1])


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def rewrite_sql(spark: SparkSession, sql: str, tables: Mapping[str, str], columns: Mapping[str, str]) -> str:
    """The query for tables and columns with other names (old -> new, case folded; tables with their schema where the text has it).

    Tables are replaced where the parsed plan reads one, and keep their old name as alias, so that qualified columns stay right. Columns are replaced wherever a token of the text is an
    identifier of that name, aliases of the same name included, so inner and outer queries agree; strings, comments, functions and types of casts stay. Names of the result change with
    them: names_back undoes that.
    """
    tables, columns = {k.lower(): v for k, v in tables.items()}, {k.lower(): v for k, v in columns.items()}
    if len(set(columns.values())) != len(columns) or len(set(tables.values())) != len(tables):
        raise ValueError("two names fall together")
    edits: dict[tuple[int, int], str] = {}
    for name, low, high, aliased in _relations(spark, sql):
        if name in tables:
            # a relation's place ends with its alias where it has one
            parts = re.match(r"(?:`[^`]*`|\w+)(?:\s*\.\s*(?:`[^`]*`|\w+))*", sql[low : high + 1])
            edits[low, low + parts.end() - 1] = _quoted(tables[name]) + ("" if aliased else f" AS {_quoted(name.split('.')[-1])}")
    taken = sorted(edits)
    tokens, casts = _tokens(spark, sql), []
    text = [sql[low : high + 1] for _, low, high in tokens]
    for i, (kind, low, high) in enumerate(tokens):
        before, after = text[i - 1].upper() if i else "", text[i + 1] if i + 1 < len(tokens) else ""
        if text[i] == "(":
            casts.append(before in ("CAST", "TRY_CAST"))
        elif text[i] == ")":
            casts and casts.pop()
        if any(a <= low and high <= b for a, b in taken):
            continue
        name = text[i][1:-1].replace("``", "`") if kind == "BACKQUOTED_IDENTIFIER" else text[i] if re.fullmatch(r"\w+", text[i]) and not text[i][0].isdigit() else None
        if name is None:
            continue
        following = tokens[i + 1][0] if i + 1 < len(tokens) else ""
        is_type = before == "AS" and bool(casts) and casts[-1] or following == "STRING_LITERAL"
        if after == "." and i + 3 < len(tokens) and text[i + 3] == "." and f"{name}.{text[i + 2]}".lower() in tables:
            edits[low, tokens[i + 1][2]] = ""  # schema.table.column: the table has its own name as alias
        elif name.lower() in columns and after != "(" and not is_type and not (after == "." and name.lower() in {t.split(".")[-1] for t in tables}):
            edits[low, high] = _quoted(columns[name.lower()])
    out = sql
    for (low, high), new in sorted(edits.items(), reverse=True):
        out = out[:low] + new + out[high + 1 :]
    return out


def names_back(result: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The result of a rewritten query under the old names of its columns."""
    old = {new: name for name, new in columns.items()}
    return result.toDF(*[old.get(c, c) for c in result.columns])


def stacked(first: DataFrame, second: DataFrame, tag: str, marks: Sequence[str]) -> DataFrame:
    """Both tables' rows in one: the mark of each half, the columns of both, those of the first only and those of the second only, with nulls of their type in the other half."""
    shared = [c for c in first.columns if c in second.columns]
    unlike = [c for c in shared if first.schema[c].dataType != second.schema[c].dataType]
    if unlike or tag in first.columns + second.columns:
        raise ValueError(f"columns {unlike or [tag]} can't be told apart or back")
    halves = [df.select(F.lit(mark).alias(tag), *shared, *[c for c in df.columns if c not in shared]) for df, mark in zip((first, second), marks, strict=True)]
    return halves[0].unionByName(halves[1], allowMissingColumns=True)


def unstacked(table: DataFrame, tag: str, mark: str, columns: Sequence[str]) -> DataFrame:
    return table.where(F.col(tag) == mark).select(*columns)


def denormalised(patients: DataFrame, admissions: DataFrame, stays: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row for each admission and stay, an admission without a stay kept, with all columns once. Patients without an admission have no row. Beside the keys no column may be in two tables."""
    patient, admission, stay = keys
    rest = [c for df, used in ((patients, ()), (admissions, (patient,)), (stays, (patient, admission))) for c in df.columns if c not in used]
    if len(set(rest)) != len(rest) or stay not in stays.columns:
        raise ValueError("a column is in two tables")
    return admissions.join(patients, patient).join(stays.drop(patient), admission, "left").select(*rest)


def normalised(encounters: DataFrame, columns: Mapping[str, Sequence[str]], keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """The single tables of denormalised, by the columns that they had; each of their keys is unique. Patients without an admission don't come back."""
    kept = {"patients": encounters, "admissions": encounters, "icustays": encounters.where(F.col(keys[2]).isNotNull())}
    return {name: kept[name].select(*columns[name]).distinct() for name in PEOPLE}


def restructured(tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables with those of STACKS and the three of ENCOUNTERS merged, the views that give each given table back). A merged table whose parts aren't all given is left out."""
    out, back = dict(tables), dict(tables)
    for name, (tag, halves) in STACKS.items():
        if all(t in tables for t, _ in halves):
            (a, _), (b, _) = halves
            out[name] = stacked(tables[a], tables[b], tag, [m for _, m in halves])
            for table, mark in halves:
                back[table] = unstacked(out[name], tag, mark, out.pop(table).columns)
    if all(t in tables for t in PEOPLE):
        out[ENCOUNTERS] = denormalised(*[out.pop(t) for t in PEOPLE])
        back |= normalised(out[ENCOUNTERS], {t: tables[t].columns for t in PEOPLE})
    return out, back
