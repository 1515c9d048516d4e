"""Datasets as catalogue namespaces: registry, ingest, views, introspection, read-only SQL and text search."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.guard import QueryError, check_sql

NULL_TOKENS = ("", "NULL", "NA", "N/A", "___")
ROW_LIMIT = 50
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$")


@dataclass(frozen=True)
class Dataset:
    name: str
    modalities: frozenset[str] = frozenset({"TABULAR"})
    schemas: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Dataset:
        if len(text) > 1 << 20:
            raise QueryError("a dataset definition holds at most 1 MB")
        raw = json.loads(text)
        return cls(raw["name"], frozenset(m.upper() for m in raw.get("modalities", ["TABULAR"])), dict(raw.get("schemas", {})))


class Registry:
    """Datasets by name, whatever the case."""

    def __init__(self) -> None:
        self._by_name: dict[str, Dataset] = {}

    def add(self, dataset: Dataset) -> None:
        self._by_name[dataset.name.lower()] = dataset

    def get(self, name: str, needs: frozenset[str] = frozenset()) -> Dataset:
        found = self._by_name.get(name.lower())
        if not found:
            raise QueryError(f"unknown dataset {name}; known: {sorted(self._by_name)}")
        if not needs <= found.modalities:
            raise QueryError(f"dataset {name} lacks {sorted(needs - found.modalities)}")
        return found


def ingest_csv(spark: SparkSession, source: str, target: str, schema: str | None = None) -> DataFrame:
    """CSV (plain or compressed) to Parquet: coded missing values become null, a malformed row stops the whole job."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    raw = reader.schema(schema).csv(source) if schema else reader.csv(source)
    clean = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in raw.dtypes])
    clean.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def ingest_tree(spark: SparkSession, root: str, target: str, dataset: Dataset) -> dict[str, str]:
    """All CSV files (plain or compressed) below a folder, each to Parquet in the same place below target; one failure stops the whole job.

    Returns the name of each table with its path. A file in a mapped folder belongs to that folder's schema, one in an unmapped folder to the only schema where there is just
    one, else it is left out; without any mapping names are folder and stem, joined by an underscore.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(conf).listFiles(base, True)
    found: dict[str, str] = {}
    prefix = base.getFileSystem(conf).makeQualified(base).toString().rstrip("/") + "/"
    while files.hasNext():
        path = files.next().getPath().toString()
        inner = path[len(prefix) :]
        stem = re.sub(r"\.csv(\.\w+)?$", "", inner, flags=re.I)
        if stem == inner:
            continue
        folder, _, name = stem.lower().rpartition("/")
        table = table_name(dataset, folder, name)
        if table:
            ingest_csv(spark, path, f"{target.rstrip('/')}/{stem}.parquet")
            found[table] = f"{target.rstrip('/')}/{stem}.parquet"
    return found


def table_name(dataset: Dataset, folder: str, stem: str) -> str | None:
    schemas = sorted(set(dataset.schemas.values()))
    if folder in dataset.schemas:
        return f"{dataset.schemas[folder]}.{stem}"
    if len(schemas) == 1:
        return f"{schemas[0]}.{stem}"
    return None if schemas else re.sub(r"[-./]", "_", f"{folder}_{stem}" if folder else stem)


def create_views(spark: SparkSession, tables: dict[str, str]) -> list[str]:
    """A database for each schema, and a table over each Parquet folder; names that stand for others are replaced."""
    for name, path in tables.items():
        schema, _, table = name.rpartition(".")
        if schema:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{check_name(schema)}`")
            spark.sql(f"DROP TABLE IF EXISTS `{schema}`.`{table}`")
            spark.catalog.createTable(f"{schema}.{table}", path, "parquet")
        else:
            spark.read.parquet(path).createOrReplaceTempView(check_name(table))
    return sorted(tables)


def table_list(spark: SparkSession, databases: list[str]) -> list[str]:
    """Qualified names of the tables of some databases, sorted; bare names of temporary views where there are none."""
    named = sorted(f"{d}.{t.name}" for d in databases if spark.catalog.databaseExists(d) for t in spark.catalog.listTables(d) if not t.isTemporary)
    return named or sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)


def read_text_table(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file as strings, of which only the empty one is missing: "None" and "NA" are values."""
    raw = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("nullValue", "").option("mode", "FAILFAST").csv(path)
    return raw


def as_text(df: DataFrame, limit: int = ROW_LIMIT) -> str:
    """The first rows as lines, and how many there are where that isn't all."""
    rows = df.limit(limit + 1).collect()
    if not rows:
        return "No results found"
    lines = [" | ".join(df.columns), *[" | ".join("" if x is None else str(x) for x in r) for r in rows[:limit]]]
    return "\n".join(lines + ([f"... {df.count()} total rows"] if len(rows) > limit else []))


def register(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(check_name(name).replace(".", "_"))
    return df


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise QueryError(f"not a table name: {name!r}")
    return name


def execute_query(spark: SparkSession, sql: str) -> DataFrame:
    check_sql(spark, sql)
    return spark.sql(sql)


def is_truncated(df: DataFrame, limit: int = ROW_LIMIT) -> bool:
    return df.limit(limit + 1).count() > limit


def table_info(spark: SparkSession, name: str) -> DataFrame:
    """cid, name, type, notnull, dflt_value, pk of a table's columns. notnull is true where a column can't be null (the surveyed tool shows the opposite); Parquet has neither defaults nor keys."""
    fields = spark.table(check_name(name)).schema
    rows = [(i, f.name, f.dataType.simpleString(), not f.nullable, None, False) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "cid int, name string, type string, notnull boolean, dflt_value string, pk boolean")


def sample_rows(df: DataFrame, limit: int = 3) -> DataFrame:
    return df.limit(min(max(limit, 1), 100))


def data_dictionary(frames: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    rows = [(n.upper(), f.name, f"({f.dataType.simpleString()}) {f.name} of {n.upper()}") for n, df in frames.items() for f in df.schema]
    return spark.createDataFrame(rows, "Original_table_name string, Variable_name string, Description string")


def _limit(value: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise QueryError(f"expected a whole number from 1 to {most}")
    return value


def search_notes(notes: DataFrame, note_id: str, text: str, query: str, limit: int = 5, snippet: int = 300) -> DataFrame:
    """Notes that contain the query, whatever the case, % and _ in it standing for any characters and for any one; the smallest ids first. The snippet lies around the query's first place, or at the
    note's beginning where the query holds such signs and doesn't stand there letter by letter."""
    limit, snippet = _limit(limit, 100), _limit(snippet, 10_000)
    needle = query.lower()
    at = F.instr(F.lower(F.col(text)), needle)
    start = F.when(at > 0, F.greatest(F.lit(1), at - F.lit(snippet // 2))).otherwise(1)
    found = notes.where(F.lower(F.col(text)).like("%" + needle.replace("\\", "\\\\") + "%"))
    return found.select(note_id, F.substring(F.col(text), start, F.lit(snippet)).alias("snippet"), F.length(text).alias("note_length")).orderBy(note_id).limit(limit)


def get_notes(notes: DataFrame, note_id: str, text: str, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """The notes whose ids stand in wanted (a column named note_id), each once, cut to `most` characters."""
    body = F.left(F.col(text), F.lit(_limit(most, 200_000))) if most else F.col(text)
    cut = F.length(text) > most if most else F.lit(False)
    return notes.join(wanted.select(note_id), note_id, "left_semi").select(note_id, body.alias("text"), F.length(text).alias("original_length"), cut.alias("truncated"))


def get_note(notes: DataFrame, note_id: str, text: str, wanted: int | str, most: int | None = None) -> DataFrame:
    return get_notes(notes, note_id, text, notes.where(F.col(note_id) == wanted).select(note_id).distinct(), most)


def list_notes(notes: DataFrame, person: str, note_id: str, text: str, wanted: int | str, limit: int = 20) -> DataFrame:
    out = notes.where(F.col(person) == wanted).select(person, note_id, F.length(text).alias("note_length"), F.left(F.col(text), F.lit(100)).alias("preview"))
    return out.orderBy(note_id).limit(_limit(limit, 100))
