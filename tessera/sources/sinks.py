"""Results as single files in a fixed order, whose bytes depend on the rows alone, with manifests; metric tables with their totals."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import surrogate_keys
from tessera.session import materialize

#: Rows of a block; a block is one member of the compressed file, so members don't depend on how Spark has dealt the rows.
BLOCK = 65_536


def _lines(batch: pa.RecordBatch, first: int) -> list[str]:
    text, out = io.StringIO(), []
    writer = csv.writer(text, lineterminator="\n")
    for row in zip(*(c.to_pylist() for c in batch.columns[first:]), strict=True):
        text.seek(0)
        text.truncate()
        writer.writerow(["" if x is None else x for x in row])
        out.append(text.getvalue())
    return out


def write_ordered(df: DataFrame, path: str, keys: Sequence[str], compress: bool) -> dict[str, object]:
    """df as one CSV file at path (a URI that all executors reach), in the order of the keys and then of all other columns, nulls last; rows, columns, order, blocks and the SHA-256 of the file.

    Rows are numbered over ranges of that order; blocks of BLOCK rows become text (and gzip members without a time) in tasks of their own. One task then appends the blocks, in order, to a file under a name of
    its attempt, one block at a time in memory, and moves it into place. Equal rows give equal bytes, however they are partitioned. Nulls are empty fields; of rows that are equal in all columns none comes first.
    """
    columns = df.columns
    order = [*keys, *[c for c in columns if c not in keys]]
    if unknown := [k for k in keys if k not in columns]:
        raise ValueError(f"no columns {unknown}")
    flags = {f"_null_{i}": F.col(f"`{c}`").isNull() for i, c in enumerate(order)}
    steps = [x for i, c in enumerate(order) for x in (f"_null_{i}", c)]  # false comes first, so nulls are last
    numbered = surrogate_keys(materialize(df, "rows").withColumns(flags), steps, "_at").withColumn("_block", F.floor((F.col("_at") - 1) / BLOCK))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.select("_block", "_at", *columns).repartitionByRange(n, "_block").sortWithinPartitions("_block", "_at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lines = None, []

        def done() -> pa.RecordBatch:
            data = "".join(lines).encode()
            data = gzip.compress(data, 6, mtime=0) if compress else data
            return pa.RecordBatch.from_pydict({"block": [block], "n": [len(lines)], "data": [data]})

        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), _lines(batch, 2), strict=True):
                if block is not None and own != block:
                    yield done()
                    lines = []
                block = own
                lines.append(line)
        if lines:
            yield done()

    blocks = materialize(dealt.mapInArrow(pack, "block long, n long, data binary"), "blocks")
    head = io.StringIO()
    csv.writer(head, lineterminator="\n").writerow(columns)
    header = head.getvalue().encode()
    header = gzip.compress(header, 6, mtime=0) if compress else header

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, plain = pa.fs.FileSystem.from_uri(path)
        open_name = f"{plain}.{TaskContext.get().taskAttemptId()}.open"
        fs.create_dir(plain.rsplit("/", 1)[0], recursive=True)
        total, rows, parts = hashlib.sha256(header), 0, 0
        with fs.open_output_stream(open_name, compression=None) as out:
            out.write(header)
            for batch in batches:
                for count, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    piece = data.as_buffer()
                    out.write(piece)
                    total.update(piece)
                    rows, parts = rows + count, parts + 1
        fs.move(open_name, plain)
        yield pa.RecordBatch.from_pydict({"rows": [rows], "blocks": [parts], "sha256": [total.hexdigest()]})

    found = blocks.repartition(1).sortWithinPartitions("block").mapInArrow(join, "rows long, blocks long, sha256 string").first()
    found = found or _empty(path, header)
    return {"rows": found["rows"], "columns": columns, "order": order, "blocks": found["blocks"], "csv_sha256": found["sha256"]}


def _empty(path: str, header: bytes) -> dict[str, object]:
    """A file of the header alone."""
    _put(path, header)
    return {"rows": 0, "blocks": 0, "sha256": hashlib.sha256(header).hexdigest()}


def _put(path: str, data: bytes) -> None:
    fs, plain = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(plain.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(plain, compression=None) as out:
        out.write(data)


def write_golden(df: DataFrame, path: str, keys: Sequence[str], **more) -> dict[str, object]:
    """write_ordered, compressed, at path (ending in .csv.gz), and beside it a .manifest.json with what it returns and what else is given, keys sorted."""
    if not path.endswith(".csv.gz"):
        raise ValueError("a golden table is a .csv.gz file")
    manifest = {"version": 1, **more, **write_ordered(df, path, keys, compress=True)}
    _put(f"{path.removesuffix('.csv.gz')}.manifest.json", (json.dumps(manifest, indent=2, sort_keys=True) + "\n").encode())
    return manifest


def write_metric(table: DataFrame, total: DataFrame, folder: str, name: str, keys: Sequence[str]) -> None:
    """A metric's table as <name>_summary.csv, ordered by the keys, and its total, a DataFrame of one row, as lines "column = value" in <name>_total.txt."""
    write_ordered(table, f"{folder}/{name}_summary.csv", keys, compress=False)
    row = total.limit(2).collect()
    if len(row) != 1:
        raise ValueError("a total has one row")
    _put(f"{folder}/{name}_total.txt", "".join(f"{c} = {'' if v is None else v}\n" for c, v in row[0].asDict().items()).encode())
