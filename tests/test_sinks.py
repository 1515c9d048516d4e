"""Golden files: order, bytes on reruns, manifests, and the text of metric tables."""

import gzip
import hashlib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks

SCHEMA = "k int, name string, x double, t timestamp_ntz, ok boolean, `a.b` int"


def rows(n=500):
    rng = random.Random(8)
    return [(None if i % 17 == 0 else rng.randrange(40), rng.choice([None, "", "a,b", 'say "x"', "line\nbreak", "é"]), rng.choice([None, 0.1, 1e20, -2.0]), None if i % 5 else datetime(2150, 1, 1, i % 24), rng.choice([True, None]), i % 3) for i in range(n)]


@pytest.mark.parametrize("block", [64, 65536])
def test_equal_rows_give_equal_bytes_in_order(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(sinks, "BLOCK", block)
    df = spark.createDataFrame(rows(), SCHEMA).drop("a.b")
    one = sinks.write_golden(df, f"file://{tmp_path}/one.csv.gz", ["k", "t"], task="demo")
    two = sinks.write_golden(df.repartition(7).orderBy(F.desc("name")), f"file://{tmp_path}/two.csv.gz", ["k", "t"], task="demo")
    data = (tmp_path / "one.csv.gz").read_bytes()
    assert one == two and data == (tmp_path / "two.csv.gz").read_bytes()
    assert one["csv_sha256"] == hashlib.sha256(data).hexdigest() and one["rows"] == 500 and one["blocks"] == -(-500 // block)
    assert json.loads((tmp_path / "one.manifest.json").read_text()) == one and one["order"] == ["k", "t", "name", "x", "ok"]
    order = [0, 3, 1, 2, 4]
    want = sorted((r[:5] for r in rows()), key=lambda r: [(r[i] is None, r[i] if r[i] is not None else 0) for i in order])
    import csv
    import io

    found = list(csv.reader(io.StringIO(gzip.decompress(data).decode())))
    assert found == [["k", "name", "x", "t", "ok"], *[["" if v is None else str(v) for v in r] for r in want]]
    assert not list(tmp_path.glob("*.open"))


def test_empty_tables_and_refusals(spark, tmp_path):
    df = spark.createDataFrame([], "k int, v string")
    assert sinks.write_golden(df, f"file://{tmp_path}/none.csv.gz", ["k"])["rows"] == 0
    assert gzip.decompress((tmp_path / "none.csv.gz").read_bytes()) == b"k,v\n"
    with pytest.raises(ValueError, match="no columns"):
        sinks.write_golden(df, f"file://{tmp_path}/x.csv.gz", ["z"])
    with pytest.raises(ValueError, match="csv.gz"):
        sinks.write_golden(df, f"file://{tmp_path}/x.csv", ["k"])


def test_metric_files(spark, tmp_path):
    table = spark.createDataFrame([("b", 2.5), ("a", None)], "variable string, share double")
    sinks.write_metric(table, table.agg(F.count("*").alias("Variables"), F.avg("share").alias("Mean (%)")), f"file://{tmp_path}/out", "completeness", ["variable"])
    assert (tmp_path / "out/completeness_summary.csv").read_text() == "variable,share\na,\nb,2.5\n"
    assert (tmp_path / "out/completeness_total.txt").read_text() == "Variables = 2\nMean (%) = 2.5\n"
