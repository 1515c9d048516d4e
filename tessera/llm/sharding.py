"""Sharding by size: global prefix sums from per-partition totals, cut at equal targets (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import integer_ids
from tessera.session import materialize

OVERHEAD = 16
#: A group of equal texts that lies across a cut moves to one side whole if it is within this part of a shard, or no larger
#: than the largest row, which can lie as far off a cut by itself.
SLACK = 0.02


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each row's place within its partition: the bytes and rows before it."""
    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        size = batch.column(batch.schema.get_field_index("size")).to_numpy()
        ends = size_before + np.cumsum(size)
        places = [pa.array(np.full(len(size), part)), pa.array(ends - size), pa.array(rows_before + np.arange(len(size)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *places], names=[*batch.schema.names, "_part", "_low", "_row"])
        size_before, rows_before = (int(ends[-1]) if len(size) else size_before), rows_before + len(size)


def shard_by_size(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    Rows stand in the order of (hash of the text, doc_id), so equal texts are neighbours and languages and sources are
    spread over all shards. Spark deals ranges of that order to partitions; their totals, one row each, give every
    partition the bytes and rows before it, and a row goes to the shard in which its midpoint lies. A group of equal texts
    across a cut goes to the side of the group's midpoint if it is small (SLACK); a larger one is cut. slot
    counts a shard's rows from 0. Null texts are empty; equal and null ids are rows like others; an empty table gives an
    empty result; extra columns are left out.
    """
    docs = integer_ids(docs)
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("_group"),
    )
    order = ["_group", "text_crc32", "doc_id"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.mapInArrow(_running, "doc_id long, size long, text_crc32 long, _group long, _part long, _low long, _row long"), "shard-ranges")
    # Totals of partitions: a row for each, so their number is that of spark.sql.shuffle.partitions.
    bytes_before, rows_before, largest, before = 0, 0, 0, []
    for part, size, count, most in sorted(tuple(r) for r in placed.groupBy("_part").agg(F.sum("size"), F.count("*"), F.max("size")).collect()):
        before.append((part, bytes_before, rows_before))
        bytes_before, rows_before, largest = bytes_before + size, rows_before + count, max(largest, most)
    target = max(bytes_before, 1) / shards
    starts = spark.createDataFrame(before, "_part long, _bytes long, _rows long")
    placed = placed.join(F.broadcast(starts), "_part").withColumn("_low", F.col("_low") + F.col("_bytes")).withColumn("_row", F.col("_row") + F.col("_rows"))
    # The groups that a cut divides: at most one for each of the shards - 1 cuts.
    groups = placed.groupBy("_group", "text_crc32").agg(F.min("_low").alias("_first"), F.max(F.col("_low") + F.col("size")).alias("_end"), F.count("*").alias("_n"))
    small = (F.col("_n") > 1) & (F.col("_end") - F.col("_first") <= max(SLACK * target, largest))
    divided = groups.where(small & (F.floor(F.col("_first") / target) < F.floor((F.col("_end") - 1) / target)))
    divided = divided.select("_group", "text_crc32", ((F.col("_first") + F.col("_end")) / 2).alias("_middle"))
    placed = placed.join(F.broadcast(divided), ["_group", "text_crc32"], "left")
    middle = F.coalesce("_middle", F.col("_low") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle / target), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first_row"))
    placed = placed.join(F.broadcast(first), "shard")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.col("_first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
