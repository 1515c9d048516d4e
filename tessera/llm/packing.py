"""Conflict-constrained best-fit packing (operator 4)."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.words import integer_ids, n_words
from tessera.session import materialize

CAPACITY = 2048
#: Rows of one packing group; a group is packed by one task, and bins never cross groups.
GROUP_ROWS = 2048


class Bins:
    """Open bins in the order of their residuals, each with bitmaps of its sources and duplicate clusters.

    A Python integer is a bitmap of any width. Bins of equal residual stand in the order of their numbers.
    """

    def __init__(self, capacity: int):
        self.capacity, self.order, self.sources, self.clusters, self.used = capacity, [], [], [], []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset) for an item of at most capacity: its successor search starts at the tightest bin that has room
        and goes on, bin by bin, until neither bitmap holds the item's source or cluster; else a bin is opened."""
        order = self.order
        at = bisect_left(order, (size, -1))
        while at < len(order):
            number = order[at][1]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                residual = order.pop(at)[0] - size
                break
            at += 1
        else:
            number, residual = len(self.used), self.capacity - size
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        offset = self.used[number]
        self.used[number] += size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if residual:  # a full bin takes nothing more
            order.insert(bisect_left(order, (residual, number)), (residual, number))
        return number, offset


def pack_group(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack one group: items by size (largest first), then id, then piece."""
    items = items.sort_values(["size", "doc_id", "piece", "source", "cluster"], ascending=[False, True, True, True, True], kind="stable")
    # Only clusters with several rows here can conflict; -1 marks a row without a source bit.
    clusters, counts = np.unique(items["cluster"].to_numpy(), return_counts=True)
    bit = {int(c): 1 << i for i, c in enumerate(clusters[counts > 1])}
    sources = {s: 1 << i for i, s in enumerate(pd.unique(items["source_bit"])) if s >= 0}
    bins, placed = Bins(capacity), []
    for size, source, cluster in zip(items["size"].tolist(), items["source_bit"].tolist(), items["cluster"].tolist(), strict=True):
        placed.append(bins.put(size, sources.get(source, 0), bit.get(cluster, 0)))
    items["bin"], items["bin_offset"] = [b for b, _ in placed], [o for _, o in placed]
    return items


def _numbered(pieces: DataFrame) -> DataFrame:
    """pieces with row: 0, or the number of the row among the rows that repeat it. Only repeated rows are shuffled whole, and numbers don't depend on their order."""
    same = ["doc_id", "source", "cluster", "piece", "size", "source_bit"]
    repeated = pieces.groupBy(same).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in same])
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    several = pieces.join(repeated, equal, "left_semi").withColumn("row", F.row_number().over(Window.partitionBy(same).orderBy("doc_id")).cast("long"))
    return pieces.join(repeated, equal, "left_anti").withColumn("row", F.lit(0).cast("long")).unionByName(several)


def best_fit_pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    size: Column | None = None,
    cluster: Column | None = None,
    source_conflicts: bool = True,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Pack the rows of docs (doc_id, text, source) into bins of capacity words: doc_id, source, piece, size, pack_group, bin, bin_offset.

    No bin holds two rows of one source (unless source_conflicts is False) or of one duplicate cluster (by default: equal
    texts). A text of more than capacity words is divided into pieces of capacity words and a rest; whole pieces fill bins
    of their own, and the pieces of a text count as one cluster. Texts without words, null ones too, take no room: they
    are returned with size 0 and null bin. Rows are dealt by a hash of id, text and piece to groups of about group_rows, and each
    group is packed by itself, so any source or cluster, however large, spreads over all groups. A bin is (pack_group, bin).
    Null sources are one source; null ids and repeated rows are packed like others; an empty table gives an empty result; reruns agree whatever
    the order of the rows.
    """
    spark, docs = docs.sparkSession, integer_ids(docs)
    size = n_words(F.col("text")) if size is None else size.cast("long")
    cluster = F.xxhash64("text") if cluster is None else F.xxhash64(cluster)
    rows = docs.select("doc_id", "source", size.alias("_size"), cluster.alias("cluster"))
    pieces = rows.select(
        "doc_id", "source", "cluster", "_size", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(_size - 1) div {capacity}"), F.lit(0)))).alias("piece")
    )
    rest = F.least(F.col("_size") - F.col("piece") * capacity, F.lit(capacity))
    pieces = pieces.select("doc_id", "source", "cluster", F.col("piece").cast("int"), rest.alias("size"))
    bits = F.xxhash64("source") if source_conflicts else F.lit(-1).cast("long")
    pieces = pieces.withColumn("source_bit", F.when(F.lit(source_conflicts), F.abs(bits % F.lit(2**40))).otherwise(-1))
    pieces = _numbered(materialize(pieces, "pack-pieces"))
    groups = max(1, -(-pieces.count() // group_rows))
    key = F.pmod(F.xxhash64("doc_id", "cluster", "piece", "source", "row"), F.lit(groups))
    schema = "doc_id long, source string, piece int, size long, pack_group long, bin long, bin_offset long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        packed = pack_group(frame, capacity)
        return packed[["doc_id", "source", "piece", "size", "pack_group", "bin", "bin_offset"]]

    room = pieces.where("size > 0").withColumn("pack_group", key)
    none = [F.lit(None).cast("long").alias(c) for c in ("pack_group", "bin", "bin_offset")]
    return room.groupBy("pack_group").applyInPandas(pack, schema).unionByName(pieces.where("size = 0").select("doc_id", "source", "piece", "size", *none))
