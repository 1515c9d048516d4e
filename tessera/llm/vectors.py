"""Near duplicates among vectors: iterative quantisation, multi-index Hamming tables, exact reranking (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.batches import by_key, least_label
from tessera.llm.graph import components
from tessera.session import materialize

#: Tables at least and at most.
TABLES, MOST = 8, 64
#: The part of pairs at the threshold that tables are added for, and the pairs that it is estimated from.
RECALL, PAIRS = 0.99, 2048
#: Rows that the rotations are learned from; all rows are coded and indexed.
SAMPLE = 4096
#: Rows of a bucket that one task compares with all rows of the bucket at once.
BLOCK = 1024


def _unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length that can be compared, scaled to length 1 in double precision, and which rows these are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 0
    right = np.flatnonzero(lengths == width) if width else np.zeros(0, int)
    flat = column.take(pa.array(right)).flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(right), width)
    with np.errstate(all="ignore"):
        values = values / np.abs(values).max(axis=1, initial=0)[:, None] if width else values
        values = values / np.sqrt((values * values).sum(axis=1))[:, None]
    good = np.isfinite(values).all(axis=1)
    return values[good], right[good]


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to bits columns): PCA, then rotations that alternate between codes and the best rotation to them.

    Where more bits are asked for than there are dimensions, further rotations are learned from other starts.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        basis = axes[: min(bits, len(axes))].T
        reduced = centred @ basis
        rotation, _ = np.linalg.qr(rng.standard_normal((basis.shape[1], basis.shape[1])))
        for _ in range(rounds):
            code = np.where(reduced @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(code.T @ reduced)
            rotation = (u @ vt).T
        parts.append(basis @ rotation)
    return mean, np.hstack(parts)[:, :bits]


def estimated_recall(sample: np.ndarray, mean: np.ndarray, projection: np.ndarray, width: int, threshold: float, seed: int = 7) -> float:
    """The part of pairs of cosine threshold that share a substring in some table, over partners made for rows of the sample.

    A partner lies off its row in a random direction, or in that of another row; the lower of the two parts counts.
    """
    rng = np.random.default_rng(seed)
    rows = sample[rng.integers(len(sample), size=PAIRS)]
    first = (rows - mean) @ projection >= 0
    parts = [1.0]
    for off in (rng.standard_normal(rows.shape), sample[rng.integers(len(sample), size=PAIRS)]):
        off = off - (off * rows).sum(axis=1)[:, None] * rows
        length = np.sqrt((off * off).sum(axis=1))
        good = length > 1e-6
        if good.any():
            partner = threshold * rows[good] + np.sqrt(max(1 - threshold * threshold, 0)) * off[good] / length[good, None]
            same = ((partner - mean) @ projection >= 0) == first[good]
            parts.append(float(same.reshape(len(same), -1, width).all(axis=2).any(axis=1).mean()))
    return min(parts)


def _planned(threshold: float, tables: int, width: int) -> int:
    """Tables of substrings of width bits that find RECALL of the pairs at the threshold, if bits are random hyperplanes."""
    same = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** width
    return max(tables, int(np.ceil(np.log(1 - RECALL) / np.log1p(-same)))) if 0 < same < 1 else tables if same else MOST + 1


def plan_tables(sample: np.ndarray, n: int, threshold: float, tables: int = TABLES) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(width, tables, mean, projection) for n entries: log2(n) - 4 bits a substring, and as many tables as RECALL takes.

    Their number is planned by the angular model, then raised while the estimate on the sample falls short. Where it would pass MOST,
    substrings get shorter instead: buckets then grow, but recall doesn't fall, whatever n, the threshold and the vectors. Where tables
    outnumber buckets (vectors about one direction), there is one bucket of all entries, and every pair is compared.
    """
    width = int(np.clip(np.ceil(np.log2(max(n, 2))) - 4, 6, 31))
    count = _planned(threshold, tables, width)
    while 1 << width >= count:
        if count > max(MOST, tables):
            width -= 1
            count = _planned(threshold, tables, width)
            continue
        mean, projection = learn_rotations(sample, width * count)
        recall = estimated_recall(sample, mean, projection, width, threshold)
        if recall >= RECALL:
            return width, count, mean, projection
        count = max(count + 1, int(np.ceil(count * np.log(1 - RECALL) / np.log1p(-max(recall, 1e-3)))))
    return 0, 1, np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 0))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Rows with equal vectors are one entry with a multiplicity. Codes are cut into one substring for each table; entries
    with equal substrings share a bucket and are reranked by the cosine of the original vectors in double precision, so
    no link is false. The length of a substring follows log2 of the number of entries, so buckets stay about the same size. A link
    counts in the first table in which it is found. Buckets of more than BLOCK entries are dealt out by blocks, each
    compared with the whole bucket by matrix products; only counts and, for each entry, one link that joins it to its
    component within the block leave a task. Vectors that are null, zero, of another length than most, or hold null or
    non-finite components link with nothing. Repeated ids are rows of their own; null ids take part, but don't name a
    component. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    key = F.xxhash64("embedding", F.size("embedding"))
    entries = rows.where("embedding is not null").groupBy(key.alias("entry")).agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.any_value("embedding").alias("embedding"))
    entries = materialize(entries, "entries")
    n = entries.count()
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = entries.select("entry", "embedding").orderBy(F.xxhash64("entry"), "entry").limit(sample).toArrow()
    units, _ = _unit(chosen.column("embedding"))
    if not len(units):
        return none
    width, tables, mean, projection = plan_tables(units, n, threshold, tables)
    dims = len(mean)
    weights = 1 << np.arange(width, dtype=np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, at = _unit(batch.column(2))
            if not len(at) or unit.shape[1] != dims:
                continue
            bits = ((unit - mean) @ projection >= 0).astype(np.int64).reshape(len(at), tables, width)
            parts = (bits * weights).sum(axis=2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts.size + 1, tables), pa.int32()), pa.array(parts.ravel().astype(np.int32)))
            blobs = pa.array([u.tobytes() for u in unit], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), lists, blobs], names=["entry", "copies", "codes", "unit"])

    coded = materialize(entries.select("entry", "copies", "embedding").mapInArrow(code, "entry long, copies long, codes array<int>, unit binary"), "codes")
    placed = coded.select("entry", "copies", "codes", "unit", F.posexplode("codes").alias("table", "part"))
    placed = placed.withColumn("bucket", F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("part")))
    full = coded.select(F.posexplode("codes").alias("table", "part")).groupBy(F.shiftleft(F.col("table").cast("long"), 32).bitwiseOR(F.col("part")).alias("bucket")).agg(F.count("*").alias("n"))
    large = full.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))  # at most tables * entries / BLOCK rows
    placed = placed.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "block", "table", "own", "entry", "copies", "codes", "unit")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(partitions, "bucket", "block").sortWithinPartitions("bucket", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 2):
            yield from _compared(group, dims, tables, threshold)

    found = materialize(dealt.mapInArrow(compare, "entry long, links long, other long"), "vector-links")
    counts = found.groupBy("entry").agg(F.sum("links").alias("links"))
    roots = components(found, "entry", "other")
    classes = entries.join(coded.select("entry", F.lit(True).alias("good")), "entry", "left").select("entry", "copies", "least", F.coalesce("good", F.lit(False)).alias("good"))
    classes = classes.join(counts, "entry", "left").join(roots.select(F.col("node").alias("entry"), "root"), "entry", "left")
    classes = classes.withColumn("root", F.coalesce("root", "entry"))
    classes = classes.join(classes.groupBy("root").agg(F.min("least").alias("first")), "root")
    classes = classes.select("entry", "good", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    joined = rows.select("vec_id", F.when(F.col("embedding").isNotNull(), key).alias("entry")).join(classes, "entry", "left")
    good = F.coalesce("good", F.lit(False))
    component = F.when(good, F.col("first")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(good, F.col("links")).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def _compared(group: pa.Table, dims: int, tables: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rerank one block of a bucket against the bucket: entry, links (copies of others linked here for the first time), other
    (the least entry of its component within the block)."""
    if len(group) < 2:
        return
    group = group.take(pa.array(np.argsort(group.column("entry").to_numpy(), kind="stable")))
    block, first, own = group.column("block")[0].as_py(), group.column("table")[0].as_py(), group.column("own").to_numpy()
    entry, copies = group.column("entry").to_numpy(), group.column("copies").to_numpy()
    codes = group.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables)
    unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, dims)
    mine = np.flatnonzero(own == block)
    links, pairs = np.zeros(len(entry), np.int64), []
    for low in range(0, len(entry), 4 * BLOCK):
        near = unit[low : low + 4 * BLOCK] @ unit[mine].T >= threshold
        near &= entry[low : low + 4 * BLOCK, None] != entry[None, mine]
        x, y = np.nonzero(near)
        x, y = x + low, mine[y]
        pairs.append((x, y))
        for table in range(first):
            fresh = codes[x, table] != codes[y, table]
            x, y = x[fresh], y[fresh]
        np.add.at(links, x, copies[y])
    x, y = (np.concatenate(c) for c in zip(*pairs, strict=True))
    label = least_label(len(entry), x, y)
    chosen = np.unique(np.concatenate((x, y)))
    yield pa.RecordBatch.from_arrays([pa.array(entry[chosen]), pa.array(links[chosen]), pa.array(entry[label[chosen]])], names=["entry", "links", "other"])
