"""Hard negatives by lists that clusters of anchors share, each walked until its end is certified (operator 13, after MAXIMUS).

For an anchor a of a cluster with centre c whose members lie within the angle B of it, and a candidate i at the angle T from c, the inner product is at most |a| |i| cos(max(0, T - B)).
A cluster sorts candidates by |i| cos(max(0, T - B)) once; every member walks that list and stops where no later candidate can change its result. The list is cut into buckets of
candidates, so no task holds more than one bucket of it, and whole buckets are left out that no member of a cluster still needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.batches import by_key
from tessera.session import materialize

#: Rows that cluster centres are fitted on; all rows are assigned, bounded and walked.
SAMPLE, ROUNDS = 4096, 8
#: Candidates of a bucket and anchors of a block, about. More rows of a cell are several buckets or blocks.
BUCKET, BLOCK = 16384, 512
#: Candidates of a list that members walk between two tests of their bounds.
STEP = 1024
#: Centres at most, and anchors that one more centre is taken for.
CENTRES, ANCHORS = 64, 64
#: Products of doubles are exact below this.
_EXACT = 2.0**52
_LONG = (1 << 63) - 1
#: Added to each cosine of a bound: angles near 0 are exact to about 2e-8.
_SLACK = 1e-7
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepare(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, vector: the rows that take part, with their labels after seeded noise and their components as whole numbers, floor(256 x)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # rint leaves a whole double as it is; floor of Spark would give a long, which great numbers don't fit
    whole = F.transform("vector", lambda x: F.rint(x * 256) - (F.rint(x * 256) > x * 256).cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.alias("label"), whole.alias("vector"))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows padded with zeros to dims; a shorter vector has no more components to multiply."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(flat) else []] = flat
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    high = np.abs(x).max(axis=1, initial=0)
    safe = np.where(high > 0, high, 1)
    return np.sqrt(((x / safe[:, None]) ** 2).sum(axis=1)) * high


def _angles(x: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of rows to centres of length 1; 0 for zero vectors."""
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    return np.where(norms[:, None] > 0, np.arccos(np.clip(unit @ centres.T, -1, 1)), 0.0)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: by doubles where every partial sum is, else by Python's integers; products beyond a long stay at its end."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < _EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    rows = [[max(-_LONG, min(_LONG, sum(x * y for x, y in zip(r, s, strict=True)))) for s in right] for r in left]
    return np.array(rows, np.int64).reshape(len(a), len(b))


def fit_centres(sample: np.ndarray, count: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample: centres of length 1."""
    norms = _norms(sample)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    centres = unit[np.random.default_rng(seed).permutation(len(unit))[:count]]
    for _ in range(ROUNDS):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = _norms(sums)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


class _Best:
    """For each slot the first `keep` finds by (score descending, id ascending)."""

    def __init__(self, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.slot, self.score, self.vec, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.least = np.full(slots, -_LONG - 1)

    def add(self, slot: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, vec, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.vec, vec), (self.row, row)))
        order = np.lexsort((row, vec, -score, slot))
        place = np.arange(len(order)) - np.searchsorted(slot[order], slot[order])
        order = order[place < self.keep]
        self.slot, self.score, self.vec, self.row = slot[order], score[order], vec[order], row[order]
        last = np.flatnonzero(place[place < self.keep] == self.keep - 1)
        self.least[self.slot[last]] = self.score[last]  # from a full slot's last find on


def share_list(found: dict[str, np.ndarray], centre: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The list of a cluster over one bucket: places in order, and for each place the greatest product that it or a later one can have with an anchor of length 1."""
    bound = found["norm"] * (np.cos(np.clip(found["angles"][:, centre] - radius, 0, np.pi)) + _SLACK)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


def _walk(anchors: dict[str, np.ndarray], found: dict[str, np.ndarray], shared: tuple[np.ndarray, np.ndarray], keep: int, positives: bool) -> tuple[_Best, int]:
    """Walk one bucket's list for one block of anchors: the best finds of each slot, and the number of products taken.

    Slots are anchors, or for negatives (anchor, positive) pairs: slot_anchor, high (the positive's score) and low (the least score that would still change the result).
    """
    order, bound = shared
    slot_anchor, high, need = anchors["slot_anchor"], anchors["high"], anchors["low"].copy()
    best, taken = _Best(len(need), keep), 0
    for start in range(0, len(order), STEP):
        reach = anchors["norm"] * bound[start] + 1
        awake = np.flatnonzero(reach[slot_anchor] >= need)
        if not len(awake):
            break
        members = np.unique(slot_anchor[awake])
        some = order[start : start + STEP]
        scores = _scores(anchors["x"][members], found["x"][some])
        taken += scores.size
        fit = anchors["label"][members][:, None] == found["label"][some][None, :]
        fit = fit & (anchors["row"][members][:, None] != found["row"][some][None, :]) if positives else ~fit
        at = np.searchsorted(members, slot_anchor[awake])
        for part in range(0, len(awake), 256):
            rows, own = at[part : part + 256], awake[part : part + 256]
            here = scores[rows]
            r, c = np.nonzero(fit[rows] & (here >= need[own, None]) & (here <= high[own, None]))
            best.add(own[r], here[r, c], found["vec_id"][some][c], found["row"][some][c])
        need = np.maximum(need, best.least)
    return best, taken


def _columns(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns of longs and doubles; null ids come last, as no id is greater."""
    return {c: (column.fill_null(_LONG) if (column := table.column(c).combine_chunks()).null_count else column).to_numpy() for c in names}


def _visit(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, centres: np.ndarray, keep: int, positives: bool) -> DataFrame:
    """Walk every (block, bucket) of pairs: row (the anchor's), place (of its slot), score, vec_id, found (row of the find)."""
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = ("row", "vec_id", "label", "norm")
    none = F.lit(None).cast("array<long>")
    here = candidates.join(pairs.select("bucket").distinct(), "bucket", "left_semi")
    here = here.select("bucket", F.lit(-1).cast("long").alias("block"), *named, "vector", F.lit(0.0).alias("radius"), none.alias("lows"), none.alias("highs"))
    there = anchors.join(pairs, "block").select("bucket", "block", *named, "vector", "radius", "lows", "highs")
    dealt = here.unionByName(there).repartition(n, "bucket").sortWithinPartitions("bucket", "block")
    dims = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lists = {}, {}
        for group in by_key(batches, 2):
            block = group.column("block")[0].as_py()
            have = _columns(group, named) | {"x": _matrix(group.column("vector"), dims)}
            if block < 0:
                found, lists = have | {"angles": _angles(have["x"], have["norm"], centres)}, {}
                continue
            cell = block >> 32
            if cell not in lists:
                lists = {cell: share_list(found, cell, group.column("radius")[0].as_py())}  # blocks come in the order of their cells
            counts = group.column("lows").combine_chunks().value_lengths().to_numpy()
            have |= {"slot_anchor": np.repeat(np.arange(len(counts)), counts)}
            have |= {c: group.column(f"{c}s").combine_chunks().flatten().to_numpy() for c in ("low", "high")}
            place = np.arange(len(have["low"])) - np.repeat(np.cumsum(counts) - counts, counts)
            best, _ = _walk(have, found, lists[cell], keep, positives)
            vec = pa.array(best.vec, pa.int64(), mask=best.vec == _LONG)
            yield pa.RecordBatch.from_arrays([pa.array(have["row"][have["slot_anchor"][best.slot]]), pa.array(place[best.slot]), pa.array(best.score), vec, pa.array(best.row)], names=["row", "place", "score", "vec_id", "found"])

    return dealt.mapInArrow(run, "row long, place long, score long, vec_id long, found long")


def _ranked(finds: DataFrame, keep: int) -> DataFrame:
    """The first `keep` finds of each slot with their rank; each visit has given at most as many, and Spark limits each group before the shuffle."""
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found")
    return finds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def _search(anchors: DataFrame, candidates: DataFrame, bounds: DataFrame, centres: np.ndarray, keep: int, positives: bool) -> DataFrame:
    """row, place, score, vec_id, found, rank: the first `keep` finds of every slot of anchors (lows, highs).

    Each block first walks the bucket of its greatest bound; what it finds raises the least scores that still count, and of the other buckets only those are walked whose
    bound reaches one of them.
    """
    top = bounds.groupBy("block").agg(F.max_by("bucket", F.struct("bound", "bucket")).alias("bucket"))
    first = materialize(_ranked(_visit(anchors, candidates, top, centres, keep, positives), keep), "first-finds")
    full = first.where(F.col("rank") == keep).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("place", "score"))).alias("least"))  # a score for each slot
    after = anchors.join(full, "row", "left")
    higher = F.transform("lows", lambda x, i: F.greatest(x, F.try_element_at("least", i.cast("long"))))
    after = after.withColumn("lows", F.when(F.col("least").isNull(), F.col("lows")).otherwise(higher)).drop("least")
    need = after.groupBy("block").agg(F.min(F.array_min("lows").cast("double")).alias("need"), F.max("norm").alias("norm"))
    reach = F.greatest(F.col("bound"), F.lit(0.0)) * F.col("norm") * (1 + 1e-6) + 1  # a bound below 0 would need the shortest anchor
    rest = bounds.join(top.withColumnRenamed("bucket", "done"), "block").where("bucket <> done").join(need, "block").where(reach >= F.col("need")).select("block", "bucket")
    more = _visit(after, candidates, materialize(rest, "rest"), centres, keep, positives)
    return materialize(_ranked(more.unionByName(first.drop("rank")), keep), "finds")


def _bounds(candidates: DataFrame, radii: DataFrame, centres: np.ndarray) -> DataFrame:
    """cell, bucket, bound: the greatest |i| cos(max(0, T - B)) of a bucket for each cluster; batches are summed up first."""
    radius = {r["cell"]: r["radius"] for r in radii.collect()}  # one for each centre at most
    cells = np.array(sorted(radius))
    width, dims = np.array([radius[c] for c in cells.tolist()]), centres.shape[1]

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, norm = (batch.column(k).to_numpy() for k in (0, 2))
            bound = norm[:, None] * (np.cos(np.clip(_angles(_matrix(batch.column(1), dims), norm, centres[cells]) - width, 0, np.pi)) + _SLACK)
            names, where = np.unique(bucket, return_inverse=True)
            out = np.full((len(names), len(cells)), -np.inf)
            np.maximum.at(out, where, bound)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(cells, len(names))), pa.array(np.repeat(names, len(cells))), pa.array(out.ravel())], names=["cell", "bucket", "bound"])

    found = candidates.select("bucket", "vector", "norm").mapInArrow(most, "cell long, bucket long, bound double")
    return found.groupBy("cell", "bucket").agg(F.max("bound").alias("bound"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of vectors (vec_id, embedding, label), the rows whose vec_id is divisible by `every`.

    An anchor's positives are its first other rows of the same label; a positive's negatives the first rows of other labels whose score is 80 to 100 hundredths of the
    positive's. Where these are fewer, all are returned; a positive without one has no row. Scores are exact inner products of whole numbers (one beyond a long
    stays at its end). Rows with a null label, a null vector, or a null or non-finite component take no part; zero and empty vectors do, and a shorter vector is multiplied as
    far as it goes. Rows that repeat an id are rows of their own; null ids are never anchors and come last among equal scores. An empty table gives an empty result;
    extra columns are left out.

    Centres are fitted on a bounded sample. The rows of a centre's cell, however many, are dealt to buckets and blocks of bounded size.
    """
    spark = vectors.sparkSession
    rows = materialize(prepare(vectors), "prepared")
    is_anchor = F.pmod("vec_id", F.lit(every)) == 0
    heads, dims = rows.agg(F.count(F.when(is_anchor, 1)), F.max(F.size("vector"))).first()
    if not heads:
        return spark.createDataFrame([], RESULT)
    dims = max(dims, 1)
    sample = rows.select("row", "vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    centres = fit_centres(_matrix(sample.column("vector"), dims), int(np.clip(heads // ANCHORS, 1, CENTRES)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), dims)
            norms = _norms(x)
            angles = _angles(x, norms, centres)
            cell = angles.argmin(axis=1)
            columns = [*batch.columns, pa.array(norms), pa.array(cell.astype(np.int64)), pa.array(angles[np.arange(len(x)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "label", "vector", "norm", "cell", "angle"])

    placed = materialize(rows.mapInArrow(place, "row long, vec_id long, label long, vector array<double>, norm double, cell long, angle double"), "placed")
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.count("*") / BUCKET).alias("buckets"), F.ceil(F.count(F.when(is_anchor, 1)) / BLOCK).alias("blocks"), F.max(F.when(is_anchor, F.col("angle"))).alias("radius")
    )
    sizes = materialize(sizes, "cells")  # a row for each centre at most
    dealt = placed.join(F.broadcast(sizes), "cell")
    part = lambda name: F.shiftleft("cell", 32) + F.pmod(F.xxhash64("row"), F.greatest(F.col(name), F.lit(1)))
    candidates = dealt.select(part("buckets").alias("bucket"), "row", "vec_id", "label", "vector", "norm")
    anchors = materialize(dealt.where(is_anchor).select("cell", part("blocks").alias("block"), "row", "vec_id", "label", "vector", "norm", "radius"), "anchors")
    bounds = _bounds(candidates, sizes.where("radius IS NOT NULL").select("cell", "radius"), centres)
    bounds = materialize(bounds.join(F.broadcast(anchors.select("cell", "block").distinct()), "cell").select("block", "bucket", "bound"), "bounds")

    open_slot = anchors.withColumn("lows", F.array(F.lit(-_LONG - 1))).withColumn("highs", F.array(F.lit(_LONG)))
    near = _search(open_slot, candidates, bounds, centres, positives, positives=True)
    near = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("positives"))  # at most `positives` each
    low = F.expr(f"transform(positives, p -> if(p.score < 0, {_LONG}L, p.score - p.score div 5))")  # no negative reaches 80 hundredths of a score below 0 from below
    ranged = materialize(anchors.join(near, "row").withColumn("highs", F.transform("positives", lambda p: p["score"])).withColumn("lows", low), "ranged")
    far = _search(ranged.drop("positives"), candidates, bounds, centres, negatives, positives=False)
    slots = ranged.select("row", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("place", "p")).withColumn("place", F.col("place").cast("long"))
    joined = far.withColumnRenamed("vec_id", "negative_id").join(slots, ["row", "place"])
    return joined.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
