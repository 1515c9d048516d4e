"""Exact n-gram Jaccard join in a metric space (operator 3).

Jaccard distance is a metric, and two sets link when their distance is at most r = 1 - threshold. Nearly all distances between documents
are 1, so pivots drawn from all documents would put every document in every window. Hence the join first finds cells:

* A partition of the shingles gives regions of sets that may link: a set of a given size class is cut by hash into m parts, more than
  the largest symmetric difference that a link allows, so linked sets agree on at least one part that isn't empty. Sets that agree on
  enough parts, and the members of large regions, are candidates; the components of the candidates are the cells, and no link leaves one.
* Each set is sent once, to its cell. There pivots create Voronoi regions: a set belongs to its nearest pivot, and it is replicated to the
  region of pivot i if d(x, i) - d(x, own) <= 2 r, which by the triangle inequality holds for every set that may link into that region.
  Regions are split again around pivots of their own until few sets are left. Sets within r of a pivot are linked with it at once, so
  regions of one component are done; candidates a, b with |d(a, p) - d(b, p)| > r for a pivot p are left out; the others are compared whole.
* A cell that is too large for one task's memory is joined by shuffles: its candidate pairs by their distances, its large regions in
  rings of width r around a pivot, block by block.

Equal sets are one node throughout, and large regions list no pairs, so neither copies nor near copies make all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import by_key, least_label
from tessera.llm.graph import components
from tessera.llm.words import as_fraction, columns_of, integer_ids, mix, set_sums, shingle_sets, text_chunks
from tessera.session import materialize

#: Nodes of one region within one task's buffer from which on they skip the global meeting of parts.
CROWD = 64
#: Parts that a task gathers before it deals them out, and the part of them that are buffered for a deal.
BUFFER = 1_500_000
#: Up to so many wanted documents their ids are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members up to which a region lists its pairs; the members of larger ones meet in a cell.
SMALL = 128
#: Sets and shingles of the largest cell that one task joins (64 MB of hashes); larger cells are joined by shuffles, in blocks of BLOCK sets.
CELL_SETS, CELL_SHINGLES, BLOCK = 16_384, 8_000_000, 2048
#: Sets of a Voronoi region that is split no further, pivots of a split, and what a split may grow by.
LEAF, PIVOTS, GROWTH, DEPTH = 8, 6, 1.2, 12
#: Shingles of one matrix product, products whose shingles are laid out at once, and shingles that are sorted at once.
COLUMNS, WIDE, SLICE = 512, 64, 1 << 20
_SALT = np.uint64(0x2545F4914F6CDD1D)


class Parts:
    """How many parts a set of n shingles is cut into, for its own size class and for the one below.

    Sizes of linked sets differ at most by the factor 1 / threshold, so they are in one class or in neighbouring ones. For
    the class with sizes up to s a pair's symmetric difference is at most D = (1 - t) / (1 + t) * (s + floor(s / t)). With
    m = D + spare parts, two sets agree on a part that isn't empty unless both have spare or more empty parts; those
    few, which are called sparse, are also dealt to regions of their empty parts.
    """

    def __init__(self, threshold: Fraction, largest: int = 1):
        self.threshold, self.bounds = threshold, [1, 2]
        self.parts: list[int] = []
        self.spare: list[int] = []
        self.grow(largest)

    def grow(self, largest: int) -> None:
        t = self.threshold
        while self.bounds[-1] <= largest or len(self.parts) < len(self.bounds) - 1:
            if len(self.parts) == len(self.bounds) - 1:
                self.bounds.append(max(self.bounds[-1] + 1, int((self.bounds[-1] - 1) / t) + 1))
            s = self.bounds[len(self.parts) + 1] - 1
            differ = int((1 - t) / (1 + t) * (s + int(s / t)))
            spare = 4 + -(-3 * differ // 100)
            self.parts.append(differ + spare if differ else 0)
            self.spare.append(spare)

    def of(self, sizes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scheme (class - below), its parts and spare for each size; 0 parts where there is no such scheme."""
        self.grow(int(sizes.max(initial=1)))
        scheme = np.searchsorted(np.array(self.bounds), sizes, "right") - 1 - below
        safe = np.maximum(scheme, 0)
        parts = np.where((scheme >= 0) & (sizes > 0), np.array(self.parts)[np.minimum(safe, len(self.parts) - 1)], 0)
        return scheme, parts, np.array(self.spare)[np.minimum(safe, len(self.spare) - 1)]


def _node(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit name for each set; rows of empty sets get 0."""
    sizes = np.diff(bounds)
    nodes = np.zeros(len(sizes), np.uint64)
    if len(values):
        nodes[sizes > 0] = mix(set_sums(values, bounds[:-1][sizes > 0]) + sizes[sizes > 0].astype(np.uint64))
    return nodes


def _regions(values: np.ndarray, bounds: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """(region, row) for every part of every set; a region's name is a hash of scheme, part and the shingles in it."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    regions, rows = [], []
    for below in (0, 1):
        scheme, m, spare = parts.of(sizes, below)
        each = m[row].astype(np.uint64)
        live = each > 0
        v, r = values[live], row[live]
        if not len(v):
            continue
        part = ((v >> np.uint64(32)) * each[live]) >> np.uint64(32)
        new = np.ones(len(v), bool)
        new[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        name = (scheme[r[at]].astype(np.uint64) << np.uint64(32)) + part[at]
        regions.append(mix(set_sums(v, at) + mix(name + _SALT)))
        rows.append(r[at])
        filled = np.bincount(r[at], minlength=len(sizes))
        for sparse in np.flatnonzero((m > 0) & (m - filled >= spare)):
            mine = part[at][r[at] == sparse].astype(np.int64)
            empty = np.setdiff1d(np.arange(m[sparse]), mine).astype(np.uint64)
            regions.append(mix(mix((np.uint64(scheme[sparse]) << np.uint64(32)) + empty + _SALT) ^ _SALT))
            rows.append(np.full(len(empty), sparse))
    if not regions:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(regions), np.concatenate(rows)


def shingle_nodes(docs: DataFrame, k: int, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, node (null without words) for each row with an id; with hashed also text_hash, which tells rows of one id apart."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_chunks(batch.column(1)):
                values, bounds = shingle_sets(data, offsets, k)
                node = _node(values, bounds)
                sizes = np.diff(bounds)
                nodes = pa.array(node.view(np.int64), mask=sizes == 0)
                keys = [batch.column(2).slice(low, high - low)] if hashed else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes), nodes, *keys], names=names)

    names = ["doc_id", "n_shingles", "node", *["text_hash"][: int(hashed)]]
    rows = docs.where("doc_id is not null").select("doc_id", "text", *[F.xxhash64("text").alias(x) for x in names[3:]])
    return rows.mapInArrow(digest, ", ".join(f"{x} long" for x in names))


def region_members(docs: DataFrame, k: int, threshold: Fraction, partitions: int) -> DataFrame:
    """region, node for all regions with two nodes or more.

    A task deals its parts out as blocks of bytes, one for each target, and names a set of equal nodes once. Where CROWD
    or more of its nodes share a region it passes them on as members at once, spread over all targets, and sends only one
    to the region's meeting; so a region gathers at most CROWD nodes from each task, however many documents share it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, count = Parts(threshold), [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                values, bounds = shingle_sets(data, offsets, k)
                regions, rows = _regions(values, bounds, parts)
                held.append((regions, _node(values, bounds)[rows]))
                count += len(regions)
                if count >= BUFFER:
                    yield from _dealt(held, partitions)
                    held, count = [], 0
        if held:
            yield from _dealt(held, partitions)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for target, met, region, node, runs in zip(*batch.columns, strict=True):
                region = _unpacked(region.as_buffer(), target.as_py(), partitions)
                node = np.repeat(np.frombuffer(node.as_buffer(), np.uint64), np.frombuffer(runs.as_buffer(), np.uint32))
                if met.as_py():
                    held[0].append(region)
                    held[1].append(node)
                else:
                    yield _members(region, node)
        if held[0]:
            region, node = _unique(np.concatenate(held[0]), np.concatenate(held[1]))
            same = region[1:] == region[:-1]
            shared = np.zeros(len(region), bool)
            shared[1:] |= same
            shared[:-1] |= same
            yield _members(region[shared], node[shared])

    dealt = docs.select("text").mapInArrow(deal, "target long, meets int, regions binary, nodes binary, runs binary")
    return dealt.repartition(partitions, "target").mapInArrow(meet, "region long, node long")


def _members(region: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(node.view(np.int64))], names=["region", "node"])


def _unique(region: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending by region, equal pairs once."""
    order = np.lexsort((node, region))
    region, node = region[order], node[order]
    fresh = np.ones(len(region), bool)
    fresh[1:] = (region[1:] != region[:-1]) | (node[1:] != node[:-1])
    return region[fresh], node[fresh]


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], partitions: int) -> Iterator[pa.RecordBatch]:
    region, node = _unique(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    if not len(region):
        return
    starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(region)])))
    crowded = np.repeat(sizes >= CROWD, sizes)
    leader = np.zeros(len(region), bool)
    leader[starts] = True
    meets = ~crowded | leader
    # Members of crowded regions meet nobody, so any target will do; those of one region and residue keep a residue of their own.
    residue = region % np.uint64(partitions)
    for met, chosen in ((1, meets), (0, crowded)):
        if not chosen.any():
            continue
        r, n, to = region[chosen], node[chosen], residue[chosen].astype(np.int64)
        spread = np.zeros(len(r), np.int64) if met else (mix(n + r) % np.uint64(partitions)).astype(np.int64) + 1
        order = np.lexsort((n, spread, to))
        r, n, to, spread = r[order], n[order], to[order], spread[order]
        key = spread * partitions + to
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for low, high in zip(cut, [*cut[1:], len(key)], strict=True):
            run = np.flatnonzero(np.concatenate(([True], n[low + 1 : high] != n[low : high - 1])))
            runs = np.diff(np.concatenate((run, [high - low]))).astype(np.uint32)
            blobs = [pa.array([x.tobytes()]) for x in (_packed(r[low:high]), n[low:high][run], runs)]
            yield pa.RecordBatch.from_arrays([pa.array([int(key[low])], pa.int64()), pa.array([met], pa.int32()), *blobs], names=["target", "meets", "regions", "nodes", "runs"])


def _packed(regions: np.ndarray) -> np.ndarray:
    """The upper five bytes of each name."""
    return regions.view(np.uint8).reshape(-1, 8)[:, 3:]


def _unpacked(packed: pa.Buffer, target: int, partitions: int) -> np.ndarray:
    """Names of regions from their upper five bytes and the residue that all of a block have; two regions that fall together cost false candidates only."""
    names = np.zeros((packed.size // 5, 8), np.uint8)
    names[:, 3:] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return names.reshape(-1).view(np.uint64) + np.uint64(target % partitions)


def _sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """cell, node, shingles (ascending 64-bit hashes as bytes) for the wanted nodes; wanted: node, doc_id (one document of each), cell.

    Texts are read where they lie; only where there are more wanted documents than fit a broadcast they are moved. A row that repeats
    both id and text of a wanted document repeats its set.
    """
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    found = docs.select("doc_id", "text").join(near.select("doc_id", "cell", "node"), "doc_id").select("cell", "node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in text_chunks(batch.column(2)):
                values, bounds = shingle_sets(data, offsets, k)
                mine = np.flatnonzero(_node(values, bounds).view(np.int64) == batch.column(1).slice(start, stop - start).to_numpy())
                blobs = [values[bounds[i] : bounds[i + 1]].tobytes() for i in mine]
                chosen = pa.array(mine + start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(blobs, pa.binary())], names=["cell", "node", "shingles"])

    return found.mapInArrow(read, "cell long, node long, shingles binary")


def _heads(sets: DataFrame) -> DataFrame:
    """node, shingles: the sets with the upper 16 bits of each shingle only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(48)).astype(np.uint16).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["node", "shingles"])

    return sets.select("node", "shingles").mapInArrow(cut, "node long, shingles binary")


def _overlap(x: pa.Buffer, y: pa.Buffer, kind: type) -> tuple[int, int]:
    x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
    merged = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return shared, len(merged) - shared


def _distances(pairs: DataFrame, sets: DataFrame, kind: type = np.uint64) -> DataFrame:
    """a, b, both, either for the pairs (a, b): exact sizes of intersection and union.

    With heads (kind np.uint16) equal neighbours in the merged order count what the sets share or more: bounds from above and below.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([_overlap(x.as_buffer(), y.as_buffer(), kind) for x, y in zip(batch.column(2), batch.column(3), strict=True)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes[:, 0]), pa.array(sizes[:, 1])], names=["a", "b", "both", "either"])

    first = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    joined = first.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(measure, "a long, b long, both long, either long")


def _apart(values: list[np.ndarray], root: np.ndarray, t: Fraction) -> np.ndarray:
    """Places of the sets that may link with one of another root: a part of t of their shingles lies in such sets too. Those of others go, until few do; the work is in proportion to the shingles."""
    live = np.arange(len(values))
    while len(live):
        sizes = np.array([len(values[i]) for i in live], np.int64)
        flat, owner = np.concatenate([values[i] for i in live]), np.repeat(np.arange(len(live), dtype=np.int32), sizes)
        slices = -(-len(flat) // SLICE)
        shared = np.zeros(len(live), np.int64)
        for k in range(slices):
            some = slice(None) if slices == 1 else np.flatnonzero(((flat >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32) == np.uint64(k))
            names, mine = flat[some], owner[some]
            if not len(names):
                continue
            order = np.argsort(names, kind="stable")
            names, mine = names[order], mine[order]
            starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            roots = root[live[mine]]
            several = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
            shared += np.bincount(mine[np.repeat(several, np.diff(np.append(starts, len(names))))], minlength=len(live))
        stay = shared * t.denominator >= sizes * t.numerator
        before, live = len(live), live[stay]
        if 10 * len(live) > 9 * before:
            break
    return live


def _intersections(rows: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as matrix products over some hundred shingles at a time; only those of the side with fewer can be shared."""
    every = np.unique(np.concatenate(min(rows, columns, key=lambda side: sum(map(len, side)))))
    out = np.zeros((len(rows), len(columns)), np.float32)
    for first in range(0, len(every), WIDE * COLUMNS):
        block = every[first : first + WIDE * COLUMNS]
        held = []
        for side in (rows, columns):
            parts = [values[np.searchsorted(values, block[0]) : np.searchsorted(values, block[-1], "right")] for values in side]
            flat, owner = np.concatenate(parts), np.repeat(np.arange(len(side), dtype=np.int32), [len(x) for x in parts])
            at = np.searchsorted(block, flat).astype(np.int32)
            hit = block[at] == flat
            order = np.argsort(at[hit], kind="stable")
            held.append((at[hit][order], owner[hit][order], len(side)))
        for low in range(0, len(block), COLUMNS):
            sides = []
            for at, owner, n in held:
                some = slice(*np.searchsorted(at, (low, low + COLUMNS)))
                flags = np.zeros((n, min(COLUMNS, len(block) - low)), np.float32)
                flags[owner[some], at[some] - low] = 1
                sides.append(flags)
            out += sides[0] @ sides[1].T
    return out


def _ring_links(members: DataFrame, sets: DataFrame, t: Fraction, partitions: int) -> DataFrame:
    """a, b: links that join the components within large regions; members: region, node, root (so far), distance (to the pivot), n.

    Rings of width r around the pivot are the windows of the triangle inequality: linked sets lie in one ring or in
    neighbouring ones. A cell joins a ring (rows) with itself and the ring beyond (columns), so a set is replicated to its
    own ring's cell and, if that has sets of its own, to the one within. Cells of regions of more than BLOCK sets are cut to BLOCK by BLOCK; all pairs of
    a cell that _apart leaves are compared by matrix products, links within a root are known, and only one link for each set, to the least of its component in the cell, leaves the task.
    """
    ring = F.floor(F.col("distance") / (float(1 - t) * (1 + 1e-9))).cast("int")  # a hair wider, for rounding
    base = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("ring", ring)
    base = base.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rings = base.groupBy("region").agg(F.collect_set("ring").alias("rings"))  # 1 / r + 1 of them at most
    base = base.join(rings, "region").withColumn("lows", F.when(F.array_contains("rings", F.col("ring") - 1), F.array(F.lit(-1), F.lit(0))).otherwise(F.array(F.lit(0))))
    # Rows: the own ring's sets, in their block. Columns: sets of both rings. A set that is both comes once, with side 2.
    cells = F.expr(
        "flatten(transform(lows, l -> flatten(transform(sequence(0, blocks - 1), i -> filter(array("
        "struct(ring + l as low, i as i, own as j, if(l = 0 and i = own, 2, 1) as side), "
        "struct(ring as low, own as i, i as j, 0 as side)), "
        "c -> c.side > 0 or (l = 0 and i != own))))))"
    )
    cells = base.select("region", "node", "root", F.explode(cells).alias("c")).select("region", "c.low", "c.i", "c.j", "c.side", "node", "root")
    filled = cells.join(sets, "node").select("region", "low", "i", "j", "side", "node", "root", "shingles")
    dealt = filled.repartition(partitions, "region", "low", "i", "j").sortWithinPartitions("region", "low", "i", "j")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 4):
            side, node, root = (group.column(x).to_numpy() for x in ("side", "node", "root"))
            values = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
            some = _apart(values, root, t)
            side, node, root, values = side[some], node[some], root[some], [values[i] for i in some]
            rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both
            if not len(rows) or not len(columns):
                continue
            sizes = np.array([len(v) for v in values], np.int32)
            both = _intersections([values[i] for i in rows], [values[i] for i in columns]).astype(np.int32)
            either = sizes[rows][:, None] + sizes[columns][None] - both
            near = (both * t.denominator >= either * t.numerator) & (root[rows][:, None] != root[columns][None])
            x, y = np.nonzero(near)
            names, at = np.unique(node, return_inverse=True)
            x, y = at[rows[x]], at[columns[y]]
            label = least_label(len(names), x, y)
            chosen = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[chosen]), pa.array(names[label[chosen]])], names=["a", "b"])

    return dealt.mapInArrow(link, "a long, b long")


class _Cell:
    """The sets of one cell, joined around pivots; root[i] is the least set that links reach from set i."""

    def __init__(self, values: list[np.ndarray], t: Fraction):
        self.values, self.t, self.r = values, t, float(1 - t) * (1 + 1e-9)  # a hair wider, for rounding
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.root = np.arange(len(values))
        self.measured = 0

    def unite(self, some: np.ndarray) -> None:
        roots = np.unique(self.root[some])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots[1:])] = roots[0]

    def near(self, both: np.ndarray, either: np.ndarray) -> np.ndarray:
        return both * self.t.denominator >= either * self.t.numerator

    def distances(self, pivots: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Distances of some sets (columns) to the pivots (rows); those within r are linked."""
        flat, starts = np.concatenate([self.values[i] for i in some]), np.concatenate(([0], np.cumsum(self.sizes[some])[:-1]))
        out = np.empty((len(pivots), len(some)))
        for row, pivot in enumerate(pivots):
            own = self.values[pivot]
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            both = np.add.reduceat(hit, starts, dtype=np.int64)
            either = self.sizes[some] + len(own) - both
            out[row] = 1 - both / either
            self.unite(some[self.near(both, either)])
        self.measured += out.size
        return out

    def join(self, some: np.ndarray, pairs: np.ndarray, groups: list[np.ndarray], depth: int = 0) -> None:
        """Link all that may link among some sets: the listed pairs, and any two sets of one group."""
        pairs = pairs[self.root[pairs[:, 0]] != self.root[pairs[:, 1]]]
        groups = [g for g in groups if len(g) > 1 and (self.root[g] != self.root[g[0]]).any()]
        if not len(pairs) and not groups:
            return
        if len(some) <= LEAF or depth == DEPTH:
            return self.compare(pairs, groups)
        pivots = some[np.unique(np.linspace(0, len(some) - 1, PIVOTS).astype(int))]
        away = self.distances(pivots, some)
        own = away.argmin(axis=0)
        least = away[own, np.arange(len(some))]
        place = np.full(len(self.values), -1)
        place[some] = np.arange(len(some))
        x, y = place[pairs[:, 0]], place[pairs[:, 1]]
        pairs = pairs[(np.abs(away[:, x] - away[:, y]) <= self.r).all(axis=0)]
        home = np.minimum(own[place[pairs[:, 0]]], own[place[pairs[:, 1]]])  # a pair meets in the region of the first of its two pivots
        inside = [(own == i) | ((own > i) & (away[i] - least <= 2 * self.r)) for i in range(len(pivots))]
        inside = [x if (own == i).any() else np.zeros(len(some), bool) for i, x in enumerate(inside)]
        total = sum(int(x.sum()) for x in inside)
        if total > GROWTH * len(some) or max(int(x.sum()) for x in inside) > 0.9 * len(some):
            return self.compare(pairs, groups)  # pivots tell these sets apart no further
        for i, chosen in enumerate(inside):
            if chosen.any():
                held = pairs[(home == i) & chosen[place[pairs]].all(axis=1)]
                self.join(some[chosen], held, [g[chosen[place[g]]] for g in groups], depth + 1)

    def compare(self, pairs: np.ndarray, groups: list[np.ndarray]) -> None:
        for i, j in pairs:
            if self.root[i] != self.root[j]:
                merged = np.sort(np.concatenate((self.values[i], self.values[j])), kind="stable")
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if self.near(np.int64(both), np.int64(len(merged) - both)):
                    self.unite(np.array([i, j]))
        for group in groups:
            if (self.root[group] == self.root[group[0]]).all():
                continue
            group = group[_apart([self.values[i] for i in group], self.root[group], self.t)]
            if not len(group):
                continue
            _, at, counts = np.unique(self.root[group], return_inverse=True, return_counts=True)
            fewer = group[at != counts.argmax()]  # every pair of different components has a set outside the largest one
            fewer = fewer[np.argsort(self.sizes[fewer], kind="stable")]
            for low in range(0, len(fewer), 256):
                rows = fewer[low : low + 256]
                smaller = self.sizes[group] * self.t.denominator < self.sizes[rows[0]] * self.t.numerator
                larger = self.sizes[group] * self.t.numerator > self.sizes[rows[-1]] * self.t.denominator
                columns = group[~smaller & ~larger]
                both = _intersections([self.values[i] for i in rows], [self.values[i] for i in columns]).astype(np.int64)
                x, y = np.nonzero(self.near(both, self.sizes[rows][:, None] + self.sizes[columns][None] - both) & (self.root[rows][:, None] != self.root[columns][None]))
                for i, j in zip(rows[x], columns[y], strict=True):
                    if self.root[i] != self.root[j]:
                        self.unite(np.array([i, j]))


def _cell_roots(cells: DataFrame, sets: DataFrame, pairs: DataFrame, large: DataFrame, t: Fraction, partitions: int) -> DataFrame:
    """node, root for the linked nodes of cells that one task can hold; cells: node, cell. pairs: a, b. large: region, node (regions that list no pairs)."""
    none = F.lit(None).cast("binary")
    of_pairs = pairs.join(cells.select(F.col("node").alias("a"), "cell"), "a").select("cell", F.lit(1).alias("kind"), "a", "b", none.alias("shingles"))
    of_large = large.join(cells, "node").select("cell", F.lit(2).alias("kind"), F.col("region").alias("a"), F.col("node").alias("b"), none.alias("shingles"))
    of_sets = sets.select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "shingles")
    dealt = of_sets.unionByName(of_pairs).unionByName(of_large).repartition(partitions, "cell").sortWithinPartitions("cell")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, 1):
            kind, a, b = (group.column(x).to_numpy() for x in ("kind", "a", "b"))
            nodes, first = np.unique(a[kind == 0], return_index=True)
            blobs = group.column("shingles")
            cell = _Cell([np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in np.flatnonzero(kind == 0)[first]], t)
            pairs = np.stack([np.searchsorted(nodes, x[kind == 1]) for x in (a, b)], axis=1)
            region, member = a[kind == 2], np.searchsorted(nodes, b[kind == 2])
            order = np.argsort(region, kind="stable")
            groups = np.split(member[order], np.flatnonzero(np.diff(region[order])) + 1) if len(order) else []
            cell.join(np.arange(len(nodes)), pairs, groups)
            linked = np.bincount(cell.root, minlength=len(nodes))[cell.root] > 1
            yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[cell.root[linked]])], names=["node", "root"])

    return dealt.mapInArrow(link, "node long, root long")


def _shuffled_roots(cells: DataFrame, sets: DataFrame, pairs: DataFrame, large: DataFrame, t: Fraction, partitions: int) -> DataFrame:
    """node, root as above for cells beyond one task's memory; large: region, pivot, node."""
    linked = F.col("both") * t.denominator >= F.col("either") * t.numerator
    sets = materialize(sets.select("node", "shingles").dropDuplicates(["node"]), "sets")
    pairs = pairs.join(cells.select(F.col("node").alias("a")), "a", "left_semi")
    large = large.join(cells.select("node"), "node", "left_semi")
    # Heads are a quarter of the sets; only pairs that they don't tell apart move whole ones.
    pairs = materialize(_distances(pairs, _heads(sets), np.uint16).where(linked).select("a", "b"), "near-pairs")
    links = _distances(pairs, sets).where(linked).select("a", "b")
    # Large regions: every set and the pivots. The pivots have then met everyone, and leave.
    large = large.where("node != pivot")
    star = large.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    measured = materialize(_distances(star, sets), "distances")
    roots = components(links.unionByName(measured.where(linked).select("a", "b")), "a", "b")
    distance = measured.select(F.col("a").alias("pivot"), F.col("b").alias("node"), (1 - F.col("both") / F.col("either")).alias("distance"))
    rest = large.select("region", "node", "pivot").join(distance, ["pivot", "node"]).join(roots, "node", "left")
    rest = materialize(rest.select("region", "node", "distance", F.coalesce("root", "node").alias("root")), "rest")
    mixed = rest.groupBy("region").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    mixed = materialize(rest.join(mixed.select("region", "n"), "region"), "mixed")
    ringed = _ring_links(mixed, sets, t, partitions)
    stars = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(materialize(ringed, "ring-links")), "a", "b")


def _listed_pairs(members: DataFrame, sized: DataFrame, t: Fraction) -> DataFrame:
    """a, b (a < b) that share as many parts as a link asks for, over the regions of at most SMALL members: a pair that meets in a larger one is found there.

    sized: node, size, differ. Of the m = D + spare parts of the smaller set's scheme at most d = (1 - t) / (1 + t) * (p + q) differ, and in one of both sets
    fewer than spare are empty, or both are dealt to their empty parts too: so D - d + 1 parts bring linked sets of p and q shingles to one region.
    """
    rows = members.where(F.col("n") <= SMALL).select("region", "node", "weight").join(sized, "node")
    pairs = rows.alias("x").join(rows.alias("y"), (F.col("x.region") == F.col("y.region")) & (F.col("x.node") < F.col("y.node")))
    pairs = pairs.where(F.least("x.size", "y.size") * t.denominator >= F.greatest("x.size", "y.size") * t.numerator)
    ratio = (1 - t) / (1 + t)
    asked = F.least("x.differ", "y.differ") - F.floor((F.col("x.size") + F.col("y.size")) * ratio.numerator / F.lit(ratio.denominator)) + 1
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.weight").alias("weight"), asked.cast("int").alias("asked"))
    return pairs.groupBy("a", "b").agg(F.sum("weight").alias("shared"), F.max("asked").alias("asked")).where("shared >= asked").select("a", "b")


def node_components(docs: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """node, root for every node that is linked with another; rows without an id take no part, or a node could be a text that has no set."""
    t = as_fraction(threshold)
    docs = docs.where("doc_id is not null")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = materialize(region_members(docs, k, t, partitions).distinct(), "regions")
    # Regions with the same members are one region, of the weight of them all.
    summary = members.groupBy("region").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")
    )
    one = summary.groupBy("n", "pivot", "x", "y").agg(F.min("region").alias("region"), F.count("*").alias("weight")).where("n > 1")
    members = materialize(members.join(one.select("region", "n", "pivot", "weight"), "region"), "region-members")
    document = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"))
    wanted = document.join(members.select("node").distinct(), "node", "left_semi").withColumn("differ", _most_unlike(t, nodes))
    wanted = materialize(wanted, "wanted")

    large = members.where(F.col("n") > SMALL)
    star = large.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = materialize(_listed_pairs(members, wanted.select("node", "size", "differ"), t), "pairs")
    cells = components(pairs.unionByName(star), "a", "b").select("node", F.col("root").alias("cell"))
    sizes = cells.join(wanted, "node").groupBy("cell").agg(F.count("*").alias("sets"), F.sum("size").alias("shingles"))
    heavy = (F.col("sets") > CELL_SETS) | (F.col("shingles") > CELL_SHINGLES)
    cells = materialize(cells.join(wanted.select("node", "doc_id"), "node").join(sizes.select("cell", heavy.alias("heavy")), "cell"), "cells")
    light, heavy = cells.where("not heavy"), cells.where("heavy")
    roots = _cell_roots(light.select("node", "cell"), _sets(docs, k, light), pairs, large.select("region", "node"), t, partitions)
    if not heavy.isEmpty():
        roots = roots.unionByName(_shuffled_roots(heavy, _sets(docs, k, heavy), pairs, large, t, partitions))
    return materialize(roots, "roots")


def _most_unlike(t: Fraction, nodes: DataFrame) -> Column:
    """D of the size class of a set of `size` shingles: how many parts of a pair may differ at most, where this is the smaller set."""
    largest = nodes.agg(F.coalesce(F.max("n_shingles"), F.lit(1))).first()[0]
    parts = Parts(t, int(largest))
    found = F.lit(0)
    for m, spare, high in reversed(list(zip(parts.parts, parts.spare, parts.bounds[1:], strict=False))):  # one for each size class: about log(largest)
        found = F.when(F.col("size") < high, m - spare if m else 0).otherwise(found)
    return found


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    A document's set holds the 64-bit hashes of its distinct k-word shingles (A-Z folded; with fewer words the whole
    sequence is its one shingle); two link when |intersection| >= threshold * |union|, compared in whole numbers. No link
    between different sets that joins components is lost. component_id: the least doc_id reachable, its own included.
    Null, empty and blank texts have no shingles and are their own component. Rows that repeat a doc_id are judged row by
    row. Rows without an id are returned with null in both other columns. An empty table gives an empty result.
    """
    docs = integer_ids(docs)
    nodes = materialize(shingle_nodes(docs, k), "nodes")
    roots = node_components(docs, nodes, k, threshold)
    classes = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("node", "component_id")
    found = nodes.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    lost = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return found.unionByName(lost)


#: Names of working columns that no table is expected to have.
KEY, AGAIN, NTH = "_tessera_text_hash", "_tessera_again", "_tessera_nth"


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least (doc_id, hash of its text) stays.

    Rows without an id stay; so do texts without words. Rows that share an id but not a component are documents of their own; of rows
    that share an id and a text one stays.
    """
    docs = integer_ids(docs)
    nodes = materialize(shingle_nodes(docs, k, hashed=True), "nodes")
    roots = node_components(docs, nodes, k, threshold)
    firsts = nodes.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    firsts = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keys = nodes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.bool_and(F.col("node").isNull()).alias("wordless"))
    best = keys.where("not wordless").join(firsts.select("first.doc_id", "first.text_hash"), ["doc_id", "text_hash"], "left_semi")
    best = materialize(best.unionByName(keys.where("wordless")).select("doc_id", F.col("text_hash").alias(KEY), (F.col("n") > 1).alias(AGAIN)), "best")
    again = best.where(AGAIN).select("doc_id", KEY)
    hashed = docs.withColumn(KEY, F.xxhash64("text"))
    single = hashed.join(best.where(~F.col(AGAIN)), ["doc_id", KEY], "left_semi").select(columns_of(docs))
    order = Window.partitionBy("doc_id", KEY).orderBy(F.xxhash64(*columns_of(docs)))
    several = hashed.join(again, ["doc_id", KEY], "left_semi").withColumn(NTH, F.row_number().over(order)).where(F.col(NTH) == 1).select(columns_of(docs))
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))
