"""Mixing sources to target weights, in native expressions only (operator 1).

The words of each source, taken in doc_id order, form one stream that is cut into blocks of BLOCK words. Every source gets
a number of output slots that gives it its target. The slots fall on output shards by multinomial draws, are numbered
through, mapped to blocks by a pseudorandom permutation of the source's block indexes, and joined to the blocks by index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.words import GAP, n_words, named
from tessera.session import materialize

ROUNDS = 8
#: Up to so many sources their table is broadcast; beyond, Spark joins it by shuffle.
BROADCAST_SOURCES = 10_000
RUN = 1024
#: Slots that a task makes and permutes, where shuffle partitions alone would give it more.
SLOTS_PER_TASK = 2**20


@dataclass(frozen=True)
class Mix:
    """sized: row_id, doc_id, source, size, sid, start (words of the source before it).
    sources: source, sid, source_size, target, blocks and the plan of its slots.
    slots: sid, shard, slot (ordinal), block, take (words taken from the start of the block).
    pieces: sid, block, low, high (offsets in the block), row_start (where the document begins in the stream).
    """

    sized: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def _swap_or_not(index: str, size: str, cycle: str, seed: int, backwards: bool = False) -> Column:
    """The column index, permuted within [0, size) by swap-or-not rounds (Hoang, Morris, Rogaway 2012).

    A round pairs index i with key - i and lets a hash of the larger one decide whether they change places, so each round
    is its own inverse. Rounds are folded over an array, as nested columns would double the expression each time.
    """
    rounds = ", ".join(map(str, reversed(range(ROUNDS)) if backwards else range(ROUNDS)))
    partner = f"pmod(xxhash64({seed}, r, sid, {cycle}) - i, {size})"
    swap = f"xxhash64({seed}, 1000 + r, sid, {cycle}, greatest(i, {partner})) & 1L = 1L"
    return F.expr(f"aggregate(array({rounds}), {index}, (i, r) -> case when {swap} then {partner} else i end)")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """source, sid, source_size, target: sources by code point (null last) share all words by the repeating weights.

    A target stops at limit times its source's size; the rest is shared anew by weight until none is above. With the
    sources in the order of their cap per unit of weight, the capped ones come first, so running sums give the level at
    which the others stand. Sources without words have target 0. The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("weight", weight)
    per = per.withColumn("_cap", F.col("source_size") * F.lit(limit)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    every, rising = Window.partitionBy(), Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("_total", F.sum("source_size").over(every).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(rising), F.lit(0.0)))
        .withColumn("_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
    )
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return per.select("source", "sid", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0, block: int = 256, shard_blocks: int = 1024, seed: int = 7) -> Mix:
    """Plan a mix of docs (doc_id, source, text). Reruns agree: every choice is a hash of seed and index.

    Null texts and texts without words have size 0 and give nothing. Rows with equal doc_id are kept as rows of their own,
    in the order of their sizes; null ids come first. Extra columns play no part.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sized")
    sources = source_targets(sized, weights, limit)
    size, want = F.col("source_size"), F.col("want")
    sources = (
        sources.withColumn("want", F.floor(F.col("target") + 1e-6).cast("long"))
        .withColumn("blocks", F.ceil(size / block).cast("long"))
        .withColumn("last", F.when(size > 0, size - (F.col("blocks") - 1) * block).otherwise(0).cast("long"))
        .withColumn("cycles", F.when(size > 0, F.expr("want div source_size")).otherwise(0).cast("long"))
        .withColumn("rest", F.when(size > 0, want - F.col("cycles") * size).otherwise(0).cast("long"))
        .withColumn("_size", F.greatest(F.col("blocks"), F.lit(1)))
        .withColumn("_last_at", F.greatest(F.col("blocks") - 1, F.lit(0)).cast("long"))
    )
    sources = sources.withColumn("_last_at", _swap_or_not("_last_at", "_size", "cycles", seed, backwards=True))
    short = block - F.col("last")
    n_rest = F.when(F.col("rest") <= F.col("_last_at") * block, F.ceil(F.col("rest") / block)).otherwise(F.ceil((F.col("rest") + short) / block))
    sources = sources.withColumn("n_slots", (F.col("cycles") * F.col("blocks") + n_rest).cast("long")).drop("_size")
    sources = materialize(sources, "mix-sources")
    totals = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_slots"), F.lit(0)).alias("slots")).first()
    shards = max(1, -(-totals["slots"] // shard_blocks))
    near = F.broadcast(sources) if totals["n"] <= BROADCAST_SOURCES else sources

    # Where each document begins in its source's stream: Spark deals ranges of (source, id) to partitions; the totals of these, then sums within each.
    # So neither the size of a source nor gaps between ids decide how many rows a task sorts.
    rows = sized.join(near.select(F.col("source").alias("_s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    line = [F.col("doc_id").asc_nulls_first(), F.col("size")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "sid", *line).withColumn("_part", F.spark_partition_id())
    rows = materialize(rows, "mix-ranges")
    before = Window.partitionBy("sid").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("sid", "_part").agg(F.sum("size").alias("_words")).withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    inside = Window.partitionBy("sid", "_part").orderBy(*line).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(spans, ["sid", "_part"])
    rows = rows.withColumn("start", F.col("_before") + F.col("_inside")).select("doc_id", "source", "size", "sid", "source_size", "target", "start")
    rows = materialize(rows, "mix-rows")

    end = F.col("start") + F.col("size")
    pieces = rows.where("size > 0").select(
        "sid", "start", end.alias("_end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")
    )
    pieces = pieces.select(
        "sid", "block", F.col("start").alias("row_start"),
        F.greatest(F.col("start") - F.col("block") * block, F.lit(0)).alias("low"),
        F.least(F.col("_end") - F.col("block") * block, F.lit(block)).alias("high"),
    )

    # Multinomial counts: each slot of a source falls on a shard, all shards alike; counts are summed before the shuffle.
    # Runs of slots and then shards are dealt to tasks by number, as a source, however large, starts from one row.
    tasks = max(parts, -(-totals["slots"] // SLOTS_PER_TASK))
    wide = near.where("n_slots > 0").select("sid", F.expr(f"(n_slots - 1) div {RUN}").alias("_last"), "n_slots")
    wide = wide.select("sid", "n_slots", "_last", F.explode(F.sequence(F.lit(0), F.expr(f"_last div {RUN}"))).alias("_top"))
    spread = wide.select("sid", "n_slots", F.explode(F.sequence(F.col("_top") * RUN, F.least(F.col("_last"), (F.col("_top") + 1) * RUN - 1))).alias("_run"))
    draws = spread.repartition(tasks, "sid", "_run").select(
        "sid", F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col("n_slots"), (F.col("_run") + 1) * RUN) - 1)).alias("_t")
    )
    counts = draws.groupBy("sid", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "sid", "_t"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).repartition(tasks, "sid", "shard")
    slots = counts.select("sid", "shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)).alias("slot"))
    plan = near.select(F.col("sid").alias("_sid"), "blocks", "last", "cycles", "rest", "_last_at")
    slots = slots.join(plan, F.col("sid") == F.col("_sid")).drop("_sid")
    slots = slots.withColumn("_cycle", F.expr("slot div blocks")).withColumn("_q", F.expr("slot % blocks"))
    slots = slots.withColumn("block", _swap_or_not("_q", "blocks", "_cycle", seed))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(block)
    gone = F.col("_q") * block - F.when(F.col("_q") > F.col("_last_at"), short).otherwise(0)
    take = F.when(F.col("_cycle") < F.col("cycles"), length).otherwise(F.least(length, F.col("rest") - gone))
    slots = slots.select("sid", "shard", "slot", "block", take.cast("long").alias("take"))
    return Mix(rows, sources, slots, pieces)


def taken_pieces(plan: Mix) -> DataFrame:
    """The mix itself: sid, shard, slot, row_start, low, high: words [low, high) of the source's stream come at that slot."""
    joined = plan.slots.join(plan.pieces, ["sid", "block"]).where(F.col("low") < F.col("take"))
    return joined.select("sid", "shard", "slot", "block", "row_start", "low", F.least("high", "take").alias("high"))


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, source."""
    plan = mix(docs, **options)
    taken = taken_pieces(plan).groupBy("sid", "row_start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    key = F.when(F.col("size") > 0, F.col("start"))
    joined = plan.sized.withColumn("row_start", key).join(taken, ["sid", "row_start"], "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")


def mix_documents(docs: DataFrame, block: int = 256, **options) -> DataFrame:
    """The mixed corpus with the columns of docs: the words that each slot takes from a document, as a row of its own.

    Slots that hold neighbouring words of one document within one pass over its source are joined to one row; a document
    taken whole keeps its text as it is, repeats are repeated rows, and a part keeps the white space between its words.
    Rows of equal doc_id stay apart by their place in the stream. Null, empty and blank texts have no words, so the mix takes nothing of them; null ids and
    null sources count as values; extra columns stay; an empty table gives an empty result.
    """
    plan = mix(docs, block=block, **options)
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    counted = docs.select(F.struct(F.lit(0).alias("none"), *[named(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("_doc"), "doc_id", "source", "text", n_words(F.col("text")).alias("_size"))
    begin = plan.sized.where("size > 0").select("sid", F.col("start").alias("row_start"), "doc_id", "size", "source")
    runs = taken_pieces(plan).join(begin, ["sid", "row_start"])
    low = F.col("block") * block + F.col("low") - F.col("row_start")
    runs = runs.select("doc_id", "source", "size", "row_start", "slot", low.alias("low"), (low + F.col("high") - F.col("low")).alias("high"))
    # The k-th time that a word range of a document is taken belongs to copy k; neighbours within a copy become one range.
    again = Window.partitionBy("source", "row_start", "low").orderBy("slot")
    runs = runs.withColumn("copy", F.row_number().over(again))
    along = Window.partitionBy("source", "row_start", "copy").orderBy("low")
    runs = runs.withColumn("new", F.when(F.lag("high").over(along) == F.col("low"), 0).otherwise(1)).withColumn("range", F.sum("new").over(along))
    runs = runs.groupBy("doc_id", "source", "size", "row_start", "copy", "range").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # Rows that agree in doc_id, source and size are told apart by their rank in the stream.
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "source", "size").orderBy("row_start"))
    runs = runs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), rank.alias("_rank"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    same = Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    repeated = materialize(plan.sized.groupBy("doc_id", "source", "size").count().where("count > 1").select(*[F.col(c).alias(f"_{c}_") for c in ("doc_id", "source", "size")]), "repeated-keys")
    equal = [F.col("doc_id").eqNullSafe(F.col("_doc_id_")), F.col("source").eqNullSafe(F.col("_source_")), F.col("_size") == F.col("_size_")]
    if not repeated.isEmpty():  # else every row is the first of its kind, and texts move once
        repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_SOURCES else repeated
        several = counted.join(repeated, equal, "left_semi").withColumn("_row", F.row_number().over(same))
        counted = counted.join(repeated, equal, "left_anti").withColumn("_row", F.lit(1)).unionByName(several)
    else:
        counted = counted.withColumn("_row", F.lit(1))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_size") == F.col("_words")) & (F.col("_row") == F.col("_rank"))
    mixed = counted.join(runs, on)
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.regexp_replace(F.array_join(F.slice(spaced, (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")), ""), "^" + GAP, "")
    whole = (F.col("_low") == 0) & (F.col("_high") == F.col("_size"))
    text = F.when(whole, F.col("text")).otherwise(part)
    mixed = mixed.select(*[text.alias("text") if c == "text" else F.col(f"_doc.c{others.index(c)}").alias(c) if c in others else F.col(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed
