"""Consistency over the years: how well a classifier tells the records of one year from those of the year before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.compat import round_scaled
from tessera.session import materialize

#: What stands for a pair of years that can't be judged, the least share of its smaller year, and the area from which on the records have changed.
NOT_JUDGED, BALANCE, CHANGED = -0.1, 0.25, 0.8
#: Names or values that become columns at most, the most frequent first.
COLUMNS = 1024


def _says(column: str, word: str) -> Column:
    return F.coalesce(F.lower(column).contains(word), F.lit(False))




def categories() -> dict[str, tuple[Column, str]]:
    one, two = "Mapping_info_1", "Mapping_info_2"
    return {
        "event": (_says(one, "event") & _says(two, "lab_event"), "Variable_name"),
        "diagnosis": (_says(one, "diagnosis"), "Value"),
        "prescription": (_says(one, "prescription") & _says(two, "drug"), "Value"),
        "procedure": (_says(one, "procedure"), "Value"),
    }


def visits(long: DataFrame, item: str) -> DataFrame:
    """patient, date, year, items: what each patient has on a date. Rows without a readable date, a patient or an item don't count."""
    date = F.try_to_timestamp("Event_date").cast("timestamp_ntz")
    rows = long.select(F.col("Patient_id").alias("patient"), date.alias("date"), F.col(item).alias("item")).where("patient is not null and date is not null and item is not null")
    return rows.groupBy("patient", "date").agg(F.collect_set("item").alias("items")).withColumn("year", F.year("date"))


def year_pairs(records: DataFrame) -> DataFrame:
    """year, n_before, n_now, judged for every year but the first and the last two, with those that have no records."""
    counts = records.groupBy("year").agg(F.count("*").alias("n"))  # a row for each year
    span = counts.agg(F.min("year").alias("low"), F.max("year").alias("high")).where("low + 1 <= high - 2")
    years = span.select(F.explode(F.sequence(F.col("low") + 1, F.col("high") - 2)).alias("year"))
    now, before = counts.select("year", F.col("n").alias("n_now")), counts.select((F.col("year") + 1).alias("year"), F.col("n").alias("n_before"))
    pairs = years.join(before, "year", "left").join(now, "year", "left").fillna(0, ["n_before", "n_now"])
    small, both = F.least("n_before", "n_now"), F.col("n_before") + F.col("n_now")
    return pairs.select("year", "n_before", "n_now", ((small >= 2) & (small >= BALANCE * both)).alias("judged"))


def area_by_ranks(scored: DataFrame, label: str, score: str) -> float | None:
    """The part of (1, 0) pairs of labels in which the 1 has the higher score, ties counted half; null where a label is missing.

    Rows are counted by score first. Ranges of scores are summed up by themselves and shifted by the ranges below, so no task has all of them.
    """
    spark = scored.sparkSession
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("ones"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("zeros"))
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").withColumn("part", F.spark_partition_id())
    below = F.sum("zeros").over(Window.partitionBy("part").orderBy("s")) - F.col("zeros")
    parts = ranged.withColumn("below", below).groupBy("part").agg(F.sum(F.col("ones") * (F.col("below") + F.col("zeros") / 2)).alias("wins"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    wins, ones, zeros = 0.0, 0, 0
    for row in sorted(parts.collect()):  # one row for each shuffle partition
        wins, ones, zeros = wins + row["wins"] + row["ones"] * zeros, ones + row["ones"], zeros + row["zeros"]
    return wins / (ones * zeros) if ones and zeros else None


def yearly_areas(records: DataFrame, trees: int = 20, depth: int = 3, seed: int = 7, columns: int = COLUMNS) -> DataFrame:
    """year, n_before, n_now, auroc, is_change_point, leading (the items that the trees lean on most) for the pairs of year_pairs.

    Boosted trees are fitted on a half of both years, which a seeded hash of patient and date picks, and judged on the other by the area under the curve. A pair that can't be judged has the area -0.1 and is
    no change.
    """
    spark = records.sparkSession
    records = materialize(records.withColumn("half", F.pmod(F.xxhash64("patient", "date", F.lit(seed)), F.lit(2))), "records")
    pairs = sorted(year_pairs(records).collect())  # a row for each year
    words = CountVectorizer(inputCol="items", outputCol="features", vocabSize=columns, binary=True).fit(records) if pairs else None
    if words:
        records = materialize(words.transform(records).select("year", "half", "features"), "features")
    out = []
    for year, before, now, judged in pairs:
        area, leading = None, []
        if judged:
            rows = records.where(F.col("year").isin(year - 1, year)).withColumn("label", (F.col("year") == year).cast("double"))
            fit, rest = rows.where("half = 0"), rows.where("half = 1")
            if fit.select("label").distinct().count() == 2:
                model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(fit)
                scored = model.transform(rest).select("label", vector_to_array("probability")[1].alias("score"))
                area = area_by_ranks(scored, "label", "score")
                weights = model.featureImportances
                leading = [words.vocabulary[int(i)] for i, w in sorted(zip(weights.indices, weights.values, strict=True), key=lambda x: (-x[1], x[0]))[:5] if w > 0]
        out.append((year, before, now, NOT_JUDGED if area is None else float(area), int(area is not None and area >= CHANGED), leading))
    return spark.createDataFrame(out, "year int, n_before long, n_now long, auroc double, is_change_point int, leading array<string>")


def time_series_consistency(long: DataFrame, names: Sequence[str] | None = None, **options) -> DataFrame:
    """category and the columns of yearly_areas for each category of the long format."""
    out = None
    for name, (rows, item) in categories().items():
        if names is None or name in names:
            found = yearly_areas(visits(long.where(rows), item), **options).select(F.lit(name).alias("category"), "*")
            out = found if out is None else out.unionByName(found)
    return out


def consistency_summary(areas: DataFrame) -> DataFrame:
    """category, points, changes, consistency: the years without a change in per cent."""
    per = areas.groupBy("category").agg(F.count("*").alias("points"), F.sum("is_change_point").alias("changes"))
    return per.withColumn("consistency", round_scaled((F.col("points") - F.col("changes")) * 100 / F.col("points"), 2))
