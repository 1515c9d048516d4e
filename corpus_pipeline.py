"""From raw documents to packed training bins: five stages, each of them one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import mix_documents
from tessera.llm.ngram_join import one_of_each
from tessera.llm.packing import best_fit_pack
from tessera.llm.personal import mask_personal
from tessera.llm.quality import quality_filter
from tessera.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and so do null, empty and blank texts, which have no words. Null and equal ids are rows like others; all columns stay; an
    empty table gives an empty one (so in every stage)."""
    return quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the least (id, hash of the text). Rows without an id stay; of rows that repeat id and text one stays."""
    return one_of_each(docs, k=5, threshold=0.8)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the names of its kinds; every row stays."""
    return mask_personal(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is thinned out or repeated to its target; a row is what the mix takes from a document in one place. Documents
    of which the mix takes nothing go, as its targets have it."""
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix are packed into bins; repeats of a text and texts of one source share none. All rows are returned."""
    return best_fit_pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("personal data", personal_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Joins over shingle sets, a fitted field and a packing order are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
