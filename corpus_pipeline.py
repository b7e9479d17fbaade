"""A pipeline over ``documents``: quality, near duplicates, personal data, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard, mixing, packing, privacy, quality
from folioscope.llm.common import column, spare_name, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from all labels."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    score = spare_name(docs, "score")
    return docs.withColumn(score, quality.scored(forest, F.col("text"))).where(F.col(score) >= 0.3).drop(score)


def one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the one
    with the smallest id, and of rows with that id the first by its JSON form. Rows
    without an id stay."""
    groups = jaccard.jaccard_components(docs, k=5, percent=80)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti")
    twice = stored(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    row = F.struct(*[column(docs, c) for c in docs.columns])
    once = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).union(once.select(docs.columns))


def mask_privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    field = privacy.train(docs)
    text = privacy.masked(field, F.col("text"))
    return docs.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (parts of a document round)."""
    # the row goes along whole, so that no column of it meets one of the operator's
    whole = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    copies = F.round("copies").cast("int")
    return mixing.mix(whole).where(copies > 0).select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_of_group),
    ("privacy", mask_privacy),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]
# The stages train models and hash with Spark's functions: tested against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
