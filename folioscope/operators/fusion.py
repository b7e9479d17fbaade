"""Sub-question fan-out and fusion of their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.query_features import analyze_structure, modality_target

HOP_BOOST = 1.25


def fan_out(features: DataFrame, lex: Lexicon = DEFAULT, modality_override: Column | None = None) -> DataFrame:
    """One row per sub-question: (query_id, step, question, entities, fields, target, k)."""
    n = F.size("sub_queries")
    hop_k = F.greatest(F.lit(3), F.floor(F.col("candidate_k") / n).cast("int") + 2)
    override = (modality_override if modality_override is not None else F.lit(None)).cast("string")
    steps = features.select(
        "query_id",
        "candidate_k",
        F.when(n <= 1, F.col("candidate_k")).otherwise(hop_k).alias("k"),
        F.posexplode("sub_queries").alias("pos", "question"),
    ).select("query_id", (F.col("pos") + 1).alias("step"), "question", "k", "candidate_k")
    return analyze_structure(steps.where(F.trim("question") != ""), lex).withColumn(
        "target", modality_target(F.col("question"), override, lex=lex)
    )


def corroborated_score(first: Column, hits: Column) -> Column:
    """First score, raised 1.25 times per further hit and rounded every time."""
    again = F.when(hits > 1, F.sequence(F.lit(2), hits.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(again, first, lambda acc, _: rounded(acc * HOP_BOOST, 4))


def fuse_hops(hits: DataFrame, limit: Column | int) -> DataFrame:
    """One row per (query, chunk): first occurrence kept, later ones corroborate.

    ``hits(query_id, step, rank, chunk_id, raw_similarity, relevance_score, ...)``;
    ``limit`` is a per-query constant column of ``hits`` or a number.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    first = F.struct("step", "rank", "raw_similarity", "relevance_score")
    merged = (
        hits.withColumn("_limit", limit)
        .groupBy("query_id", "chunk_id")
        .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n_hits"), F.max("_limit").alias("_limit"))
        .select(
            "query_id",
            "chunk_id",
            F.col("first.raw_similarity").alias("raw_similarity"),
            corroborated_score(F.col("first.relevance_score"), F.col("n_hits")).alias("relevance_score"),
            F.col("first.step").alias("first_step"),
            F.col("first.rank").alias("first_rank"),
            (F.col("n_hits") > 1).alias("corroborated"),
            "_limit",
        )
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "first_step", "first_rank", "chunk_id")
    return (
        merged.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= F.col("_limit"))
        .drop("_limit", "first_rank")
    )
