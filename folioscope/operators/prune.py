"""Score drop-off and token-budget cuts over each query's ranked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import token_estimate


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def effective_score() -> Column:
    """Relevance unless it is zero or missing, then similarity."""
    return F.coalesce(F.when(F.col("relevance_score") != 0, F.col("relevance_score")), F.col("raw_similarity"), F.lit(0.0))


def elbow(rows: DataFrame, alpha: float = 0.60, min_k: Column | int = 1, max_k: Column | int = 8, tie: str = "rank") -> DataFrame:
    """Keep ``min_k`` chunks, then up to ``max_k`` scoring at least alpha * best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("_score"), tie)
    place, top = F.col("_place"), F.col("_top")
    return (
        rows.withColumn("_score", effective_score())
        .withColumn("_place", F.row_number().over(order))
        .withColumn("_top", F.first_value("_score").over(order))
        .where(
            (place <= _col(min_k)) | ((top > 0) & (place <= _col(max_k)) & (F.col("_score") >= top * alpha))
        )
        .withColumn("rank", place)
        .drop("_score", "_place", "_top")
    )


def token_pack(rows: DataFrame, max_tokens: int = 2500) -> DataFrame:
    """Longest prefix (by rank) within the token budget; the first always stays."""
    order = Window.partitionBy("query_id").orderBy("rank")
    running = F.sum("est_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        rows.withColumn("est_tokens", token_estimate(F.col("content"), F.col("caption")))
        .withColumn("_place", F.row_number().over(order))
        .withColumn("tokens_used", running)
        .where((F.col("_place") == 1) | (F.col("tokens_used") <= max_tokens))
        .drop("_place")
    )
