"""How far the retrieved context can be trusted to answer a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.functions.text import let, lower_text, query_tokens, without
from folioscope.lexicon import DEFAULT, Lexicon


def retrieval_confidence(queries: DataFrame, ranked: DataFrame, threshold: float = 0.28, lex: Lexicon = DEFAULT) -> DataFrame:
    """Verdict per query from its best similarity and the five best texts.

    ``ranked(query_id, rank, raw_similarity, content, document_name, caption,
    section_title)``.  Only five rows per query are ever collected together.
    """
    first = Window.partitionBy("query_id").orderBy("rank")
    best = (
        ranked.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= 5)
        .groupBy("query_id")
        .agg(
            F.min_by("raw_similarity", "_place").alias("_sim"),
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "_place",
                        lower_text(*[F.col(c) for c in ("content", "document_name", "caption", "section_title")]).alias("t"),
                    )
                )
            ).alias("_texts"),
        )
        .withColumn("_text", F.array_join(F.transform("_texts", lambda x: x["t"]), " "))
        .drop("_texts")
    )
    sim, overlap, n, hits = F.col("top_similarity"), F.col("_overlap"), F.size("_nouns"), F.size("matched_entities")
    verdict = (
        F.when(F.col("_text").isNull(), "OUT_OF_DOMAIN|nothing was retrieved")
        .when((n == 0) & (sim >= 0.45), "CORRECT|general question, judged by similarity")
        .when((n == 0) & (sim >= threshold), "AMBIGUOUS|general question, judged by similarity")
        .when(n == 0, "OUT_OF_DOMAIN|general question, judged by similarity")
        .when((hits == 0) & ((sim < 0.40) | (n >= 2)), "OUT_OF_DOMAIN|no word of the question occurs in the context")
        .when((sim < threshold) & (overlap < 0.25), "OUT_OF_DOMAIN|low similarity and low word overlap")
        .when((sim >= 0.45) & ((overlap >= 0.20) | (hits >= 1)), "CORRECT|high similarity and shared words")
        .when((sim >= threshold) & (overlap >= 0.20), "AMBIGUOUS|moderate similarity and shared words")
        .when((F.col("confidence_score") >= 0.35) & (hits >= 1), "AMBIGUOUS|combined score suffices")
        .otherwise("OUT_OF_DOMAIN|combined score too low")
    )
    return (
        queries.select("query_id", "question")
        .join(best, "query_id", "left")
        .withColumn("_nouns", without(query_tokens(F.lower("question")), lex.confidence_stop))
        .withColumn("top_similarity", F.coalesce("_sim", F.lit(0.0)))
        .withColumn("matched_entities", let(F.col("_text"), lambda t: F.filter("_nouns", lambda w: F.coalesce(F.contains(t, w), F.lit(False)))))
        .withColumn("_overlap", hits / F.greatest(n, F.lit(1)))
        .withColumn("confidence_score", rounded(sim * 0.6 + overlap * 0.4, 4))
        .withColumn("_verdict", F.split(verdict, r"\|"))
        .select(
            "query_id",
            F.get("_verdict", F.lit(0)).alias("verdict"),
            (F.get("_verdict", F.lit(0)) != "OUT_OF_DOMAIN").alias("is_in_domain"),
            "confidence_score",
            "top_similarity",
            "matched_entities",
            rounded(F.col("_overlap"), 2).alias("overlap_ratio"),
            F.get("_verdict", F.lit(1)).alias("reason"),
        )
    )
