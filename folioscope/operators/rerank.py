"""Second-stage relevance of retrieved candidates (at most a few per query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.functions.text import has_word, let, query_tokens, strip, without, words
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.matching import full_text, matched_fields


def with_chunk_words(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their lower-cased text and its distinct words, as
    ``with_rerank_terms`` needs them: found once here, not for each question of a chunk."""
    return chunks.withColumn("_text", full_text()).withColumn("_words", words(F.col("_text")))


def with_rerank_terms(rows: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Add every term of the composite score as a ``t_*`` column.

    ``rows`` joins a candidate's text and scores with its question's ``question``,
    ``entities`` and ``fields``; words that the chunks brought along are used.
    """
    rows = rows if {"_text", "_words"} <= set(rows.columns) else with_chunk_words(rows)
    text, found = F.col("_text"), F.col("_hits")

    def entity_points(e: Column) -> Column:
        every = let(
            without(query_tokens(e), lex.rerank_stop),
            lambda tokens: (F.size(tokens) > 0) & F.forall(tokens, lambda t: has_word(text, found, t)),
        )
        return F.when(F.contains(text, e), 0.5).when(every, 0.35).otherwise(0.0)

    def dashed(c: Column) -> Column:
        return F.translate(c, " -", "__")

    keywords = F.col("_keywords")
    phrase = F.array_join(F.slice(keywords, 1, 3), " ")
    caption, content = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("caption", "content")]
    name = F.replace(F.lower(F.coalesce("document_name", F.lit(""))), F.lit("-"), F.lit("_"))
    reliability = F.lower(F.coalesce("source_reliability", F.lit("archive_record")))
    matched = F.size(F.filter("_points", lambda p: p > 0))
    return (
        rows.withColumn("_keywords", without(query_tokens(F.lower(strip(F.col("question")))), lex.rerank_stop))
        # of the many words of a chunk only those asked for are compared one by one
        .withColumn("_hits", F.array_intersect("_words", F.concat("_keywords", query_tokens(F.array_join(F.transform("entities", F.lower), " ")))))
        .withColumn("_points", F.transform(F.transform("entities", F.lower), entity_points))
        .withColumn(
            "t_entity",
            F.aggregate("_points", F.lit(0.0), lambda a, p: a + p) + F.when(matched >= 2, 0.4).otherwise(0.0),
        )
        .withColumn(
            "t_dossier",
            F.when(
                let(name, lambda n: F.exists("entities", lambda e: F.contains(n, dashed(F.lower(e))))), 0.35
            ).otherwise(0.0),
        )
        .withColumn("t_field", F.size(matched_fields(text, F.col("fields"), lex)) * 0.25)
        .withColumn(
            "t_keywords",
            F.when(F.size(keywords) == 0, 0.5).otherwise(
                F.size(F.filter(keywords, lambda k: has_word(text, found, k))) / F.size(keywords)
            ),
        )
        .withColumn(
            "t_phrase",
            F.when(
                (F.size(keywords) >= 2) & (F.contains(content, phrase) | F.contains(caption, phrase)), 0.35
            ).otherwise(0.0),
        )
        .withColumn(
            "t_media",
            F.when(
                (F.length(F.coalesce("media_path", F.lit(""))) > 0) & F.col("modality").isin("image-caption", "table"),
                0.15,
            ).otherwise(0.0),
        )
        .withColumn(
            "t_reliability",
            F.when(reliability.rlike("official|codex"), 1.1).when(reliability.rlike("unverified|ballad"), 0.85).otherwise(1.0),
        )
        .withColumn(
            "t_penalty",
            F.when((F.size("entities") > 0) & (matched == 0) & (F.size(keywords) > 0), 0.2).otherwise(1.0),
        )
        .drop("_text", "_words", "_keywords", "_hits", "_points")
    )


def cross_relevance() -> Column:
    def known(c: str) -> Column:
        return F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(0.5))

    return rounded(
        (
            known("relevance_score") * 0.25
            + known("raw_similarity") * 0.20
            + F.col("t_keywords") * 0.25
            + F.col("t_entity")
            + F.col("t_dossier")
            + F.col("t_field")
            + F.col("t_phrase")
            + F.col("t_media")
        )
        * F.col("t_reliability")
        * F.col("t_penalty"),
        4,
    )


def rerank(rows: DataFrame, limit: Column | int, lex: Lexicon = DEFAULT) -> DataFrame:
    """Re-score and cut to ``limit``; a lone candidate keeps its score and rank."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    of_query = Window.partitionBy("query_id")
    order = of_query.orderBy(F.desc("relevance_score"), "rank", "chunk_id")
    terms = [c for c in ("t_entity", "t_dossier", "t_field", "t_keywords", "t_phrase", "t_media", "t_reliability", "t_penalty")]
    return (
        with_rerank_terms(rows, lex)
        .withColumn("_alone", F.count(F.lit(1)).over(of_query) == 1)
        .withColumn("rerank_score", F.when(~F.col("_alone"), cross_relevance()))
        .withColumn("relevance_score", F.coalesce("rerank_score", "relevance_score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("_alone") | (F.col("rank") <= limit))
        .drop("_alone", *terms)
    )
