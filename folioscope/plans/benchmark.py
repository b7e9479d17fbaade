"""Evaluate a question set end to end and report it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.evaluate import (
    citation_accuracy,
    counts_for_modality,
    evaluation_summary,
    hallucination,
    modality_success,
    retrieval_precision,
)
from folioscope.operators.media import IMAGE_TAG, resolve_media
from folioscope.operators.query_features import detect_modality_intent
from folioscope.plans.answer import generate_answers
from folioscope.plans.retrieve import retrieve
from folioscope.session import checkpointed
from folioscope.sizing import small_side


def evaluate_answers(answers: DataFrame, media_catalog: DataFrame, latency: DataFrame | None = None, lex: Lexicon = DEFAULT) -> DataFrame:
    """Per-question metrics of ``answers(query_id, qid, track, question, answer, context)``."""
    tags = F.regexp_extract_all("answer", F.lit(IMAGE_TAG), F.lit(2))
    found = resolve_media(answers.select(F.explode(tags).alias("media_path")), media_catalog)
    shown = (
        answers.select("query_id", F.explode(tags).alias("media_path"))
        .join(found.where(F.col("resolved").isNotNull()), "media_path")
        .select("query_id", F.lit(True).alias("_image"))
        .distinct()
    )
    rows = answers.withColumn("target_modality", detect_modality_intent(F.col("question"), lex)).join(shown, "query_id", "left")
    if latency is not None:
        rows = rows.join(latency, "query_id", "left")
    else:
        rows = rows.withColumn("latency_sec", F.lit(0.0))
    q, a, c, t = F.col("question"), F.col("answer"), F.col("context"), F.col("target_modality")
    counted = counts_for_modality(F.col("qid"), t)
    return rows.select(
        "query_id",
        "qid",
        "track",
        "question",
        "target_modality",
        retrieval_precision(q, c, t, lex).alias("retrieval_precision"),
        citation_accuracy(a, c).alias("citation_accuracy"),
        hallucination(a, c).alias("hallucination"),
        F.when(counted, modality_success(a, c, t, F.coalesce("_image", F.lit(False)))).otherwise(True).alias("modality_success"),
        "latency_sec",
        F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).alias("retrieved_chunks_count"),
        F.when(F.length(a) > 250, F.concat(F.substring(a, 1, 250), F.lit("..."))).otherwise(a).alias("generated_answer"),
    )


def run_benchmark(
    questions: DataFrame,
    chunks: DataFrame,
    media_catalog: DataFrame,
    latency: DataFrame | None = None,
    lex: Lexicon = DEFAULT,
    **retrieval,
) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of ``questions(query_id, qid, track, question)``: retrieve,
    answer, evaluate, summarise.  Questions out of scope are answered without context."""
    asked = questions.select("query_id", "question")
    packed = checkpointed(retrieve(asked, chunks, lex=lex, **retrieval))
    answers = checkpointed(generate_answers(asked, packed, media_catalog, lex=lex).join(questions.drop("question"), "query_id"))
    if latency is not None:  # often one row per event: only those of the questions are moved
        latency = latency.join(small_side(asked.select("query_id"), 16), "query_id", "left_semi")
    results = checkpointed(evaluate_answers(answers, media_catalog, latency, lex))
    return results, evaluation_summary(results)


def summarize(results: DataFrame) -> DataFrame:
    return evaluation_summary(results)
