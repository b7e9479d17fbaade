"""From questions and packed context to answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.answer import (
    answer_gate,
    context_prompt,
    fix_media,
    normalize_citations,
    with_context,
    with_grounded_answer,
)
from folioscope.operators.confidence import retrieval_confidence
from folioscope.operators.media import with_resolved
from folioscope.operators.query_features import analyze_structure
from folioscope.operators.tables import collected_aggregates, table_aggregates
from folioscope.operators.verify import verification_report, with_gate
from folioscope.session import checkpointed

CONTEXT = ["query_id", "rank", "chunk_id", "document_name", "page_number", "section_title", "modality", "content", "media_path", "caption", "source_reliability", "raw_similarity", "relevance_score"]


def generate_answers(
    queries: DataFrame,
    packed: DataFrame,
    media_catalog: DataFrame,
    generator: Callable[[DataFrame], DataFrame] | None = None,
    lex: Lexicon = DEFAULT,
) -> DataFrame:
    """(query_id, question, answer, context) for every row of ``queries``.

    ``packed`` is the output of ``retrieve``; ``media_catalog(path)`` lists media
    files.  A ``generator`` may add ``draft`` to (query_id, prompt); without one,
    or where its draft is null or short, the deterministic answer is used.
    """
    structure = checkpointed(analyze_structure(queries.select("query_id", "question"), lex))
    context = packed.select(*CONTEXT)
    context = checkpointed(with_resolved(context, media_catalog))
    confidence = retrieval_confidence(structure, context, lex=lex).select("query_id", "is_in_domain")
    gated = with_gate(context.join(structure, "query_id"), lex=lex)
    report = verification_report(structure, gated).select("query_id", "is_sufficient")
    active = gated.where("kept")
    totals = collected_aggregates(table_aggregates(structure, active))
    # Each cut keeps the plans small; all of these hold one row per question.
    rows = checkpointed(
        with_context(structure.select("query_id", "question"), context)
        .join(confidence, "query_id")
        .join(report, "query_id")
        .withColumn("early", answer_gate(F.col("question"), F.col("context"), F.col("is_in_domain"), F.col("is_sufficient"), lex))
        .select("query_id", "question", "early", F.col("context").alias("retrieved"))
        .transform(lambda d: with_context(d, active))
        .join(totals, "query_id", "left")
    )
    q, c, a = F.col("question"), F.col("context"), F.col("aggregates")
    draft = F.lit(None).cast("string")
    if generator is not None:
        prompts = rows.where(F.col("early").isNull()).select("query_id", context_prompt(q, c, a).alias("prompt"))
        rows = rows.join(generator(prompts).select("query_id", "draft"), "query_id", "left")
        draft = F.when(F.length(F.trim("draft")) > 10, F.col("draft"))
    due = with_grounded_answer(rows.where(F.col("early").isNull()), "grounded")
    written = checkpointed(
        due.select(
            "query_id", "question", "retrieved", "context",
            normalize_citations(F.coalesce(draft, F.col("grounded")), c).alias("answer"),
        )
    )
    refused = rows.where(F.col("early").isNotNull()).select("query_id", "question", "retrieved", F.col("early").alias("answer"))
    return (
        fix_media(written, media_catalog)
        .select("query_id", "question", "answer", F.col("retrieved").alias("context"))
        .unionByName(refused.withColumnRenamed("retrieved", "context"))
    )
