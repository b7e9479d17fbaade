"""From questions to packed context, many questions at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.fusion import fan_out, fuse_hops
from folioscope.operators.lexical import lexical_topk
from folioscope.operators.postings import PostingIndex, postings_topk
from folioscope.operators.prune import elbow, token_pack
from folioscope.operators.query_features import with_features
from folioscope.operators.rerank import rerank
from folioscope.operators.vectors import vector_topk
from folioscope.operators.verify import with_gate
from folioscope.session import checkpointed
from folioscope.sizing import small_side

# Candidates per sub-question under the adaptive budget: at most 2 * 8.
ADAPTIVE_MAX = 16
# A retriever maps sub-questions (query_id, step, question, entities, fields,
# target, k) to (query_id, step, chunk_id, raw_similarity, relevance_score, rank).
Retriever = Callable[[DataFrame, int], DataFrame]


def lexical_retriever(chunks: DataFrame, lex: Lexicon = DEFAULT) -> Retriever:
    return lambda questions, max_k: lexical_topk(questions, chunks, max_k, lex)


def postings_retriever(index: PostingIndex, lex: Lexicon = DEFAULT) -> Retriever:
    """Lexical search of a stored index, which any number of question sets share."""
    return lambda questions, max_k: postings_topk(questions, index, max_k, lex)


def vector_retriever(index: DataFrame, embedder: Callable[[DataFrame], DataFrame], fallback: Retriever | None = None) -> Retriever:
    """``embedder`` adds a ``vector`` column to the sub-questions; those that the vector
    search finds nothing for (a null vector, say) go to ``fallback``."""

    def search(questions: DataFrame, max_k: int) -> DataFrame:
        hits = vector_topk(embedder(questions), index, max_k)
        if fallback is None:
            return hits
        hits = checkpointed(hits)
        missed = checkpointed(questions.join(hits.select("query_id", "step").distinct(), ["query_id", "step"], "left_anti"))
        return hits.unionByName(fallback(missed, max_k).select(hits.columns))

    return search


def retrieve_candidates(features: DataFrame, retriever: Retriever, max_k: int, override: Column | None = None, lex: Lexicon = DEFAULT) -> DataFrame:
    """Multi-step retrieval: every sub-question searched at once, then fused."""
    questions = checkpointed(fan_out(features, lex, override))
    hits = retriever(questions, max_k)
    limits = features.select("query_id", "candidate_k")
    return fuse_hops(hits.join(limits, "query_id"), F.col("candidate_k"))


def with_chunk_text(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bring the few surviving candidates back to their chunk's text."""
    columns = [
        "chunk_id", "document_name", "page_number", "section_title", "modality", "content", "media_path", "caption",
        F.col("metadata.source_reliability" if "metadata" in chunks.columns else "source_reliability").alias("source_reliability"),
    ]
    return chunks.select(*columns).join(small_side(candidates, 120), "chunk_id")


def retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    retriever: Retriever | None = None,
    top_k: int | None = None,
    modality_override: str | None = None,
    max_tokens: int = 2500,
    lex: Lexicon = DEFAULT,
) -> DataFrame:
    """Packed context of every in-scope question of ``queries(query_id, question)``.

    Scope guard, budget, (multi-step) search, re-rank, verification gate, score
    drop-off, token packing.  ``top_k=None`` lets the budget decide.
    """
    forced = F.lit(modality_override) if modality_override else None
    features = checkpointed(
        with_features(queries, lex, forced, F.lit(top_k) if top_k is not None else None).where(F.col("scope") == "in_scope")
    )
    max_k = max(ADAPTIVE_MAX, 2 * (top_k or 0))
    candidates = checkpointed(
        retrieve_candidates(features, retriever or lexical_retriever(chunks, lex), max_k, forced, lex)
    )
    asked = features.select("query_id", "question", "entities", "fields", "is_comparative", "candidate_k", "effective_k", "min_k")
    ranked = rerank(with_chunk_text(candidates, chunks).join(asked, "query_id"), F.col("candidate_k"), lex)
    return cut(with_gate(ranked, lex=lex), max_tokens)


def cut(gated: DataFrame, max_tokens: int = 2500) -> DataFrame:
    """Gate (unless it leaves nothing), drop-off, packing."""
    from pyspark.sql import Window

    any_kept = F.bool_or("kept").over(Window.partitionBy("query_id"))
    pool = gated.withColumn("_any", any_kept).where(F.col("kept") | ~F.col("_any")).drop("_any")
    return token_pack(elbow(pool, 0.60, F.col("min_k"), F.col("effective_k")), max_tokens)
