"""Lexical and vector search, fusion, re-ranking, gate, cuts, confidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.functions.text import let
from folioscope.operators import query_features as Q
from folioscope.operators.confidence import retrieval_confidence
from folioscope.operators.fusion import fuse_hops
from folioscope.operators.lexical import lexical_topk
from folioscope.operators.matching import entity_matches, evidence_text
from folioscope.operators.postings import postings_topk
from folioscope.operators.prune import elbow, token_pack
from folioscope.operators.rerank import cross_relevance, rerank, with_chunk_words, with_rerank_terms
from folioscope.operators.vectors import vector_topk
from folioscope.operators.verify import entity_coverage, field_coverage, verification_report, with_gate
from folioscope.operators.index import index_records
from folioscope.plans.retrieve import lexical_retriever, postings_retriever, retrieve, retrieve_candidates, vector_retriever
from folioscope.session import checkpointed, shared_folder
from folioscope.sources import stored
from registry import inputs as I
from registry.question_queries import SCOPE
from registry.sql import (
    CANDIDATES, CHUNKS, alternation, any_in, ascii_words, count_hits, entity_ctes, fields_in, hit, tokens,
)
from registry.sql import words as words_sql

HIT_COLUMNS = ["query_id", "step", "chunk_id", "raw_similarity", "relevance_score", "rank"]


# ------------------------------------------------------------------- search
def lexical(spark, sf):
    f = checkpointed(Q.with_features(I.questions(spark, sf)))
    asked = f.withColumn("step", F.lit(1)).withColumn("k", F.col("candidate_k"))
    return lexical_topk(asked, I.chunks(spark, sf), 16).select(*HIT_COLUMNS)


def stored_postings(spark, sf):
    """``lexical_topk`` from the stored index."""
    f = checkpointed(Q.with_features(I.questions(spark, sf)))
    asked = f.withColumn("step", F.lit(1)).withColumn("k", F.col("candidate_k"))
    return postings_topk(asked, I.posting_index(spark, sf)).select(*HIT_COLUMNS)


def stored_agentic(spark, sf):
    """``agentic_retrieve`` from the stored index: a second question set that builds nothing."""
    f = checkpointed(Q.with_features(pair_questions(spark, sf)))
    out = retrieve_candidates(f, postings_retriever(I.posting_index(spark, sf)), 16)
    return out.select("query_id", "chunk_id", "raw_similarity", "relevance_score", "first_step", "corroborated", "rank")


def pair_questions(spark, sf):
    """Comparative questions about two words of every benchmark text."""
    found = F.regexp_extract_all("question", F.lit("[A-Za-z]{4,}"), F.lit(0))
    return I.questions(spark, sf).select(
        "query_id",
        F.concat(F.lit('Compare the cost of "'), F.get(found, F.lit(0)), F.lit('" and "'), F.get(found, F.lit(1)), F.lit('"')).alias("question"),
    )


def agentic(spark, sf):
    f = checkpointed(Q.with_features(pair_questions(spark, sf)))
    out = retrieve_candidates(f, lexical_retriever(I.chunks(spark, sf)), 16)
    return out.select("query_id", "chunk_id", "raw_similarity", "relevance_score", "first_step", "corroborated", "rank")


def lexical_ctes(source: str) -> str:
    """``hits`` for ``source(query_id, step, question, k)``; needs ``ch``."""
    e_tok = tokens(ascii_words("e"), L.LEXICAL_STOP)
    full = f"len({e_tok}) > 0 AND len(list_filter({e_tok}, lambda t: list_contains(ww, t))) = len({e_tok})"
    visual, tabular = count_hits("ml", L.VISUAL_PATTERNS), count_hits("ml", L.TABULAR_PATTERNS)
    field_points = " + ".join(f"CASE WHEN list_contains(fields, '{f}') AND {hit('wm', alternation(a))} THEN 3 ELSE 0 END" for f, a in L.FIELD_ALIASES.items())
    return f"""{entity_ctes(source)}, lq AS (
  SELECT *, {tokens('ml', L.LEXICAL_STOP)} AS gw, list_transform(entities, lambda e: lower(e)) AS ents, {visual} AS v, {tabular} AS tb FROM qf
), lt AS (
  SELECT *, CASE WHEN v > 0 AND v >= tb THEN 'image-caption' WHEN tb > 0 THEN 'table' ELSE 'text' END AS target,
    CASE WHEN v > 0 AND v >= tb THEN 1.6::DOUBLE WHEN tb > 0 THEN 1.4 ELSE 1.0 END AS boost FROM lq
), cl AS (
  SELECT chunk_id, modality, media_path, lower(document_name) AS name, lower(coalesce(caption, '')) AS cap, lower(section_title) AS sec, lower(content) AS body FROM ch
), cx AS (
  SELECT *, name || ' ' || cap || ' ' || sec || ' ' || body AS whole, {words_sql('name')} AS nw, {words_sql('cap')} AS cw, {words_sql('sec')} AS sw, {words_sql('body')} AS bw FROM cl
), cy AS (SELECT *, {words_sql('whole')} AS ww, {ascii_words('whole')} AS wm FROM cx
), lp AS (
  SELECT query_id, step, k, chunk_id, target, boost, modality, media_path, len(ents) AS n_ent, len(gw) AS n_w, len(fields) AS n_f,
    coalesce(list_sum(list_transform(ents, lambda e: CASE WHEN contains(whole, e) THEN 8.0::DOUBLE WHEN {full} THEN 5.0
      ELSE 1.5 * len(list_filter({e_tok}, lambda t: list_contains(ww, t))) END)), 0) AS ep,
    len(list_filter(ents, lambda e: contains(whole, e) OR ({full}))) AS em,
    {field_points} AS fp,
    coalesce(list_sum(list_transform(gw, lambda w: 2.0::DOUBLE * list_contains(nw, w)::INT + 2.0 * list_contains(cw, w)::INT + 1.5 * list_contains(sw, w)::INT + list_contains(bw, w)::INT)), 0) AS wp
  FROM lt, cy WHERE NOT starts_with(name, 'readme')
), ls AS (
  SELECT *, least(1.0::DOUBLE, (ep + fp + wp) * CASE WHEN n_ent > 0 AND em = 0 AND n_w > 0 THEN 0.15::DOUBLE ELSE 1 END
    / greatest(n_ent * 8.0::DOUBLE + n_f * 3 + n_w * 2, 1.0)) AS sim FROM lp WHERE ep + fp + wp > 0
), lr AS (
  SELECT query_id, step, k, chunk_id, round_even(sim, 4) AS raw_similarity,
    round_even(sim * CASE WHEN modality = target THEN boost WHEN target = 'image-caption' AND media_path IS NOT NULL THEN 1.3::DOUBLE ELSE 1.0 END, 4) AS relevance_score FROM ls
), hits AS (
  SELECT query_id, step, chunk_id, raw_similarity, relevance_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY relevance_score DESC, chunk_id) AS rank FROM lr) WHERE rank <= k
)"""


TARGET_K = f"""CASE WHEN {hit('ml', alternation(L.BUDGET_VISUAL_WORDS))} THEN 2
  WHEN {any_in('lower(question)', L.BUDGET_SINGLE_FACT)} AND NOT {any_in('lower(question)', ['compare', 'difference'])} THEN 2
  WHEN len(entities) >= 2 OR {any_in('lower(question)', L.BUDGET_COMPARATIVE)} THEN least(8, greatest(6, len(entities) * 3))
  WHEN {hit('ml', alternation(L.BUDGET_QUANTITATIVE_WORDS))} OR {any_in('lower(question)', L.BUDGET_MULTI_HOP)} THEN 6 ELSE 4 END"""
BENCH = f"""bq AS (SELECT item_id AS query_id, 1 AS step, text AS question FROM benchmark), {entity_ctes('bq', 'bf')},
bs AS (SELECT query_id, step, question, {TARGET_K} AS effective_k FROM bf), bk AS (SELECT *, greatest(10, 2 * effective_k) AS k FROM bs)"""
FUSED = """fo AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY step) AS n, count(*) OVER (PARTITION BY query_id, chunk_id) AS c FROM hits),
fu AS (SELECT query_id, chunk_id, raw_similarity, step AS first_step, rank AS first_rank, c > 1 AS corroborated,
  list_reduce([relevance_score] || list_transform(range(c - 1), lambda x: 0.0::DOUBLE), lambda a, x: round_even(a * 1.25, 4)) AS relevance_score FROM fo WHERE n = 1),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, first_step, first_rank, chunk_id) AS rank FROM fu)"""
AGENTIC_SQL = f"""WITH {CHUNKS}, w AS (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS f FROM benchmark),
sub AS (SELECT query_id, ['Compare the cost of "' || f[1] || '" and "' || f[2] || '"', f[1] || ' cost', f[2] || ' cost'] AS qs FROM w),
se AS (SELECT query_id, generate_subscripts(qs, 1) AS step, unnest(qs) AS question, 6 AS k FROM sub), {lexical_ctes('se')}, {FUSED}
SELECT query_id, chunk_id, raw_similarity, relevance_score, first_step, corroborated, rank FROM fr WHERE rank <= 12"""


# ------------------------------------------------------------------ vectors
def vectors(spark, sf):
    i = F.col("vec_id")
    return I.table(spark, sf, "embeddings").select(
        F.concat(F.lit("vec_"), i).alias("chunk_id"),
        F.concat(F.lit("vec_"), i, F.lit(".txt")).alias("document_name"),
        F.when(i % 5 == 0, "image-caption").when(i % 5 == 1, "table").otherwise("text").alias("modality"),
        F.when(i % 5 < 2, F.concat(F.lit("media/"), i, F.lit(".png"))).alias("media_path"),
        "embedding",
        "label",
    )


def centroids(spark, sf, target: str, boost: float, k: int):
    """One query vector per label: the mean vector of the label."""
    parts = I.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(
        F.col("label").alias("query_id"),
        F.lit(1).alias("step"),
        F.transform("v", lambda e: e["x"]).alias("vector"),
        F.struct(F.lit(target).alias("target_modality"), F.lit(boost).alias("boost_weight")).alias("target"),
        F.lit(k).alias("k"),
    )


def vector(spark, sf):
    return vector_topk(centroids(spark, sf, "text", 1.0, 10), vectors(spark, sf), 10)


def vector_figures(spark, sf):
    return vector_topk(centroids(spark, sf, "image-caption", 1.6, 10), vectors(spark, sf), 10)


def vector_sql(target: str, boost: float, k: int) -> str:
    return f"""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS x FROM p GROUP BY ALL) GROUP BY label),
n AS (SELECT c.label AS query_id, vec_id, 'vec_' || vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 12) AS sim FROM c, embeddings),
f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) <= {max(15, 3 * k)}),
s AS (SELECT query_id, 1 AS step, chunk_id, sim, round_even(greatest(0, sim), 4) AS raw_similarity,
  round_even(greatest(0, sim) * CASE WHEN (CASE vec_id % 5 WHEN 0 THEN 'image-caption' WHEN 1 THEN 'table' ELSE 'text' END) = '{target}' THEN {boost}::DOUBLE
    WHEN '{target}' = 'image-caption' AND vec_id % 5 < 2 THEN 1.3::DOUBLE ELSE 1.0 END, 4) AS relevance_score FROM f)
SELECT query_id, step, chunk_id, raw_similarity, relevance_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, sim DESC, chunk_id) AS rank FROM s) WHERE rank <= {k}"""


# ------------------------------------------------- candidates of asked turns
def hop_fusion(spark, sf):
    """The user turns of a conversation as hops over the same documents."""
    c = I.candidates(spark, sf)
    hits = c.select(F.floor(F.col("query_id") / 1000).alias("query_id"), (F.col("query_id") % 1000).alias("step"), "rank", "chunk_id", "raw_similarity", "relevance_score")
    return fuse_hops(hits, 8).select("query_id", "chunk_id", "raw_similarity", "relevance_score", "first_step", "corroborated", "rank")


TERMS = ["t_entity", "t_dossier", "t_field", "t_keywords", "t_phrase", "t_media", "t_reliability", "t_penalty"]


def rerank_score(spark, sf):
    scored = with_rerank_terms(I.candidates(spark, sf, prepare=with_chunk_words)).withColumn("rerank_score", cross_relevance())
    return scored.select("query_id", "chunk_id", *TERMS, "rerank_score")


def rerank_topk(spark, sf):
    return rerank(I.candidates(spark, sf, prepare=with_chunk_words), 6).select("query_id", "chunk_id", "relevance_score", "rank")


def rerank_ctes(source: str) -> str:
    e_tok = tokens(ascii_words("e"), L.RERANK_STOP)
    full = f"len({e_tok}) > 0 AND len(list_filter({e_tok}, lambda t: list_contains(ww, t))) = len({e_tok})"
    field_points = " + ".join(f"CASE WHEN list_contains(fields, '{f}') AND {hit('wm', alternation(a))} THEN 1 ELSE 0 END" for f, a in L.FIELD_ALIASES.items())
    return f"""r0 AS (SELECT *, lower(document_name) || ' ' || lower(coalesce(caption, '')) || ' ' || lower(section_title) || ' ' || lower(content) AS whole,
  {tokens('ml', L.RERANK_STOP)} AS kw, list_transform(entities, lambda e: lower(e)) AS ents FROM {source}),
r1 AS (SELECT *, {words_sql('whole')} AS ww, {ascii_words('whole')} AS wm, array_to_string(kw[1:3], ' ') AS ph FROM r0),
r2 AS (SELECT *, list_transform(ents, lambda e: CASE WHEN contains(whole, e) THEN 0.5::DOUBLE WHEN {full} THEN 0.35 ELSE 0 END) AS pts FROM r1),
r3 AS (SELECT *, coalesce(list_sum(pts), 0) + CASE WHEN len(list_filter(pts, lambda p: p > 0)) >= 2 THEN 0.4::DOUBLE ELSE 0 END AS t_entity,
  CASE WHEN len(list_filter(ents, lambda e: contains(replace(lower(document_name), '-', '_'), replace(replace(e, ' ', '_'), '-', '_')))) > 0 THEN 0.35::DOUBLE ELSE 0 END AS t_dossier,
  ({field_points}) * 0.25::DOUBLE AS t_field,
  CASE WHEN len(kw) = 0 THEN 0.5::DOUBLE ELSE len(list_filter(kw, lambda w: list_contains(ww, w))) / len(kw) END AS t_keywords,
  CASE WHEN len(kw) >= 2 AND (contains(lower(content), ph) OR contains(lower(coalesce(caption, '')), ph)) THEN 0.35::DOUBLE ELSE 0 END AS t_phrase,
  CASE WHEN media_path IS NOT NULL AND modality IN ('image-caption', 'table') THEN 0.15::DOUBLE ELSE 0 END AS t_media,
  CASE WHEN regexp_matches(source_reliability, 'official|codex') THEN 1.1::DOUBLE WHEN regexp_matches(source_reliability, 'unverified|ballad') THEN 0.85 ELSE 1 END AS t_reliability,
  CASE WHEN len(ents) > 0 AND len(list_filter(pts, lambda p: p > 0)) = 0 AND len(kw) > 0 THEN 0.2::DOUBLE ELSE 1 END AS t_penalty FROM r2),
rr AS (SELECT *, round_even((CASE WHEN relevance_score = 0 THEN 0.5 ELSE relevance_score END * 0.25::DOUBLE + CASE WHEN raw_similarity = 0 THEN 0.5 ELSE raw_similarity END * 0.20::DOUBLE
  + t_keywords * 0.25::DOUBLE + t_entity + t_dossier + t_field + t_phrase + t_media) * t_reliability * t_penalty, 4) AS rerank_score FROM r3)"""


def matches(spark, sf):
    found = let(evidence_text(), lambda t: F.filter("entities", lambda e: entity_matches(t, e)))
    return I.candidates(spark, sf).select("query_id", "chunk_id", F.size(found).alias("n_matched"), F.size("entities").alias("n_asked"))


def field_match(spark, sf):
    g = with_gate(I.candidates(spark, sf))
    return g.select("query_id", "chunk_id", F.array_join("verified_fields", ",").alias("fields"))


def gate(spark, sf):
    return with_gate(I.candidates(spark, sf)).where("kept").select("query_id", "chunk_id", F.size("verified_entities").alias("n_entities"), F.size("verified_fields").alias("n_fields"))


def gate_ctes(source: str) -> str:
    e_tok = f"regexp_extract_all({ascii_words('lower(e)')}, '\\b[a-zA-Z0-9_\\-]{{3,}}\\b')"

    def single(x: str) -> str:
        return f"CASE WHEN ends_with({x}, 's') AND length({x}) > 3 THEN left({x}, length({x}) - 1) ELSE {x} END"

    every = f"len({e_tok}) > 0 AND len(list_filter({e_tok}, lambda t: list_contains(ew, t) OR list_contains(ew, {single('t')}))) = len({e_tok})"
    return f"""g0 AS (SELECT *, lower(content) || ' ' || lower(coalesce(caption, '')) || ' ' || lower(document_name) || ' ' || lower(section_title) AS ev,
  {ascii_words("lower(content || ' ' || coalesce(caption, '') || ' ' || section_title)")} AS fm, (modality = 'table' OR contains(content, '|')) AS tablelike FROM {source}),
g1 AS (SELECT *, {words_sql('ev')} AS ew FROM g0),
g2 AS (SELECT *, list_filter(entities, lambda e: contains(ev, {single('trim(lower(e))')}) OR ({every})) AS verified_entities, {fields_in('fields', 'fm')} AS verified_fields FROM g1),
gated AS (SELECT *, (len(entities) = 0 OR len(verified_entities) > 0 OR (tablelike AND len(verified_fields) > 0)) AS kept FROM g2)"""


def cover_entities(spark, sf):
    asked = I.structured(spark, sf)
    return entity_coverage(asked, with_gate(I.candidates(spark, sf, asked)))


def cover_fields(spark, sf):
    asked = I.structured(spark, sf)
    return field_coverage(asked, with_gate(I.candidates(spark, sf, asked)))


def sufficiency(spark, sf):
    asked = I.structured(spark, sf)
    r = verification_report(asked, with_gate(I.candidates(spark, sf, asked)))
    return r.select("query_id", "is_sufficient", "is_comparative", "retained_count", "pruned_count", F.size(F.filter(F.map_values("entity_coverage"), lambda v: v["found"])).alias("n_found"))


def confidence(spark, sf):
    c = I.candidates(spark, sf)
    r = retrieval_confidence(I.asked(spark, sf), c)
    return r.select("query_id", "verdict", "is_in_domain", "confidence_score", "top_similarity", F.size("matched_entities").alias("n_matched"), "overlap_ratio")


CRAG_SQL = f"""WITH {CANDIDATES}, t AS (SELECT query_id, any_value(question) AS question, any_value(ml) AS ml, min_by(raw_similarity, rank) AS sim,
  string_agg(lower(content || ' ' || document_name || ' ' || coalesce(caption, '') || ' ' || section_title), ' ' ORDER BY rank) FILTER (rank <= 5) AS txt FROM cand GROUP BY query_id),
n AS (SELECT *, {tokens('ml', L.CONFIDENCE_STOP)} AS nouns FROM t), h AS (SELECT *, len(nouns) AS n, len(list_filter(nouns, lambda w: contains(txt, w))) AS hits FROM n),
o AS (SELECT *, hits / greatest(n, 1) AS ov, round_even(sim * 0.6::DOUBLE + hits / greatest(n, 1) * 0.4::DOUBLE, 4) AS conf FROM h),
v AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN sim >= 0.45 THEN 'CORRECT' WHEN sim >= 0.28 THEN 'AMBIGUOUS' ELSE 'OUT_OF_DOMAIN' END
  WHEN hits = 0 AND (sim < 0.4 OR n >= 2) THEN 'OUT_OF_DOMAIN' WHEN sim < 0.28 AND ov < 0.25 THEN 'OUT_OF_DOMAIN'
  WHEN sim >= 0.45 AND (ov >= 0.2 OR hits >= 1) THEN 'CORRECT' WHEN sim >= 0.28 AND ov >= 0.2 THEN 'AMBIGUOUS'
  WHEN conf >= 0.35 AND hits >= 1 THEN 'AMBIGUOUS' ELSE 'OUT_OF_DOMAIN' END AS verdict FROM o)
SELECT query_id, verdict, verdict <> 'OUT_OF_DOMAIN' AS is_in_domain, conf AS confidence_score, sim AS top_similarity, hits AS n_matched, round_even(ov, 2) AS overlap_ratio FROM v"""


def elbow_prune(spark, sf):
    return elbow(I.candidates(spark, sf), 0.60, 2, 6).select("query_id", "chunk_id", "rank")


def pack(spark, sf):
    return token_pack(I.candidates(spark, sf), 800).select("query_id", "chunk_id", "rank", "est_tokens", "tokens_used")


EST = "greatest(trunc(len(regexp_extract_all(concat_ws(' ', content, caption), '\\S+')) * 1.33::DOUBLE)::INT, 10)"


def e2e(spark, sf):
    out = retrieve(I.questions(spark, sf), I.chunks(spark, sf))
    return out.select("query_id", "rank", "chunk_id", "raw_similarity", "relevance_score", "tokens_used")


E2E_SQL = f"""WITH {CHUNKS}, {BENCH}, {lexical_ctes('bk')},
bo AS (SELECT *, trim(lower(question)) AS t FROM (SELECT query_id, question, entities, fields, ml FROM qf)),
scoped AS (SELECT * FROM (SELECT *, {SCOPE} AS category FROM (SELECT query_id, question, entities, fields, ml, ml AS m, t FROM bo)) WHERE category = 'in_scope'),
cand AS (SELECT s.query_id, s.question, s.entities, s.fields, s.ml, k, effective_k, h.raw_similarity, h.relevance_score, h.rank, count(*) OVER (PARTITION BY s.query_id) AS alone, ch.*
  FROM scoped s JOIN hits h USING (query_id) JOIN bk USING (query_id) JOIN ch USING (chunk_id)),
{rerank_ctes('cand')},
re AS (SELECT * EXCLUDE (relevance_score, rank), CASE WHEN alone = 1 THEN relevance_score ELSE rerank_score END AS relevance_score, rank AS old FROM rr),
ro AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, old, chunk_id) AS rank FROM re),
{gate_ctes('ro')},
pool AS (SELECT *, bool_or(kept) OVER (PARTITION BY query_id) AS any_kept FROM gated),
el AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN relevance_score <> 0 THEN relevance_score ELSE raw_similarity END DESC, rank) AS place,
  max(CASE WHEN relevance_score <> 0 THEN relevance_score ELSE raw_similarity END) OVER (PARTITION BY query_id) AS top FROM pool WHERE kept OR NOT any_kept),
ek AS (SELECT * FROM el WHERE place <= CASE WHEN effective_k = 2 THEN 1 ELSE 2 END OR (top > 0 AND place <= effective_k AND relevance_score >= top * 0.6::DOUBLE)),
tk AS (SELECT *, sum({EST}) OVER (PARTITION BY query_id ORDER BY place) AS used FROM ek)
SELECT query_id, place AS rank, chunk_id, raw_similarity, relevance_score, used AS tokens_used FROM tk WHERE place = 1 OR used <= 2500"""

def index_roundtrip(spark, sf):
    """Search in an index that was written with stale rows, upserted and read again."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    records = index_records(I.chunks(spark, sf))
    number = F.regexp_extract("chunk_id", r"\d+", 0).cast("long")
    stale = records.where(number % 3 != 0).withColumn("document", F.when(number % 3 == 1, F.reverse("document")).otherwise(F.col("document")))
    stored.write_index(stale, f"{folder}/old")
    stored.upsert_index(spark, f"{folder}/old", records.where(number % 3 != 2), f"{folder}/new")
    f = checkpointed(Q.with_features(I.questions(spark, sf)))
    asked = f.withColumn("step", F.lit(1)).withColumn("k", F.col("candidate_k"))
    return lexical_topk(asked, stored.read_index(spark, f"{folder}/new")).select(*HIT_COLUMNS)


def vector_e2e(spark, sf):
    """Documents with the vector of their number as index; every question looks from the
    vector of its number, each third one without a vector falls back to words."""
    given = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), "embedding")
    number = F.regexp_extract("chunk_id", r"\d+", 0).cast("long")
    chunks = I.chunks(spark, sf)
    index = chunks.withColumn("n", number).join(given, "n").select("chunk_id", "document_name", "modality", "media_path", "embedding")

    def embedder(questions):
        near = given.select(F.col("n").alias("query_id"), F.when(F.col("n") % 3 != 0, F.col("embedding")).alias("vector"))
        return questions.join(near, "query_id", "left")

    out = retrieve(I.questions(spark, sf), chunks, vector_retriever(index, embedder, lexical_retriever(chunks)))
    return out.select("query_id", "rank", "chunk_id", "raw_similarity", "relevance_score", "tokens_used")


QUERIES = {
    "postings_topk": stored_postings, "postings_agentic": stored_agentic, "index_roundtrip": index_roundtrip, "vector_retrieve_e2e": vector_e2e,
    "lexical_topk": lexical, "agentic_retrieve": agentic, "vector_topk": vector, "modality_boost": vector_figures, "hop_fusion": hop_fusion,
    "rerank_score": rerank_score, "rerank_topk": rerank_topk, "entity_match": matches, "field_match": field_match, "verify_gate": gate,
    "entity_coverage": cover_entities, "field_coverage": cover_fields, "sufficiency": sufficiency, "crag_confidence": confidence,
    "elbow_prune": elbow_prune, "token_pack": pack, "retrieve_e2e": e2e,
}
_GATED = f"WITH {CANDIDATES}, {gate_ctes('cand')}"
SQL = {
    "lexical_topk": f"WITH {CHUNKS}, {BENCH}, {lexical_ctes('bk')} SELECT * FROM hits",
    "agentic_retrieve": AGENTIC_SQL,
    "postings_topk": f"WITH {CHUNKS}, {BENCH}, {lexical_ctes('bk')} SELECT * FROM hits",
    "postings_agentic": AGENTIC_SQL,
    "index_roundtrip": f"WITH {CHUNKS}, {BENCH}, {lexical_ctes('bk')} SELECT * FROM hits",
    "vector_topk": vector_sql("text", 1.0, 10),
    "modality_boost": vector_sql("image-caption", 1.6, 10),
    "hop_fusion": f"""WITH {CANDIDATES}, hits AS (SELECT query_id // 1000 AS query_id, query_id % 1000 AS step, rank, chunk_id, raw_similarity, relevance_score FROM cand), {FUSED}
      SELECT query_id, chunk_id, raw_similarity, relevance_score, first_step, corroborated, rank FROM fr WHERE rank <= 8""",
    "rerank_score": f"WITH {CANDIDATES}, {rerank_ctes('cand')} SELECT query_id, chunk_id, {', '.join(TERMS)}, rerank_score FROM rr",
    "rerank_topk": f"""WITH {CANDIDATES}, {rerank_ctes('cand')} SELECT query_id, chunk_id, rerank_score AS relevance_score,
      row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rr.rank, chunk_id) AS rank FROM rr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rr.rank, chunk_id) <= 6""",
    "entity_match": f"{_GATED} SELECT query_id, chunk_id, len(verified_entities) AS n_matched, len(entities) AS n_asked FROM gated",
    "field_match": f"{_GATED} SELECT query_id, chunk_id, array_to_string(verified_fields, ',') AS fields FROM gated",
    "verify_gate": f"{_GATED} SELECT query_id, chunk_id, len(verified_entities) AS n_entities, len(verified_fields) AS n_fields FROM gated WHERE kept",
    "entity_coverage": f"""{_GATED}, w AS (SELECT query_id, unnest(list_distinct(entities)) AS entity FROM qf), k AS (SELECT query_id, unnest(list_distinct(verified_entities)) AS entity FROM gated WHERE kept)
      SELECT w.query_id, w.entity, count(k.entity) AS matching_chunks, count(k.entity) > 0 AS found FROM w LEFT JOIN k ON w.query_id = k.query_id AND w.entity = k.entity GROUP BY ALL""",
    "field_coverage": f"""{_GATED}, w AS (SELECT query_id, unnest(fields) AS field FROM qf), k AS (SELECT query_id, unnest(verified_fields) AS field FROM gated WHERE kept)
      SELECT w.query_id, w.field, count(k.field) AS matching_chunks, count(k.field) > 0 AS found FROM w LEFT JOIN k ON w.query_id = k.query_id AND w.field = k.field GROUP BY ALL""",
    "sufficiency": f"""{_GATED}, a AS (SELECT query_id, count(*) FILTER (kept) AS retained_count, count(*) FILTER (NOT kept) AS pruned_count,
        coalesce(flatten(list(verified_entities) FILTER (kept)), []) AS ve, coalesce(flatten(list(verified_fields) FILTER (kept)), []) AS vf, coalesce(bool_or(kept AND tablelike), false) AS tab FROM gated GROUP BY query_id),
      b AS (SELECT query_id, entities, (len(entities) >= 2 OR {any_in('lower(question)', L.STRUCTURE_COMPARATIVE)}) AS is_comparative FROM qf)
      SELECT query_id, is_comparative, coalesce(retained_count, 0) AS retained_count, coalesce(pruned_count, 0) AS pruned_count,
        len(list_filter(list_distinct(entities), lambda e: list_contains(coalesce(ve, []), e))) AS n_found,
        coalesce(retained_count, 0) > 0 AND (len(entities) = 0 OR list_has_any(entities, ve) OR (NOT is_comparative AND tab AND len(vf) > 0)) AS is_sufficient
      FROM b LEFT JOIN a USING (query_id)""",
    "crag_confidence": CRAG_SQL,
    "elbow_prune": f"""WITH {CANDIDATES}, e AS (SELECT query_id, chunk_id, CASE WHEN relevance_score <> 0 THEN relevance_score ELSE raw_similarity END AS sc, cand.rank AS old FROM cand),
      p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, old) AS rank, max(sc) OVER (PARTITION BY query_id) AS top FROM e)
      SELECT query_id, chunk_id, rank FROM p WHERE rank <= 2 OR (top > 0 AND rank <= 6 AND sc >= top * 0.6::DOUBLE)""",
    "token_pack": f"""WITH {CANDIDATES}, e AS (SELECT query_id, chunk_id, rank, {EST} AS est_tokens FROM cand),
      u AS (SELECT *, sum(est_tokens) OVER (PARTITION BY query_id ORDER BY rank) AS tokens_used, min(rank) OVER (PARTITION BY query_id) AS first FROM e)
      SELECT query_id, chunk_id, rank, est_tokens, tokens_used FROM u WHERE rank = first OR tokens_used <= 800""",
    "retrieve_e2e": E2E_SQL,
}
