"""Scope, intent, budget, complexity, fields, entities, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.operators import query_features as Q
from folioscope.session import dealt
from registry import inputs as I
from registry.sql import ASKED, ROUTED, alternation, any_hit, any_in, ascii_words, count_hits, entity_ctes, fields, hit, lst

def q():
    return F.col("question")


def scope_guard(spark, sf):
    g = Q.scope_guard(q())
    return I.routed(spark, sf).select("query_id", g["is_handled"].alias("is_handled"), g["category"].alias("category"))


def query_intent(spark, sf):
    i = Q.query_intent(q())
    return I.routed(spark, sf).select("query_id", i["intent"].alias("intent"), i["target_modality"].alias("target_modality"), i["boost_weight"].alias("boost_weight"), F.size(i["matched_terms"]).alias("n_matched"))


def modality_override(spark, sf):
    forced = F.when(F.col("query_id") % 3 == 0, F.lit("table")).when(F.col("query_id") % 3 == 1, F.lit("image-caption"))
    t = Q.modality_target(q(), forced)
    return I.routed(spark, sf).select("query_id", t["target_modality"].alias("target_modality"), t["boost_weight"].alias("boost_weight"))


def query_budget(spark, sf):
    b = Q.query_budget(q(), F.array_repeat(F.lit("e"), (F.col("query_id") % 4).cast("int")))
    return I.routed(spark, sf).select("query_id", *[b[c].alias(c) for c in ("intent", "target_k", "min_k", "is_visual", "is_comparative", "is_quantitative")])


def query_complexity(spark, sf):
    return I.routed(spark, sf).select("query_id", Q.query_complexity(q()).alias("complexity"))


def query_fields(spark, sf):
    return I.routed(spark, sf).select("query_id", F.array_join(Q.requested_fields(q()), ",").alias("fields"))


def query_entities(spark, sf):
    both = I.questions(spark, sf).unionByName(I.asked(spark, sf).select((F.col("query_id") + 10_000_000).alias("query_id"), "question"))
    return Q.with_entities(both).select("query_id", F.array_join("entities", "|").alias("entities"))


def query_structure(spark, sf):
    return Q.analyze_structure(I.asked(spark, sf)).select("query_id", "is_comparative", "entity_count", "field_count")


def query_decompose(spark, sf):
    """Comparative, relational, quantitative and summary questions about parts."""
    p = dealt(I.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"))
    k = F.col("p_partkey") % 4
    question = (
        F.when(k == 0, F.concat(F.lit("compare "), "p_name", F.lit(" with "), F.lower("p_brand"), F.lit(" cost?")))
        .when(k == 1, F.concat(F.lit("who was the founder of "), "p_name", F.lit(" and why?")))
        .when(k == 2, F.concat(F.lit("average price of "), "p_name"))
        .otherwise(F.concat(F.lit("chronology of "), "p_name"))
    )
    f = Q.with_features(p.select(F.col("p_partkey").alias("query_id"), question.alias("question")))
    # an inner explode would find the sub-queries twice, once for a filter below the exchange
    found = f.select("query_id", F.posexplode_outer("sub_queries").alias("pos", "sub_query")).where("pos is not null")
    return found.select("query_id", (F.col("pos") + 1).alias("step"), "sub_query")


DECOMPOSE_SQL = """
WITH p AS (SELECT p_partkey AS query_id, p_partkey % 4 AS k, p_name AS n, lower(p_brand) AS b,
  'cost' || CASE WHEN contains(p_name, 'plate') THEN ' diagram' ELSE '' END AS f FROM part), q AS (
  SELECT query_id, CASE k
    WHEN 0 THEN ['compare ' || n || ' with ' || b || ' cost?', n || ' ' || f, b || ' cost ' || f]
    WHEN 1 THEN ['who was the founder of ' || n || ' and why?', 'Who is the founder of ' || n || '?', n || ' founder history background']
    WHEN 2 THEN ['average price of ' || n, 'table ledger ' || f || ' average price of ' || n]
    ELSE ['chronology of ' || n, 'annals chronicle overview summary'] END AS subs FROM p)
SELECT query_id, unnest(subs) AS sub_query, generate_subscripts(subs, 1) AS step FROM q
"""

M = f"WITH {ROUTED}, r AS (SELECT *, trim(lower(question)) AS t, {ascii_words('trim(lower(question))')} AS m FROM routed)"
BARE = "trim(regexp_replace(t, '[^\\p{L}\\p{N}_\\s]', '', 'g'))"
SCOPE = f"""CASE WHEN t = '' THEN 'empty'
  WHEN list_contains({lst(L.GREETING_PHRASES)}, {BARE}) OR list_contains({lst(L.GREETING_PHRASES)}, t)
    OR ({BARE} <> '' AND list_has_all({lst(L.GREETING_TOKENS)}, regexp_split_to_array({BARE}, '\\s+'))) THEN 'greeting'
  WHEN list_contains({lst(L.FAREWELL_PHRASES)}, {BARE}) THEN 'farewell'
  WHEN {any_hit('m', L.INAPPROPRIATE_PATTERNS)} THEN 'inappropriate'
  WHEN {any_hit('m', L.PERSONAL_PATTERNS)} THEN 'personal_physical'
  WHEN {any_hit('m', L.OUT_OF_SCOPE_PATTERNS)} THEN 'out_of_scope' ELSE 'in_scope' END"""
V, T = count_hits("m", L.VISUAL_PATTERNS), count_hits("m", L.TABULAR_PATTERNS)
INTENT = f"""i AS (SELECT *, {V} AS v, {T} AS tb FROM r), j AS (
  SELECT *, CASE WHEN v > 0 AND v >= tb THEN 0 WHEN tb > 0 THEN 1 ELSE 2 END AS c FROM i)"""
BUDGET = f"""b AS (SELECT *, query_id % 4 AS n, {hit('m', alternation(L.BUDGET_VISUAL_WORDS))} AS visual,
  {any_in('t', L.BUDGET_SINGLE_FACT)} AND NOT {any_in('t', ['compare', 'difference'])} AS fact,
  (query_id % 4 >= 2 OR {any_in('t', L.BUDGET_COMPARATIVE)}) AS comp,
  {hit('m', alternation(L.BUDGET_QUANTITATIVE_WORDS))} AS quant, {any_in('t', L.BUDGET_MULTI_HOP)} AS hops FROM r)"""

QUERIES = {
    "scope_guard": scope_guard, "query_intent": query_intent, "modality_override": modality_override, "query_budget": query_budget,
    "query_complexity": query_complexity, "query_fields": query_fields, "query_entities": query_entities,
    "query_structure": query_structure, "query_decompose": query_decompose,
}
SQL = {
    "scope_guard": f"{M}, c AS (SELECT query_id, {SCOPE} AS category FROM r) SELECT query_id, category <> 'in_scope' AS is_handled, category FROM c",
    "query_intent": f"""{M}, {INTENT} SELECT query_id, ['visual', 'tabular', 'narrative_text'][c + 1] AS intent,
      ['image-caption', 'table', 'text'][c + 1] AS target_modality, [1.6::DOUBLE, 1.4, 1.0][c + 1] AS boost_weight, [v, tb, 0][c + 1]::INT AS n_matched FROM j""",
    "modality_override": f"""{M}, {INTENT} SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'image-caption' ELSE ['image-caption', 'table', 'text'][c + 1] END AS target_modality,
      CASE WHEN query_id % 3 < 2 THEN 1.5::DOUBLE ELSE [1.6::DOUBLE, 1.4, 1.0][c + 1] END AS boost_weight FROM j""",
    "query_budget": f"""{M}, {BUDGET} SELECT query_id,
      CASE WHEN visual THEN 'visual' WHEN fact THEN 'single_fact' WHEN comp THEN 'comparative' WHEN quant OR hops THEN 'quantitative_or_multihop' ELSE 'standard_narrative' END AS intent,
      CASE WHEN visual OR fact THEN 2 WHEN comp THEN least(8, greatest(6, n * 3)) WHEN quant OR hops THEN 6 ELSE 4 END::INT AS target_k,
      CASE WHEN visual OR fact THEN 1 ELSE 2 END AS min_k, visual AS is_visual, comp AS is_comparative, quant AS is_quantitative FROM b""",
    "query_complexity": f"""{M} SELECT query_id, CASE WHEN {any_hit('m', L.COMPARATIVE_PATTERNS)} THEN 'comparative' WHEN {any_hit('m', L.MULTI_HOP_PATTERNS)} THEN 'multi_hop'
      WHEN {any_hit('m', L.QUANTITATIVE_PATTERNS)} THEN 'quantitative' WHEN {any_hit('m', L.GLOBAL_SUMMARY_PATTERNS)} THEN 'global_summary' ELSE 'simple' END AS complexity FROM r""",
    "query_fields": f"{M} SELECT query_id, array_to_string({fields('m')}, ',') AS fields FROM r",
    "query_decompose": DECOMPOSE_SQL,
}
SQL["query_entities"] = f"""WITH {ASKED}, src AS (SELECT item_id AS query_id, text AS question FROM benchmark UNION ALL SELECT query_id + 10000000, question FROM asked),
  {entity_ctes('src')} SELECT query_id, array_to_string(entities, '|') AS entities FROM qf"""
SQL["query_structure"] = f"""WITH {ASKED}, {entity_ctes('asked')} SELECT query_id, (len(entities) >= 2 OR {any_in('lower(question)', L.STRUCTURE_COMPARATIVE)}) AS is_comparative,
  len(entities) AS entity_count, len(fields) AS field_count FROM qf"""
