"""Prompts, grounded answers, gates, citation and image clean-up, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.operators import evaluate as E
from folioscope.operators.answer import (
    answer_gate, context_prompt, fix_media, normalize_citations, with_context, with_grounded_answer,
)
from folioscope.operators.media import message_parts, with_resolved
from folioscope.operators.query_features import detect_modality_intent
from folioscope.plans.answer import generate_answers
from folioscope.plans.benchmark import evaluate_answers, run_benchmark
from folioscope.plans.retrieve import retrieve
from folioscope.session import checkpointed
from registry import inputs as I
from registry.question_queries import SCOPE
from registry.sql import ASKED, CANDIDATES, CHUNKS, ROUTED, any_in, ascii_words, count_hits, lst, s
from registry.text_queries import _catalog


def contexts(spark, sf):
    """Asked questions with all their candidates as context."""
    packed = I.candidates(spark, sf)
    return with_context(I.asked(spark, sf), with_resolved(packed, _catalog(spark, sf))).drop("conv_id", "turn")


def prompt(spark, sf):
    return contexts(spark, sf).select("query_id", F.md5(context_prompt(F.col("question"), F.col("context"))).alias("prompt_md5"))


def grounded(spark, sf):
    rows = contexts(spark, sf).withColumn(
        "aggregates", F.lit(None).cast("array<struct<column_no:int,column:string,n_values:bigint,sum_value:double,avg_value:double>>")
    )
    return with_grounded_answer(rows).select("query_id", F.md5("answer").alias("answer_md5"))


CTX = f"""{CANDIDATES}, x AS (SELECT *, CASE WHEN doc_id IN (SELECT doc_id FROM labels) AND media_path IS NOT NULL THEN 'data/' || media_path END AS resolved,
  '[' || document_name || ', Page 1]' AS cite, trim(content, ' ' || chr(10)) AS body FROM cand)"""
PROMPT_SQL = f"""WITH {CTX}, b AS (SELECT query_id, rank, question, chr(10) || '--- [Chunk ' || rank || '] Source: ' || document_name || ' (Page 1) | Modality: ' || modality
  || ' | Reliability: ' || source_reliability || ' | Section: ' || section_title || coalesce(chr(10) || 'Media Path: ' || media_path, '') || coalesce(chr(10) || 'Caption: ' || caption, '')
  || chr(10) || 'Content:' || chr(10) || CASE WHEN length(body) > 450 THEN left(body, 450) || '... [trimmed]' ELSE body END AS blk FROM x)
SELECT query_id, md5('User Query: ' || any_value(question) || chr(10) || chr(10) || 'Retrieved Archive Context Chunks:' || chr(10) || string_agg(blk, chr(10) ORDER BY rank)) AS prompt_md5 FROM b GROUP BY query_id"""
# The first candidates of a block always hold a figure (j = 0), which leads the answer.
GROUNDED_SQL = f"""WITH {CTX}, f AS (SELECT query_id, any_value(question) AS question, min_by(raw_similarity, rank) AS sim,
    min_by({{'cite': cite, 'content': content, 'resolved': resolved, 'title': coalesce(caption, content)}}, rank) FILTER (modality = 'image-caption') AS fig,
    list({{'cite': cite, 'content': content, 'rel': source_reliability}} ORDER BY rank) AS c FROM x GROUP BY query_id),
  d AS (SELECT *, list_transform(list_filter(c[2:3], lambda y: list_contains({lst(L.CONFLICTING_RELIABILITY)}, y.rel)), lambda y: '- *Less reliable account* ' || y.cite || ': "' || left(y.content, 120) || '..."') AS bad FROM f)
SELECT query_id, md5(CASE WHEN CASE WHEN sim = 0 THEN 1.0 ELSE sim END < 0.25 THEN {s(L.NO_INFORMATION)} || question || '''.'
  ELSE '### Figure record' || chr(10) || 'As documented in ' || fig.cite || ':' || chr(10) || chr(10) || fig.content
    || CASE WHEN fig.resolved IS NOT NULL THEN chr(10) || chr(10) || chr(10) || '![' || fig.title || '](' || fig.resolved || ')' || chr(10) || chr(10) || '*Figure: ' || fig.title || ' — Source: ' || fig.cite || '*' ELSE '' END
    || CASE WHEN len(bad) > 0 THEN chr(10) || chr(10) || chr(10) || '**Conflicting sources:**' || chr(10) || array_to_string(bad, chr(10)) ELSE '' END END) AS answer_md5 FROM d"""


def gate(spark, sf):
    """Early replies of all turns, under verdicts by their key."""
    q = I.routed(spark, sf).withColumn("context", F.when(F.col("query_id") % 7 != 0, F.array(F.struct(F.lit(1).alias("rank")))))
    early = answer_gate(F.col("question"), F.col("context"), F.col("query_id") % 3 != 0, F.col("query_id") % 5 != 0)
    return q.select("query_id", early.alias("reply"))


def _block(spark, sf):
    """All chunks of every conversation's block of documents, as context."""
    i = F.regexp_extract("chunk_id", r"\d+", 0).cast("long")
    c = I.chunks(spark, sf).withColumn("conv_id", F.floor(i / 10)).withColumn("rank", (i % 10 + 1).cast("int"))
    c = with_resolved(c, _catalog(spark, sf))
    fields = ["rank", "document_name", "page_number", "section_title", "modality", "content", "media_path", "caption", "resolved_media"]
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("context"))


def _replies(spark, sf, suffixes):
    """All turns with a suffix by key, next to their context chunks."""
    k = (F.col("conv_id") + F.col("turn")) % len(suffixes)
    t = I.table(spark, sf, "conversations").withColumn("answer", F.concat("text", I.pick(suffixes, k)))
    t = t.withColumn("answer", F.replace("answer", F.lit("{x}"), (F.col("conv_id") * 10).cast("string")))
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "turn", "role", "answer").join(_block(spark, sf), "conv_id")


CITES = ["", " [Chunk 1]", " [chunk 99] 【Chunk 9, Page 7】", " [Document: x y, Page 3] ok"]
IMAGES = ["", " ![a](media/fig_{x}.png) end", " ![](other/fig_{x}.png)", " ![cut](media/fi"]
CLAIMS = [" [src{n}", " in 1873 as [Unknown_ledger, Page 2] says", " The garrison had 3,107 men.", " The archive does not specify it.", " | a | b |\n|---|---|\n| 1 | 2 |"]
BLOCK = f"""{CHUNKS}, ctx AS (SELECT doc_id // 10 AS conv_id, list({{'name': document_name, 'caption': caption, 'section': section_title, 'content': content, 'modality': modality, 'media': media_path,
  'resolved': CASE WHEN media_path IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels) THEN 'data/' || media_path END}} ORDER BY doc_id) AS c
  FROM ch GROUP BY ALL), t AS (SELECT conv_id * 1000 + turn AS query_id, role, text, (conv_id + turn) % 4 AS k, c FROM conversations JOIN ctx USING (conv_id))"""


def cite_normalize(spark, sf):
    r = _replies(spark, sf, CITES)
    return r.select("query_id", F.md5(normalize_citations(F.col("answer"), F.col("context"))).alias("answer_md5"))


CITE_SQL = f"""WITH {BLOCK} SELECT query_id, md5(CASE k WHEN 0 THEN rtrim(text, ' ' || chr(10)) || chr(10) || chr(10) || 'Source: [' || c[1].name || ', Page 1]'
  WHEN 1 THEN text || ' [' || c[1].name || ', Page 1]' WHEN 2 THEN text || ' [chunk 99] [' || c[9].name || ', Page 7]'
  ELSE text || ' [x y, Page 3] ok' || chr(10) || chr(10) || 'Source: [' || c[1].name || ', Page 1]' END) AS answer_md5 FROM t"""


def media_fix(spark, sf):
    out = fix_media(checkpointed(_replies(spark, sf, IMAGES)).select("query_id", "answer", "context"), _catalog(spark, sf))
    return out.select("query_id", F.md5("answer").alias("answer_md5"))


MEDIA_SQL = f"""WITH {BLOCK}, u AS (SELECT *, trim(text, ' ' || chr(10)) AS b, c[1].resolved AS res, list_filter(c, lambda y: y.resolved IS NOT NULL)[1] AS f, chr(10) || chr(10) || '![' || f['caption'] || '](' || f['resolved'] || ')' || chr(10)
    || '*Figure: ' || f['caption'] || ' — [' || f['name'] || ', Page 1]*' AS added FROM t)
SELECT query_id, md5(CASE k WHEN 0 THEN b || coalesce(added, '') WHEN 1 THEN trim(text || ' ![a](' || coalesce(res, c[1].media) || ') end', ' ' || chr(10))
  WHEN 2 THEN trim(text || CASE WHEN res IS NULL THEN ' ![](other/' || split_part(c[1].media, '/', 2) || ')' ELSE ' ![' || c[1].caption || '](' || res || ')' END, ' ' || chr(10))
  ELSE b || coalesce(added, '') END) AS answer_md5 FROM u"""


def message_split(spark, sf):
    r = _replies(spark, sf, IMAGES)
    return r.select("query_id", F.posexplode(message_parts(F.col("answer"))).alias("pos", "p")).select(
        "query_id", (F.col("pos") + 1).alias("part"), F.col("p.kind").alias("kind"), F.md5("p.text").alias("text_md5"), F.coalesce("p.path", F.lit("")).alias("path")
    )


SPLIT_SQL = f"""WITH {BLOCK}, u AS (SELECT query_id, k, c[1].media AS m, trim(text, ' ' || chr(10)) AS b, trim(text || ' ![cut](media/fi', ' ' || chr(10)) AS broken FROM t)
SELECT query_id, 1 AS part, 'prose' AS kind, md5(CASE WHEN k = 3 THEN broken ELSE b END) AS text_md5, '' AS path FROM u
UNION ALL SELECT query_id, 2, 'image', md5(CASE WHEN k = 1 THEN 'a' ELSE '' END), CASE WHEN k = 1 THEN m ELSE 'other/' || split_part(m, '/', 2) END FROM u WHERE k IN (1, 2)
UNION ALL SELECT query_id, 3, 'prose', md5('end'), '' FROM u WHERE k = 1"""


# --------------------------------------------------------------- evaluation
def qa(spark, sf):
    """Every user turn with the assistant turn that follows it (or none), plus a claim by key."""
    t = I.table(spark, sf, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % len(CLAIMS)
    reply = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    asked = I.asked(spark, sf).join(reply, ["conv_id", "turn"], "left").join(_block(spark, sf), "conv_id")
    first = F.get("context", F.lit(0))["document_name"]
    claim = F.when(k == 0, F.concat(F.lit(" ["), first, F.lit(", Page 1]"))).otherwise(I.pick(CLAIMS, k))
    return checkpointed(
        asked.select(
            "query_id", "question", F.concat(F.coalesce("reply", F.lit("")), claim).alias("answer"), "context",
            F.concat(I.pick(["1a_", "1b_"], F.col("conv_id")), "query_id").alias("qid"),
            F.lit("1A: turns").alias("track"), (F.col("conv_id") * 10 + F.col("turn")).alias("event_id"),
        )
    )


def _target():
    return detect_modality_intent(F.col("question"))


def precision(spark, sf):
    return qa(spark, sf).withColumn("t", _target()).select("query_id", E.retrieval_precision(F.col("question"), F.col("context"), F.col("t")).alias("retrieval_precision"))


def citation(spark, sf):
    a, c = F.col("answer"), F.col("context")
    return qa(spark, sf).select("query_id", E.citation_accuracy(a, c).alias("citation_accuracy"), E.citation_accuracy(a, c, strict=True).alias("strict_accuracy"))


def halluc(spark, sf):
    return qa(spark, sf).select("query_id", E.hallucination(F.col("answer"), F.col("context")).alias("hallucination"))


def modality(spark, sf):
    return qa(spark, sf).withColumn("t", _target()).select("query_id", E.modality_success(F.col("answer"), F.col("context"), F.col("t"), F.lit(False)).alias("modality_success"))


def _results(spark, sf):
    latency = I.table(spark, sf, "events").select("event_id", F.col("value").alias("latency_sec"))
    rows = qa(spark, sf)
    timed = rows.select("query_id", "event_id").join(latency, "event_id").drop("event_id")
    return evaluate_answers(rows, _catalog(spark, sf), timed)


def summary(spark, sf):
    return E.evaluation_summary(checkpointed(_results(spark, sf)))


def report(spark, sf):
    return E.report_rows(checkpointed(_results(spark, sf)).withColumn("latency_sec", F.format_number("latency_sec", 2)))


def _benchmark(spark, sf):
    """Benchmark texts as questions: plain ones, comparisons of two of their words, and
    openers that ask for totals or a figure."""
    words = F.regexp_extract_all("question", F.lit("[A-Za-z]{4,}"), F.lit(0))
    pair = F.concat(F.lit('Compare the cost of "'), F.get(words, F.lit(0)), F.lit('" and "'), F.get(words, F.lit(1)), F.lit('"'))
    kind = F.col("query_id") % 4
    text = F.when(kind == 1, pair).when(kind == 2, F.concat(F.lit("total sum of "), "question")).when(kind == 3, F.concat(F.lit("Show me the figure of "), "question"))
    return I.questions(spark, sf).select(
        "query_id", F.concat(I.pick(["1a_", "1b_"], F.col("query_id")), "query_id").alias("qid"), F.lit("1A: benchmark").alias("track"),
        F.coalesce(text, "question").alias("question"),
    )


def answer_e2e(spark, sf):
    """Retrieve, gate and answer every benchmark question."""
    asked = _benchmark(spark, sf).select("query_id", "question")
    packed = checkpointed(retrieve(asked, I.chunks(spark, sf)))
    return generate_answers(asked, packed, _catalog(spark, sf)).select("query_id", "question", "answer", F.size("context").alias("n_chunks"))


def benchmark_e2e(spark, sf):
    """Retrieve, answer, evaluate: one row of metrics per benchmark question."""
    latency = I.table(spark, sf, "events").select(F.col("event_id").alias("query_id"), F.col("value").alias("latency_sec"))
    return run_benchmark(_benchmark(spark, sf), I.chunks(spark, sf), _catalog(spark, sf), latency)[0]


V, T = count_hits("ml", L.VISUAL_PATTERNS), count_hits("ml", L.TABULAR_PATTERNS)
CLAIM_SQL = "CASE k5 WHEN 0 THEN ' [' || c[1].name || ', Page 1]' ELSE " + lst([x.replace("\n", "~") for x in CLAIMS]) + "[k5 + 1] END"
PN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
EVAL = f"""WITH {ASKED}, {BLOCK}, e0 AS (SELECT a.query_id, a.question, {ascii_words('lower(a.question)')} AS ml, ctx.c, (a.conv_id + a.turn) % 5 AS k5, a.conv_id * 10 + a.turn AS event_id,
    ['1a_', '1b_'][a.conv_id % 2 + 1] || a.query_id AS qid, coalesce(r.text, '') AS reply
  FROM asked a LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1 AND r.role = 'assistant' JOIN ctx ON ctx.conv_id = a.conv_id),
e1 AS (SELECT *, reply || replace({CLAIM_SQL}, '~', chr(10)) AS answer, {V} AS v, {T} AS tb,
  lower(array_to_string(list_transform(c, lambda x: x.name || ' ' || coalesce(x.caption, '') || ' ' || x.section || ' ' || x.content), ' ')) AS facts FROM e0),
e2 AS (SELECT *, CASE WHEN v > 0 AND v >= tb THEN 'image-caption' WHEN tb > 0 THEN 'table' ELSE 'text' END AS target,
  list_filter(list_transform(regexp_extract_all({ascii_words('question')}, '\\b[A-Za-z]{{3,}}\\b'), lambda w: lower(w)), lambda w: NOT list_contains({lst(L.EVALUATION_STOP)}, w)) AS ws,
  regexp_extract_all(answer, '\\[([A-Za-z0-9_\\-.\\s]+?)(?:,\\s*(?:Page|page|P\\.|p\\.)?\\s*(\\d+))?\\]', 1) AS cited,
  list_filter(regexp_extract_all({ascii_words("array_to_string(list_filter(string_split(answer, chr(10)), lambda l: NOT (" + ' OR '.join(f"starts_with(trim(l), {s(o)})" for o in L.EVALUATION_SKIPPED_OPENERS) + ")), ' ')")}, '{PN}'),
    lambda n: NOT list_contains({lst(L.EVALUATION_STOP_ENTITIES)}, n)) AS names FROM e1),
e AS (SELECT *, len(list_filter(c, lambda x: len(list_filter(ws, lambda w: contains(lower(x.content || ' ' || x.name || ' ' || coalesce(x.caption, '')), w))) > 0)) > 0 AS p,
  CASE WHEN len(cited) = 0 THEN contains(lower(answer), 'not specify')
    ELSE len(list_filter(cited, lambda d: len(list_filter(c, lambda x: contains(x.name, lower(trim(d))) OR contains(lower(trim(d)), x.name))) > 0)) > 0 END AS citation_accuracy,
  CASE WHEN {any_in('lower(answer)', L.REFUSAL_MARKERS)} THEN false ELSE
    (regexp_matches(answer, '\\b1873\\b') AND NOT contains(facts, '1873')) OR (contains(answer, '3,107') AND NOT contains(facts, '3,107') AND NOT contains(replace(facts, ',', ''), '3107'))
    OR (len(names) >= 3 AND len(list_filter(names, lambda n: len(list_filter(regexp_split_to_array(n, '\\s+'), lambda t: length(t) > 3 AND contains(facts, lower(t)))) = 0)) / greatest(len(names), 1) > 0.35) END AS hallucination,
  CASE target WHEN 'image-caption' THEN len(list_filter(c, lambda x: x.modality = 'image-caption' AND x.resolved IS NOT NULL)) > 0
    WHEN 'table' THEN (k5 = 4) OR len(list_filter(c, lambda x: x.modality = 'table' AND contains(x.content, '|'))) > 0 ELSE true END AS modality_success
  FROM e2)"""
SUMMARY_SQL = EVAL + """, f AS (SELECT e.*, value AS latency, (target <> 'text' OR starts_with(qid, '1a_')) AS counted FROM e LEFT JOIN events USING (event_id)),
g AS (SELECT count(*) AS n, count(*) FILTER (p) AS a, count(*) FILTER (citation_accuracy) AS b, count(*) FILTER (hallucination) AS h, count(*) FILTER (counted) AS mt, count(*) FILTER (counted AND modality_success) AS mp,
  avg(latency) AS l, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95 FROM f)
SELECT n AS total_questions, a AS retrieval_pass, b AS citation_pass, h AS hallucination_count, mt AS modality_total, mp AS modality_pass, round_even(a / n * 100, 1) AS retrieval_precision_pct,
  round_even(b / n * 100, 1) AS citation_accuracy_pct, round_even(h / n * 100, 1) AS hallucination_pct, round_even(mp / mt * 100, 1) AS modality_success_pct,
  round_even(l, 2) AS average_latency_seconds, round_even(p50, 2) AS median_p50_latency_seconds, round_even(p95, 2) AS p95_latency_seconds FROM g"""
REPORT_SQL = EVAL + """, f AS (SELECT e.*, value AS latency, (target <> 'text' OR starts_with(qid, '1a_')) AS counted, replace(question, '|', '\\|') AS qt FROM e JOIN events USING (event_id))
SELECT qid, '| **' || qid || '** | 1A | ' || CASE WHEN length(qt) > 48 THEN left(qt, 45) || '...' ELSE qt END || ' | ' || CASE WHEN p THEN '✅ Pass' ELSE '❌ Fail' END || ' | ' ||
  CASE WHEN citation_accuracy THEN '✅ Pass' ELSE '❌ Fail' END || ' | ' || CASE WHEN NOT counted OR modality_success THEN '✅ Pass' ELSE '❌ Fail' END || ' | ' || printf('%.2f', latency) || 's |' AS line FROM f"""

GATE_SQL = f"""WITH {ROUTED}, r AS (SELECT *, trim(lower(question)) AS t, {ascii_words('trim(lower(question))')} AS m FROM routed), c AS (SELECT *, {SCOPE} AS category FROM r)
SELECT query_id, CASE {' '.join(f"WHEN category = {s(k)} THEN {s(v)}" for k, v in L.SCOPE_MESSAGES.items())}
  WHEN query_id % 7 = 0 OR query_id % 3 = 0 THEN {s(L.NOT_IN_ARCHIVE)} WHEN query_id % 5 = 0 THEN {s(L.NO_INFORMATION)} || question || '''.' END AS reply FROM c"""

QUERIES = {
    "context_prompt": prompt, "grounded_answer": grounded, "answer_gate": gate, "cite_normalize": cite_normalize, "media_fix": media_fix,
    "message_split": message_split, "eval_precision": precision, "eval_citation": citation, "eval_hallucination": halluc,
    "eval_modality": modality, "eval_summary": summary, "metrics_report": report, "answer_e2e": answer_e2e, "benchmark_e2e": benchmark_e2e,
}
SQL = {
    "context_prompt": PROMPT_SQL, "grounded_answer": GROUNDED_SQL, "answer_gate": GATE_SQL, "cite_normalize": CITE_SQL, "media_fix": MEDIA_SQL, "message_split": SPLIT_SQL,
    "eval_precision": EVAL + " SELECT query_id, p AS retrieval_precision FROM e",
    "eval_citation": EVAL + " SELECT query_id, citation_accuracy, citation_accuracy AS strict_accuracy FROM e",
    "eval_hallucination": EVAL + " SELECT query_id, hallucination FROM e",
    "eval_modality": EVAL + " SELECT query_id, modality_success FROM e",
    "eval_summary": SUMMARY_SQL, "metrics_report": REPORT_SQL,
}
