"""Everything that is read off a question alone (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.functions.text import (
    bounded,
    contains_any,
    in_list,
    matches,
    matches_any,
    query_tokens,
    strip,
)
from folioscope.lexicon import DEFAULT, Lexicon

ANY_CASE = "(?Udi)"
# Question shapes that decide entities and sub-questions.
PAIR = ANY_CASE + r"(?:compare|difference between)\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\?|$)"
VERSUS = ANY_CASE + r"(.+?)\s+(?:vs\.?|versus)\s+(.+?)(?:\?|$)"
# Looked for first: without it, VERSUS reads the rest of a question from each of its characters.
VERSUS_WORD = ANY_CASE + r"\s(?:vs|versus)"
RELATION = ANY_CASE + r"(mentor|successor|founder|leader|commander)\s+of\s+(.+?)(?:\s+who|\s+and|\?|$)"
TITLE_RUN = r"(?U)\b[A-Z][a-zA-Z0-9_\-]*(?:\s+[A-Z][a-zA-Z0-9_\-]*)*\b"
QUOTED = r"(?d)[\"'](.*?)[\"']"


# ---------------------------------------------------------------- scope guard
def scope_category(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """empty > greeting > farewell > inappropriate > personal > out_of_scope > in_scope."""
    text = F.lower(strip(F.coalesce(question, F.lit(""))))
    bare = strip(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""))
    tokens = F.split(bare, r"(?U)\s+")
    greeting = (
        in_list(bare, L.GREETING_PHRASES)
        | in_list(text, L.GREETING_PHRASES)
        | ((bare != "") & F.forall(tokens, lambda t: in_list(t, L.GREETING_TOKENS)))
    )
    return (
        F.when(text == "", "empty")
        .when(greeting, "greeting")
        .when(in_list(bare, L.FAREWELL_PHRASES), "farewell")
        .when(matches_any(text, lex.inappropriate), "inappropriate")
        .when(matches_any(text, lex.personal), "personal_physical")
        .when(matches_any(text, lex.out_of_scope), "out_of_scope")
        .otherwise("in_scope")
    )


def scope_guard(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """struct<is_handled, message, category>."""
    category = scope_category(question, lex)
    message = F.create_map(*[F.lit(x) for kv in lex.scope_messages.items() for x in kv])
    return F.struct(
        (category != "in_scope").alias("is_handled"),
        F.try_element_at(message, category).alias("message"),
        category.alias("category"),
    )


# --------------------------------------------------------------------- intent
def query_intent(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """struct<intent, target_modality, boost_weight, matched_terms>."""
    text = F.lower(strip(question))

    def matched(patterns: list[str]) -> Column:
        hits = F.array(*[F.when(matches(text, p), F.lit(p)) for p in patterns])
        return F.array_compact(hits)

    visual, tabular = matched(lex.visual), matched(lex.tabular)
    is_visual = (F.size(visual) > 0) & (F.size(visual) >= F.size(tabular))
    is_tabular = F.size(tabular) > 0

    def pick(v, t, n) -> Column:
        return F.when(is_visual, v).when(is_tabular, t).otherwise(n)

    return F.struct(
        pick(F.lit("visual"), F.lit("tabular"), F.lit("narrative_text")).alias("intent"),
        pick(F.lit("image-caption"), F.lit("table"), F.lit("text")).alias("target_modality"),
        pick(F.lit(1.6), F.lit(1.4), F.lit(1.0)).alias("boost_weight"),
        pick(visual, tabular, F.array().cast("array<string>")).alias("matched_terms"),
    )


def detect_modality_intent(question: Column, lex: Lexicon = DEFAULT) -> Column:
    return query_intent(question, lex)["target_modality"]


def modality_target(question: Column, override: Column, boost: float = 1.5, lex: Lexicon = DEFAULT) -> Column:
    """struct<target_modality, boost_weight> with an optional forced modality."""
    intent = query_intent(question, lex)
    return F.struct(
        F.coalesce(override, intent["target_modality"]).alias("target_modality"),
        F.when(override.isNotNull(), F.lit(boost)).otherwise(intent["boost_weight"]).alias("boost_weight"),
    )


# ----------------------------------------------------------- fields, entities
def requested_fields(question: Column, lex: Lexicon = DEFAULT) -> Column:
    """Field families whose alias occurs as whole words, in lexicon order."""
    text = F.lower(question)
    return F.array_compact(
        F.array(*[F.when(text.rlike(bounded(a)), F.lit(f)) for f, a in lex.field_aliases.items()])
    )


def clean_entity_phrase(phrase: Column, lex: Lexicon = DEFAULT) -> Column:
    """Drop punctuation, leading helper words, 'fields of' prefixes, prepositions."""
    aliases = "|".join(lex.aliases)
    text = F.btrim(strip(phrase), F.lit(",.?!\"'"))
    for pattern in (L.PHRASE_LEAD, L.PHRASE_FIELDS.replace("ALIASES", aliases), L.PHRASE_PREPOSITION):
        text = strip(F.regexp_replace(text, ANY_CASE + pattern, ""))
    return text


def with_entities(queries: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Add ``entities``: quoted phrases and Title-Case runs; else a compared
    pair; else the leftover words as one phrase.

    Each stage is a column of its own, so that no expression is evaluated twice.
    """
    text = F.col("_text")
    stop = sorted(set(lex.entity_stop) | set(lex.entity_corpus_stop))
    generic = sorted(set(lex.entity_stop) | set(lex.alias_words))
    none = F.array().cast("array<string>")

    def named(e: Column) -> Column:
        return ~in_list(F.lower(e), stop)

    def clean(phrases: Column) -> Column:
        return F.transform(phrases, lambda p: clean_entity_phrase(p, lex))

    def sides(pattern: str) -> Column:
        return F.array(*[F.regexp_extract(text, pattern, i) for i in (1, 2)])

    quoted = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), strip),
        lambda e: (F.length(e) >= 3) & named(e),
    )
    runs = F.filter(
        clean(F.regexp_extract_all(text, F.lit(TITLE_RUN), F.lit(0))),
        lambda e: (F.length(e) >= 3)
        & named(e)
        & F.exists(F.split(e, r"(?U)\s+"), lambda w: ~in_list(F.lower(w), generic)),
    )
    pair = F.filter(
        clean(F.when(text.rlike(PAIR), sides(PAIR)).when(text.rlike(VERSUS_WORD) & text.rlike(VERSUS), sides(VERSUS)).otherwise(none)),
        lambda e: (e != "") & named(e),
    )
    leftover = F.filter(query_tokens(text), lambda t: named(t) & ~in_list(F.lower(t), lex.alias_words))
    return (
        queries.withColumn("_text", strip(F.col("question")))
        .withColumn("_proper", _add_new(quoted, runs))
        .withColumn("_pair", _add_new(none, pair))
        .withColumn("_left", leftover)
        .withColumn(
            "entities",
            F.when(F.size("_proper") > 0, F.col("_proper"))
            .when(F.size("_pair") > 0, F.col("_pair"))
            .when(F.size("_left") > 0, F.array(F.array_join("_left", " ")))
            .otherwise(none),
        )
        .drop("_text", "_proper", "_pair", "_left")
    )


def _add_new(known: Column, more: Column) -> Column:
    """Append what is not yet known, ignoring case."""
    return F.aggregate(
        more,
        known,
        lambda acc, e: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(e)), acc).otherwise(
            F.concat(acc, F.array(e))
        ),
    )


def is_comparative(question: Column, found: Column) -> Column:
    return (F.size(found) >= 2) | contains_any(F.lower(question), L.STRUCTURE_COMPARATIVE)


# --------------------------------------------------------- budget, complexity
def query_budget(question: Column, found: Column) -> Column:
    """struct<intent, target_k, min_k, is_visual, is_comparative, is_quantitative>."""
    text = F.lower(strip(question))
    n = F.coalesce(F.size(found), F.lit(0))
    visual = text.rlike(bounded(L.BUDGET_VISUAL_WORDS))
    fact = contains_any(text, L.BUDGET_SINGLE_FACT) & ~contains_any(text, ["compare", "difference"])
    comparative = (n >= 2) | contains_any(text, L.BUDGET_COMPARATIVE)
    quantitative = text.rlike(bounded(L.BUDGET_QUANTITATIVE_WORDS))
    multi_hop = contains_any(text, L.BUDGET_MULTI_HOP)

    def pick(v, f, c, q, o) -> Column:
        return F.when(visual, v).when(fact, f).when(comparative, c).when(quantitative | multi_hop, q).otherwise(o)

    return F.struct(
        pick("visual", "single_fact", "comparative", "quantitative_or_multihop", "standard_narrative").alias("intent"),
        pick(2, 2, F.least(F.lit(8), F.greatest(F.lit(6), n * 3)), 6, 4).cast("int").alias("target_k"),
        pick(1, 1, 2, 2, 2).cast("int").alias("min_k"),
        visual.alias("is_visual"),
        comparative.alias("is_comparative"),
        quantitative.alias("is_quantitative"),
    )


def query_complexity(question: Column) -> Column:
    text = F.lower(strip(question))
    return (
        F.when(text == "", "simple")
        .when(matches_any(text, L.COMPARATIVE_PATTERNS), "comparative")
        .when(matches_any(text, L.MULTI_HOP_PATTERNS), "multi_hop")
        .when(matches_any(text, L.QUANTITATIVE_PATTERNS), "quantitative")
        .when(matches_any(text, L.GLOBAL_SUMMARY_PATTERNS), "global_summary")
        .otherwise("simple")
    )


def decompose(question: Column, complexity: Column, found: Column, fields: Column) -> Column:
    """Sub-questions of a complex question, the question itself first."""
    text = strip(question)
    topic = F.when(F.size(fields) > 0, F.array_join(fields, " ")).otherwise(F.lit(L.DEFAULT_FIELD_PHRASE))

    def about(e: Column) -> Column:
        return F.concat_ws(" ", e, topic)

    many = F.size(found) >= 2
    sides = F.when(
        text.rlike(PAIR), F.array(*[about(strip(F.regexp_extract(text, PAIR, i))) for i in (1, 2)])
    ).otherwise(F.array().cast("array<string>"))
    relation, subject = [strip(F.regexp_extract(text, RELATION, i)) for i in (1, 2)]
    hops = F.when(
        text.rlike(RELATION),
        F.array(
            F.format_string(L.RELATION_SUBQUERIES[0], relation, subject),
            F.format_string(L.RELATION_SUBQUERIES[1], subject, relation),
        ),
    ).otherwise(F.array().cast("array<string>"))
    extra = (
        F.when(complexity == "simple", F.array().cast("array<string>"))
        .when(many, F.transform(found, about))
        .when(complexity == "comparative", sides)
        .when(complexity == "multi_hop", hops)
        .when(complexity == "quantitative", F.array(F.concat(F.lit("table ledger "), topic, F.lit(" "), text)))
        .otherwise(F.array(F.lit(L.SUMMARY_SUBQUERY)))
    )
    return _add_new(F.array(text), extra)


# ------------------------------------------------------------------ DataFrame
def analyze_structure(queries: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Add entities, fields, is_comparative, entity_count and field_count."""
    q = F.col("question")
    return (
        with_entities(queries, lex)
        .withColumn("fields", requested_fields(q, lex))
        .withColumn("is_comparative", is_comparative(q, F.col("entities")))
        .withColumn("entity_count", F.size("entities"))
        .withColumn("field_count", F.size("fields"))
    )


def with_features(
    queries: DataFrame, lex: Lexicon = DEFAULT, modality_override: Column | None = None, top_k: Column | None = None
) -> DataFrame:
    """All retrieval features of ``queries(query_id, question)``.

    ``top_k`` null or absent means the adaptive budget decides.
    """
    q = F.col("question")
    override = (modality_override if modality_override is not None else F.lit(None)).cast("string")
    wanted = (top_k if top_k is not None else F.lit(None)).cast("int")
    target_k = F.coalesce(wanted, F.col("budget")["target_k"])
    return (
        analyze_structure(queries, lex)
        .withColumn("scope", scope_category(q, lex))
        .withColumn("target", modality_target(q, override, lex=lex))
        .withColumn("budget", query_budget(q, F.col("entities")))
        .withColumn("complexity", query_complexity(q))
        .withColumn("sub_queries", decompose(q, F.col("complexity"), F.col("entities"), F.col("fields")))
        .withColumn("effective_k", target_k)
        .withColumn("min_k", F.col("budget")["min_k"])
        .withColumn("candidate_k", F.greatest(F.col("effective_k") * 2, F.lit(10)))
    )
