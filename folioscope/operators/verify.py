"""Gate that drops distractors, coverage counts and the sufficiency verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import let
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.matching import entity_matches, evidence_text, field_text, matched_fields


def is_table_like() -> Column:
    return (F.col("modality") == "table") | F.contains(F.coalesce("content", F.lit("")), F.lit("|"))


def with_gate(rows: DataFrame, strict: bool = True, lex: Lexicon = DEFAULT) -> DataFrame:
    """Add verified_entities, verified_fields and the boolean ``kept``."""
    verified = let(evidence_text(), lambda text: F.filter("entities", lambda e: entity_matches(text, e)))
    by_table = is_table_like() & (F.size("verified_fields") > 0)
    kept = (F.size("entities") == 0) | (F.size("verified_entities") > 0) | by_table
    return (
        rows.withColumn("verified_entities", verified)
        .withColumn("verified_fields", matched_fields(field_text(), F.col("fields"), lex))
        .withColumn("kept", kept if strict else F.lit(True))
    )


def coverage(queries: DataFrame, gated: DataFrame, asked: str, verified: str, name: str) -> DataFrame:
    """(query_id, name, matching_chunks, found) for everything asked, zeros kept."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(asked)).alias(name))
    counts = (
        gated.where("kept")
        .select("query_id", F.explode(F.array_distinct(verified)).alias(name))
        .groupBy("query_id", name)
        .agg(F.count(F.lit(1)).alias("matching_chunks"))
    )
    return wanted.join(counts, ["query_id", name], "left").select(
        "query_id",
        name,
        F.coalesce("matching_chunks", F.lit(0)).alias("matching_chunks"),
        F.col("matching_chunks").isNotNull().alias("found"),
    )


def entity_coverage(queries: DataFrame, gated: DataFrame) -> DataFrame:
    return coverage(queries, gated, "entities", "verified_entities", "entity")


def field_coverage(queries: DataFrame, gated: DataFrame) -> DataFrame:
    return coverage(queries, gated, "fields", "verified_fields", "field")


def verification_report(queries: DataFrame, gated: DataFrame) -> DataFrame:
    """One row per query: verdict, reason, counts, coverage maps, pruned chunks.

    ``gated`` holds the retrieved candidates of each query, a bounded number.
    """
    kept = F.col("kept")
    seen = gated.groupBy("query_id").agg(
        F.count_if(kept).alias("retained_count"),
        F.count_if(~kept).alias("pruned_count"),
        F.flatten(F.collect_list(F.when(kept, F.col("verified_entities")))).alias("_entities"),
        F.flatten(F.collect_list(F.when(kept, F.col("verified_fields")))).alias("_fields"),
        F.coalesce(F.bool_or(kept & is_table_like()), F.lit(False)).alias("_table"),
        F.array_sort(
            F.collect_list(
                F.when(
                    ~kept,
                    F.struct("chunk_id", "document_name", F.lit("mentions none of the entities asked for").alias("reason")),
                )
            )
        ).alias("pruned_details"),
    )

    def covered(asked: str, hits: str) -> Column:
        return F.map_from_entries(
            F.transform(
                F.array_distinct(asked),
                lambda a: F.struct(
                    a,
                    F.struct(
                        F.array_contains(F.col(hits), a).alias("found"),
                        F.size(F.filter(hits, lambda h: h == a)).cast("long").alias("matching_chunks"),
                    ),
                ),
            )
        )

    none = F.array().cast("array<string>")
    base = (
        queries.select("query_id", "entities", "fields", "is_comparative")
        .join(seen, "query_id", "left")
        .withColumn("retained_count", F.coalesce("retained_count", F.lit(0)))
        .withColumn("pruned_count", F.coalesce("pruned_count", F.lit(0)))
        .withColumn("_entities", F.coalesce("_entities", none))
        .withColumn("_fields", F.coalesce("_fields", none))
    )
    any_entity = F.size(F.array_intersect("entities", "_entities")) > 0
    missing = (F.size("entities") > 0) & ~any_entity
    by_table = F.col("_table") & (F.size("_fields") > 0)
    reason = (
        F.when(F.col("retained_count") + F.col("pruned_count") == 0, F.lit("nothing was retrieved"))
        .when(F.col("retained_count") == 0, F.concat(F.lit("no record mentions: "), F.array_join("entities", ", ")))
        .when(
            missing & F.col("is_comparative"),
            F.concat(F.lit("no record on any side of the comparison: "), F.array_join("entities", ", ")),
        )
        .when(
            missing & ~F.col("is_comparative") & ~by_table,
            F.concat(F.lit("not present in the retrieved records: "), F.element_at("entities", 1)),
        )
    )
    return base.select(
        "query_id",
        reason.isNull().alias("is_sufficient"),
        reason.alias("rejection_reason"),
        covered("entities", "_entities").alias("entity_coverage"),
        covered("fields", "_fields").alias("field_coverage"),
        "is_comparative",
        "retained_count",
        "pruned_count",
        "pruned_details",
    )
