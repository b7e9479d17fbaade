"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import dedup, jaccard, mixing, negatives, packing, privacy, quality, rules, sharding, spans, spelling, tokens, vectors
from folioscope.llm.common import table


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), 2048)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the separator is the vocabulary's end-of-text id
    return tokens.document_tokens(table(spark, sf_dir, "documents"), packing.vocabulary(), separator=50256)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return privacy.personal_data(docs, privacy.train(docs))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_sentences", "n_removed", "removed_chars", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    forest = quality.train(docs, labels.where(~held_out))
    score = quality.scored(forest, F.col("text"))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.host_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 1 << 20).select("doc_id", "bytes", "depth", "prefix", "page", "shard_bytes")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mistyped(doc_id: Column, run: Column) -> Column:
        """The run without one code point, in one of 97 cases that depend on id and run."""
        h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    words = spelling.word_counts(table(spark, sf_dir, "documents"), change=mistyped)
    found = spelling.variants(words.where((F.length("word") >= 5) & (F.col("n") >= 3)))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_pack": op2_pack,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_jaccard": op5_jaccard,
    "op6_mix": op6_mix,
    "op7_span_dedup": op7_span_dedup,
    "op8_quality": op8_quality,
    "op9_host_rules": op9_host_rules,
    "op10_shards": op10_shards,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling": op13_spelling,
}
SQL: dict[str, str] = {"op9_host_rules": rules.SQL, "op10_shards": sharding.SQL, "op11_exact_dedup": dedup.SQL, "op12_hard_negatives": negatives.SQL}
