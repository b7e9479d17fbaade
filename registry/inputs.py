"""Typed inputs that the registered queries derive from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.operators.postings import PostingIndex, build_postings
from folioscope.operators.query_features import analyze_structure
from folioscope.session import checkpointed, shared_folder, spread
from folioscope.sizing import small_side

PATH_PREFIXES = ["codex/", "wiki/", "chronicles/", "ephemera/trial_", "ephemera/ballad_", "ephemera/ledger_", "ephemera/letter_", "ephemera/auction_", "misc/"]
RELIABILITIES = ["official_codex", "wiki", "novel", "ephemera_trial", "ephemera_tavern", "ephemera", "unverified", "ballad", "archive_record"]

# Openers that make the prose of the given turns reach every routing rule.
TRIGGERS = [
    "", "Show me the diagram of ", "compare the total cost with ", "who was the mentor of ", "What is the capital of France and ",
    "an overview of all battles near ", "give me the stats table for ", "what am i holding near ", "when was it signed: ",
    "how many soldiers and what garrison strength ", "which is larger, the effective range or ", "what happened after the fleet fell ",
    "die ", "Hello there ", "the sum of ", "tell me about the blueprint and ledger ",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], key) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per document, with modality, media and reliability by id."""
    i = F.col("doc_id")
    image = i % 5 == 0
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), i, F.lit("_p1_c01")).alias("chunk_id"),
        F.concat("source", F.lit("_"), i, F.lit(".txt")).alias("document_name"),
        F.lit("txt").alias("document_type"),
        F.lit(1).alias("page_number"),
        F.concat(F.lit("Section "), "lang").alias("section_title"),
        F.when(image, "image-caption").when(i % 5 == 1, "table").otherwise("text").alias("modality"),
        F.col("text").alias("content"),
        F.when(image, F.concat(F.lit("media/fig_"), i, F.lit(".png"))).alias("media_path"),
        F.when(image, F.concat(F.lit("Figure of "), "source")).alias("caption"),
        pick(RELIABILITIES, i).alias("source_reliability"),
    )


INDEXES: dict[tuple[str, str], PostingIndex] = {}


def posting_index(spark: SparkSession, sf_dir: str) -> PostingIndex:
    """The stored postings of ``chunks``: built by the first query of a session that
    asks, opened by all later ones."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in INDEXES:
        INDEXES[key] = build_postings(chunks(spark, sf_dir), f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    return INDEXES[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ext = pick([".md", ".pdf", ".docx", ".scan.pdf", ".markdown", ".txt", ".TXT"], i)
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", F.concat(pick(PATH_PREFIXES, i), "source", F.lit("_"), i, ext).alias("path")
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a question, with a routing opener by its key."""
    opener = pick(TRIGGERS, F.col("conv_id") * 7 + F.col("turn"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(opener, "text").alias("question")
    )


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that quote the longest word of a document."""
    opener = pick(TRIGGERS, F.col("conv_id") * 7 + F.col("turn"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    # only documents with such a turn are searched for words
    known = checkpointed(turns.select("conv_id").distinct())
    of_turns = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "conv_id").join(small_side(known, 32), "conv_id", "left_semi")
    docs = spread(of_turns.select("conv_id", "text")).select(
        "conv_id", F.concat(F.lit('"'), longest["word"], F.lit('" ')).alias("quote")
    )
    return turns.join(docs, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        "conv_id",
        "turn",
        F.concat(opener, "quote", "text").alias("question"),
    )


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(analyze_structure(asked(spark, sf_dir)))


def candidates(spark: SparkSession, sf_dir: str, questions: DataFrame | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ten scored candidate chunks per asked question, with its structure.

    ``questions`` are ``structured`` ones at hand; ``prepare`` adds columns to the chunks
    where they meet the questions, once a chunk."""
    questions = structured(spark, sf_dir) if questions is None else questions
    raw = ((F.col("conv_id") * 7 + F.col("j") * 13 + F.col("turn") * 3) % 100) / 100.0
    wide = questions.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        "query_id", "question", "entities", "fields", "is_comparative",
        F.concat(F.lit("doc_"), F.col("conv_id") * 10 + F.col("j"), F.lit("_p1_c01")).alias("chunk_id"),
        raw.alias("raw_similarity"),
        rounded(raw * F.element_at(F.array(F.lit(1.0), F.lit(1.4), F.lit(1.6)), F.col("j") % 3 + 1), 4).alias("relevance_score"),
        (F.col("j") + 1).alias("rank"),
    )
    found = chunks(spark, sf_dir)
    return wide.join(prepare(found.repartition("chunk_id")) if prepare else found, "chunk_id")
