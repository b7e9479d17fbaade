"""Index records of chunks: defaults, searchable text, unique ids, upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import blank_to_null, strip


def _or(c: Column, default: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(default))


def search_text(content: Column, caption: Column, document: Column) -> Column:
    """Content, else the caption, else a line naming the document."""
    return F.coalesce(
        blank_to_null(strip(F.coalesce(content, F.lit("")))),
        F.concat(F.lit("Visual plate caption: "), blank_to_null(caption)),
        F.concat(F.lit("Document passage from "), F.coalesce(document, F.lit("archive"))),
    )


def index_records(chunks: DataFrame) -> DataFrame:
    """Flat index rows of ``chunks`` (nested or flat reliability and word count)."""
    nested = "metadata" in chunks.columns
    reliability = F.col("metadata.source_reliability" if nested else "source_reliability")
    count = F.col("metadata.word_count") if nested else F.lit(None)
    page = F.col("page_number").cast("int")
    return chunks.select(
        _or(F.col("chunk_id"), "").alias("chunk_id"),
        _or(F.col("document_name"), "Unknown").alias("document_name"),
        _or(F.col("document_type"), "txt").alias("document_type"),
        F.coalesce(F.when(page != 0, page), F.lit(1)).alias("page_number"),
        _or(F.col("section_title"), "").alias("section_title"),
        F.coalesce(blank_to_null(F.col("modality")), F.lit("text")).alias("modality"),
        _or(F.col("media_path"), "").alias("media_path"),
        _or(F.col("caption"), "").alias("caption"),
        reliability.alias("source_reliability"),
        count.cast("int").alias("word_count"),
        search_text(F.col("content"), F.col("caption"), F.col("document_name")).alias("document"),
    )


def searchable(records: DataFrame) -> DataFrame:
    """Index rows in the shape that the retrievers read."""
    return records.withColumnRenamed("document", "content")


def index_ids(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Blank and repeated ids become ``chunk_{position}_{document[:10]}``.

    Only the first row of an id keeps it; that row is found by a minimum, which
    combines before the shuffle.  Rows meet it by id and ``order`` together, so those of a
    very frequent id are spread.  ``position`` must be the row's ordinal.
    """
    first = (
        chunks.where(strip(F.col("chunk_id")) != "")
        .groupBy(strip(F.col("chunk_id")).alias("_id"))
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(F.col("_id").alias("_kept"), *[F.col(f"_first.{c}").alias(f"_first_{i}") for i, c in enumerate(order)])
    )
    made = F.concat(
        F.lit("chunk_"), F.lpad(F.col("position").cast("string"), F.greatest(F.lit(5), F.length(F.col("position").cast("string"))), F.lit("0")),
        F.lit("_"), F.substring(F.coalesce("document_name", F.lit("doc")), 1, 10),
    )
    rows = chunks.withColumn("_id", strip(F.coalesce("chunk_id", F.lit(""))))
    # blank ids share no key: they are named without meeting the others
    same = F.col("_id") == F.col("_kept")
    for i, c in enumerate(order):
        same = same & F.col(c).eqNullSafe(F.col(f"_first_{i}"))
    named = rows.where("_id <> ''").join(first, same, "left").withColumn("chunk_id", F.coalesce("_kept", made))
    return named.select(*chunks.columns).unionByName(rows.where("_id = ''").withColumn("chunk_id", made).select(*chunks.columns))


def embed(records: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``embedding`` with a caller's model, e.g. a pandas UDF over ``document``."""
    out = embedder(records)
    if "embedding" not in out.columns:
        raise ValueError("the embedder must add an 'embedding' column")
    return out


def upsert(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index with the rows of ``fresh`` replacing those of the same id."""
    return index.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunk and file counts in one pass."""
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.count_if(F.col("modality") == "image-caption").alias("figures_count"),
        F.count_if(F.col("modality") == "table").alias("tables_count"),
        F.count_distinct("document_name").alias("documents"),
    )


def modality_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("modality").agg(F.count(F.lit(1)).alias("n_chunks"))
