"""Contract checks of chunk tables, as an error table instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.lexicon import REQUIRED_KEYS, VALID_DOC_TYPES, VALID_MODALITIES
from folioscope.session import checkpointed


def chunk_errors(media_exists: Column | None = None) -> Column:
    """Array of error codes of a chunk row; empty when valid."""
    checks = [F.when(F.col(k).isNull(), F.lit(f"missing:{k}")) for k in REQUIRED_KEYS]
    for name, valid in (("modality", VALID_MODALITIES), ("document_type", VALID_DOC_TYPES)):
        known = F.coalesce(F.col(name).isin(valid), F.lit(False))
        checks.append(F.when(~known, F.concat(F.lit(f"invalid:{name}="), F.coalesce(name, F.lit("null")))))
    if media_exists is not None:
        wants = F.col("modality").isin("image-caption", "table") & (F.length(F.coalesce("media_path", F.lit(""))) > 0)
        checks.append(F.when(wants & ~F.coalesce(media_exists, F.lit(False)), F.concat(F.lit("no_media:"), F.col("media_path"))))
    checks.append(F.when(F.coalesce(strip(F.col("content")), F.lit("")) == "", F.lit("empty:content")))
    return F.array_compact(F.array(*checks))


def validate_chunks(chunks: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Every violation as (chunk_id, error); a media catalog enables the file check."""
    if catalog is None:
        rows = chunks.select("chunk_id", F.explode(chunk_errors()).alias("error"))
    else:
        known = catalog.select(F.col("path").alias("media_path"), F.lit(True).alias("_known")).distinct()
        # rows without media stay out of the join, where they would all share a key
        names = F.length(F.coalesce("media_path", F.lit(""))) > 0
        checked = chunks.where(names).join(known, "media_path", "left").select("chunk_id", F.explode(chunk_errors(F.col("_known"))).alias("error"))
        rows = checked.unionByName(chunks.where(~names).select("chunk_id", F.explode(chunk_errors()).alias("error")))
    return rows


def duplicate_ids(chunks: DataFrame) -> DataFrame:
    """One error per repeated id beyond its first row, from counts only."""
    return (
        chunks.where(F.length(F.coalesce("chunk_id", F.lit(""))) > 0)
        .groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("chunk_id", F.explode(F.array_repeat(F.lit("duplicate"), (F.col("n") - 1).cast("int"))).alias("error"))
    )


def validate_table(chunks: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """All violations of a chunk table; an empty table is itself one."""
    none = chunks.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("chunk_id"), F.lit("no chunks").alias("error")
    )
    return validate_chunks(chunks, catalog).unionByName(duplicate_ids(chunks)).unionByName(none)


# Keys that one task numbers.
ROWS_PER_TASK = 1 << 20


def unique_ids(chunks: DataFrame, order: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Second and later rows of an id get ``_dup1``, ``_dup2``, ... in ``order``, passing
    over names that are some row's own id.

    Only ids and ``order`` columns (which must tell the rows of an id apart) are
    numbered, in two levels (range partition, then within it), so that an id shared by a
    third of all rows is not numbered by a single task and no text moves for it.
    """
    looks = r"^((?s).*)_dup([1-9][0-9]{0,8})$"
    numbered = F.rlike("chunk_id", F.lit(looks))
    counted = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n"))
    # all others are neither renamed nor in the way of a new name
    ids = checkpointed(counted.where(F.col("chunk_id").isNotNull() & ((F.col("_n") > 1) | numbered)))
    repeated = ids.where(F.col("_n") > 1).select("chunk_id")
    if repeated.agg(F.count(F.lit(1))).first()[0] == 0:
        return chunks
    # own ids that look like a numbered one: the j-th of them takes numbers from its
    # value less j on out of the row
    taken = (
        ids.where(numbered)
        .select(F.regexp_extract("chunk_id", looks, 1).alias("_base"), F.regexp_extract("chunk_id", looks, 2).cast("int").alias("_no"))
        .groupBy("_base")
        .agg(F.sort_array(F.collect_set("_no")).alias("_taken"))
        .select(F.col("_base").alias("chunk_id"), F.transform("_taken", lambda n, j: n - j).alias("_shifts"))
        .join(repeated, "chunk_id", "left_semi")
    )
    keys = checkpointed(chunks.select("chunk_id", *order).join(repeated, "chunk_id", "left_semi"))
    parts = max(1, -(-keys.count() // rows_per_task))
    # Range partitioning by (id, order) splits a hot id over tasks, in order.  The
    # partition numbers are read twice below, so they are made permanent first.
    placed = checkpointed(keys.repartitionByRange(parts, "chunk_id", *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", "chunk_id").orderBy(*order)
    local = placed.withColumn("_local", F.row_number().over(within))
    sizes = local.groupBy("chunk_id", "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("chunk_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    later = local.join(before, ["chunk_id", "_part"]).withColumn("_k", F.col("_before") + F.col("_local") - 1).where(F.col("_k") > 0)
    number = F.col("_k") + F.coalesce(F.size(F.filter("_shifts", lambda n: n <= F.col("_k"))), F.lit(0))
    renamed = later.join(taken, "chunk_id", "left").select(
        "chunk_id", *order, F.concat("chunk_id", F.lit("_dup"), number.cast("string")).alias("_new")
    )
    return (
        chunks.join(renamed, ["chunk_id", *order], "left")
        .withColumn("chunk_id", F.coalesce("_new", "chunk_id"))
        .select(*chunks.columns)
    )
