"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import column, shared_folder, spare_name, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A digest that holds more than this part of all rows is joined apart; there are at most as many.
HOT_PART = 2_000


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


@dataclass(frozen=True)
class DigestIndex:
    """First rows of all digests seen so far: (digest, keep_id, keep_row, n, batch),
    in ``buckets`` files by hash of the digest, each sorted by it.

    ``table`` is a name in the session's catalogue, ``path`` the folder behind it. A
    later session opens the same path again. A batch is a partition of the table that
    is overwritten whole, so a batch that failed half-way is simply added again."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @staticmethod
    def open(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None, table: str | None = None) -> DigestIndex:
        """The index at ``path`` (created where missing). As many buckets as the
        session has shuffle partitions let a batch meet it after one shuffle of its own;
        an index keeps the number it was created with, which has to be given again."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = table or f"digests_{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
        spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id {id_type}, keep_row BIGINT, n BIGINT, batch BIGINT) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.catalog.recoverPartitions(table)
        return DigestIndex(spark, table, path, buckets)

    def before(self, batch: int) -> DataFrame:
        return self.spark.table(self.table).where(F.col("batch") < batch)

    def add(self, found: DataFrame, batch: int) -> None:
        """Append the digests of ``found`` (digest, keep_id, keep_row, n), one row each,
        that no earlier batch holds."""
        # written first, as Spark doesn't overwrite a part of a table that it reads
        new = stored(found.join(self.before(batch).select("digest"), "digest", "left_anti").select("digest", "keep_id", "keep_row", "n"))
        dealt = new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        dealt.createOrReplaceTempView(f"{self.table}_new")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(batch)}) SELECT * FROM {self.table}_new")
        self.spark.catalog.dropTempView(f"{self.table}_new")
        self.spark.catalog.refreshTable(self.table)

    def compacted(self, path: str) -> DigestIndex:
        """A copy at ``path`` with one file a bucket, as batch 0, for the time when many
        batches have left many files."""
        whole = DigestIndex.open(self.spark, path, dict(self.spark.table(self.table).dtypes)["keep_id"], self.buckets)
        whole.add(self.spark.table(self.table), 0)
        return whole


def digest_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored (row, doc_id, digest) of every row; ``row`` numbers the rows of ``docs``."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), digest(column(docs, text)).alias("digest"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()))


def add_batch(index: DigestIndex, rows: DataFrame, batch: int) -> DataFrame:
    """Add ``rows`` (row, doc_id, digest) to ``index`` as batch ``batch``; returns the
    stored groups of the batch (digest, n), one row for each digest.

    Of equal rows in one batch the one with the largest (doc_id, row) is indexed, null
    ids being smallest; a digest that an earlier batch holds keeps the earlier row."""
    best = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row")).alias("best")
    found = stored(rows.groupBy("digest").agg(best, F.count("*").alias("n")))
    index.add(found.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"), batch)
    return found.select("digest", "n")


def decisions(index: DigestIndex, rows: DataFrame, groups: list[DataFrame], since: int = 0) -> DataFrame:
    """(row, doc_id, digest, keep_id, group_size, kept) for all ``rows`` of the batches
    from ``since`` on, whose ``groups`` are given. Rows with a digest of an earlier batch
    are not kept; group_size counts the given groups. Digests of many rows are joined from a broadcast table
    that has at most HOT_PART of them, whatever the data; the others meet by sort-merge."""
    sizes = groups[0]
    for other in groups[1:]:
        sizes = sizes.unionByName(other)
    sizes = stored(sizes.groupBy("digest").agg(F.sum("n").alias("group_size")))
    total = sizes.agg(F.sum("group_size")).first()[0] or 0
    kept = index.spark.table(index.table).select("digest", "keep_id", "keep_row", (F.col("batch") >= since).alias("fresh"))
    hot = F.col("group_size") * HOT_PART > total
    # total / HOT_PART rows each at least, so there are fewer than HOT_PART hot digests
    known = stored(kept.join(sizes, "digest"))
    apart = F.broadcast(known.where(hot & (F.col("group_size") > 1)))
    joined = rows.join(apart, "digest", "left")
    rest = joined.where("keep_row is null").select(*rows.columns).join(known.where(~(hot & (F.col("group_size") > 1))), "digest")
    both = joined.where("keep_row is not null").select(rest.columns).unionByName(rest)
    return both.select("row", "doc_id", "digest", "keep_id", "group_size", (F.col("fresh") & (F.col("row") == F.col("keep_row"))).alias("kept"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 3, path: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of
    equal texts the row with the largest ``doc_id`` stays: the table enters a new index (at
    ``path``) in ``batches`` ranges of falling ids (one, if ids are no numbers), and each is
    deduplicated in itself and by a sort-merge anti-join against the bucketed digests
    of those before it, which it is appended to. Null ids are smallest and come last; of
    rows that share the largest id one stays. Repeated rows each count, other columns
    are ignored, an empty table gives no row."""
    spark = docs.sparkSession
    rows = digest_rows(docs, doc_id, text)
    id_type = dict(rows.dtypes)["doc_id"]
    index = DigestIndex.open(spark, path or f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}", id_type)
    # ranges of ids: a few borders, found by one aggregation
    shares = [1 - k / batches for k in range(1, batches)]
    numeric = id_type in ("tinyint", "smallint", "int", "bigint", "float", "double")
    borders = (rows.agg(F.percentile_approx("doc_id", shares)).first()[0] if numeric and shares else None) or []
    number = F.lit(0)
    for border in borders:
        number = number + (F.col("doc_id") < border).cast("int")
    number = F.coalesce(number, F.lit(len(borders)))
    part = spare_name(rows, "batch")
    dealt = rows.withColumn(part, number)
    groups = [add_batch(index, dealt.where(F.col(part) == k).drop(part), k) for k in range(len(borders) + 1)]
    out = decisions(index, rows, groups)
    return out.select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM hashed WINDOW w AS (PARTITION BY text_sha256)
"""
