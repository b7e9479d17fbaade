"""A chunk or index table in buckets of ids, of which an upsert rewrites only those it
touches; and a stream of files into it."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.session import checkpointed, listing
from folioscope.sizing import small_side

MANIFEST = "number long, bucket int, version long, tier int, batch long"
MANIFEST_FIELDS = [f.split()[0] for f in MANIFEST.split(", ")]
# Parts of one tier that a bucket has before they become one of the next.
FAN = 8


@dataclass(frozen=True)
class BucketTable:
    """Rows by hash of the string ``key`` in ``buckets`` folders below ``path``.

    A write makes new files for the buckets it touches (``data/version=V/bucket=B``)
    and then one manifest, (bucket, version) of every bucket that has rows. Rows known to
    be new are written as a further part of their bucket; ``FAN`` parts of a tier are merged
    into one of the next, so a row is written again once a tier, not once a write. Readers follow
    the newest manifest that was finished, so a write shows as a whole or not at all, and
    a failed one leaves files that nothing refers to. One writer at a time: a second one
    fails as the manifest of its number exists. The manifest grows with the number of
    buckets (times the logarithm of the number of writes), not with the table."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str = "chunk_id"
    buckets: int = 256

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(self.key), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _newest(self) -> int:
        """Number of the newest manifest that was written to the end; -1 without one."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/manifest")
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return -1
        numbers = [f.getPath().getName().partition("=")[2] for f in system.listStatus(root)]
        newest_first = sorted((int(n) for n in numbers if n.isdigit()), reverse=True)
        return next((n for n in newest_first if system.exists(hadoop.Path(f"{self.path}/manifest/number={n}/_SUCCESS"))), -1)

    def manifest(self) -> tuple[int, dict[int, tuple[tuple[int, int], ...]], int]:
        """(number, (version, tier) of each part of each bucket, last batch) of the newest manifest."""
        number = self._newest()
        if number < 0:
            return -1, {}, -1
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/number={number}").collect()
        parts: dict[int, tuple[tuple[int, int], ...]] = {}
        for r in sorted((r for r in rows if r["bucket"] is not None), key=lambda r: (r["bucket"], r["version"])):
            parts[r["bucket"]] = (*parts.get(r["bucket"], ()), (r["version"], r["tier"]))
        return number, parts, max(r["batch"] for r in rows)

    def folders(self, versions: dict[int, tuple[tuple[int, int], ...]]) -> DataFrame:
        """Rows of the given buckets; no other bucket is opened."""
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, parts in sorted(versions.items()) for v, _ in parts]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        with listing(self.spark):
            return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        return self.folders(self.manifest()[1])

    @staticmethod
    def _merged(parts: tuple[tuple[int, int], ...], new: bool) -> tuple[tuple[tuple[int, int], ...], int]:
        """The parts of a bucket that a write puts into its own, and the tier of that."""
        if not new:
            return parts, max((tier for _, tier in parts), default=0)
        tier = 0
        while sum(t == tier for _, t in parts) >= FAN - 1:
            tier += 1
        return tuple(p for p in parts if p[1] < tier), tier

    def _once(self, rows: DataFrame, order: list[str] | None, *by: str) -> DataFrame:
        """Of the rows of an id, the largest by ``order``; ``by`` has columns that follow from the id."""
        ranked = F.struct(*(order or [c for c in self.schema.fieldNames() if c != self.key]))
        largest = F.max_by(F.struct(*self.schema.fieldNames()), ranked).alias("_row")
        return rows.groupBy(*by, F.col(self.key).alias("_key")).agg(largest).select("_row.*", *by)

    def _write(self, rows: DataFrame, folder: str) -> None:
        """Write ``rows``, dealt by bucket; nothing stays of a write that failed before."""
        placed = rows.sortWithinPartitions("bucket", self.key).write.mode("overwrite")
        placed.option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)

    def _buckets(self, folder: str) -> list[int]:
        """The buckets that a write has made files for."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(folder)
        names = [f.getPath().getName() for f in root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)]
        return [int(n.partition("=")[2]) for n in names if n.startswith("bucket=")]

    def upsert(self, fresh: DataFrame, order: list[str] | None = None, batch: int = -1, new: bool = False, state: tuple | None = None) -> None:
        """Replace the rows of the ids in ``fresh`` and add those that are new; with
        ``new`` the table has none of the ids yet, and its rows are left alone.
        ``state`` is the ``manifest()`` that ``fresh`` was made for, if it was read before.

        Of fresh rows with one id the one that is largest by ``order`` (default: all
        other columns) counts; null ids are one id. A ``batch`` number that the table has
        already taken in changes nothing, which lets a stream repeat its last batch."""
        number, held, last = state or self.manifest()
        if 0 <= batch <= last:
            return
        rows = fresh.select(*self.schema.fieldNames(), *[c for c in order or [] if c not in self.schema.fieldNames()])
        version, data = number + 1, f"{self.path}/data/version={number + 1}"
        if new:
            # rows move once and are read once: parts that are due are merged wherever the rows belong
            due = {b: self._merged(parts, new) for b, parts in held.items()}
            due = {b: found for b, found in due.items() if found[0]}
            whole = rows.unionByName(self.folders({b: parts for b, (parts, _) in due.items()}), allowMissingColumns=True).withColumn("bucket", self.bucket())
            tasks = min(self.buckets, 4 * self.spark.sparkContext.defaultParallelism)
            self._write(self._once(whole.repartition(tasks, "bucket"), order, "bucket"), data)
            merged = {b: due.get(b, ((), 0)) for b in self._buckets(data)}
        else:
            once = checkpointed(self._once(rows, order).withColumn("bucket", self.bucket()))
            touched = [r[0] for r in once.select("bucket").distinct().collect()]  # at most ``buckets``
            merged = {b: self._merged(held.get(b, ()), new) for b in touched}
            old = self.folders({b: parts for b, (parts, _) in merged.items()}).withColumn("bucket", self.bucket())
            kept = old.alias("o").join(once.alias("n"), F.col(f"o.{self.key}").eqNullSafe(F.col(f"n.{self.key}")), "left_anti")
            if touched:
                self._write(kept.unionByName(once).repartition(min(len(touched), self.buckets), "bucket"), data)
        parts = held | {b: (*(p for p in held.get(b, ()) if p not in gone), (version, tier)) for b, (gone, tier) in merged.items()}
        entries = [(version, b, v, tier, max(batch, last)) for b, of_bucket in sorted(parts.items()) for v, tier in of_bucket] or [(version, None, None, None, max(batch, last))]
        # as Arrow, which the JVM reads itself: rows of Python are decoded by a worker for each core
        listed = pa.Table.from_pylist([dict(zip(MANIFEST_FIELDS, e)) for e in entries])
        self.spark.createDataFrame(listed, MANIFEST).coalesce(1).write.mode("error").json(f"{self.path}/manifest/number={version}")


def ingest_stream(spark: SparkSession, root: str, table: BucketTable, checkpoint: str, files_per_batch: int = 1000, **given) -> None:
    """Take in the files below ``root`` that no earlier call with this ``checkpoint`` saw.

    Each micro-batch of new files becomes chunks as ``read_corpus`` makes them, which are
    upserted into ``table``. A file's chunks have ids from its name; where another file
    holds an id already, the new rows get the next free ``_dup`` numbers, so ids
    are unique in the table at any time. A batch that failed is repeated from the
    checkpoint and written once. Files that change later are not read again."""
    from folioscope.sources.corpus import DOCUMENT_SUFFIXES, chunk_files, suffix_glob

    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix_glob(DOCUMENT_SUFFIXES))
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )

    def take(batch: DataFrame, number: int) -> None:
        state = table.manifest()
        if number > state[2]:
            found = chunk_files(batch.select("path", "content"), **given)
            stored = table.folders(state[1]).select(table.key)
            table.upsert(with_free_ids(found, stored, table.key), batch=number, new=True, state=state)

    # each batch lists its files by the settings of the session that the stream was made in
    with listing(spark):
        query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def with_free_ids(fresh: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``fresh``, whose ids are unique, with ids that differ from all of ``stored``: one
    that is taken gets ``_dup`` and a number above all numbers of its kind on both sides.

    Only ids that are taken meet the stored ones of their base, which combine to one
    maximum each before they move."""
    looks = r"^((?s).*)_dup([1-9][0-9]{0,8})$"
    base = F.when(F.rlike(key, F.lit(looks)), F.regexp_extract(key, looks, 1)).otherwise(F.col(key))
    # stored ids are read and left where they are
    ids = stored.join(small_side(fresh.select(key), 128), key, "left_semi").distinct()
    taken = checkpointed(ids.withColumn("_base", base))
    if taken.isEmpty():
        return fresh
    number = F.when(F.rlike(key, F.lit(looks)), F.regexp_extract(key, looks, 2).cast("int")).otherwise(0)
    numbered = stored.unionByName(fresh.select(key)).select(base.alias("_base"), number.alias("_n"))
    highest = numbered.join(small_side(taken.select("_base").distinct(), 128), "_base", "left_semi").groupBy("_base").agg(F.max("_n").alias("_top"))
    order = Window.partitionBy("_base").orderBy(key)
    made = taken.withColumn("_k", F.row_number().over(order)).join(highest, "_base").select(key, F.concat("_base", F.lit("_dup"), (F.col("_top") + F.col("_k")).cast("string")).alias("_new"))
    return fresh.join(made, key, "left").withColumn(key, F.coalesce("_new", key)).drop("_new")
