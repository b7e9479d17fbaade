"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
# Largest id list that is sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
# Rows that a Python worker gets at a time.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only a local session may lack the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="folioscope-", dir=os.environ.get("TMPDIR", "/tmp"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage
    and survives lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_ids(df: DataFrame) -> DataFrame:
    """Stored one-column ``df`` with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_batches() -> None:
    """Batches of at most BATCH_ROWS rows for Python workers, unless the session asks
    for a number of its own: texts are long, and workers hold whole batches."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null text has none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[ \t\n\x0B\f\r]+"))


def column(df: DataFrame, name: str) -> Column:
    """Column by exact name, also when it contains dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Alternates large-star and small-star steps: each round hangs larger
    neighbours, then smaller ones, below the smallest neighbour seen, so the
    graph turns into stars in logarithmically many rounds. Nodes without an edge
    to another node aren't returned; null ends are ignored."""

    def star(pairs: DataFrame, both_ways: bool) -> DataFrame:
        # pairs: (big, small) with big > small
        if both_ways:
            seen = pairs.select(F.col("big").alias("u"), F.col("small").alias("v")).union(pairs.select(F.col("small").alias("u"), F.col("big").alias("v")))
            low = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return seen.where("v > u").join(low, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
        low = pairs.groupBy("big").agg(F.min("small").alias("m"))
        moved = pairs.join(low, "big").where("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
        return moved.union(low.select("big", F.col("m").alias("small"))).distinct()

    def digest(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(20,0)"))).first())

    pairs = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct())
    before = digest(pairs)
    while before[0]:
        pairs = stored(star(star(pairs, True), False))
        now = digest(pairs)
        if now == before:
            break
        before = now
    members = pairs.select(F.col("big").alias("node"), F.col("small").alias("component"))
    return members.union(pairs.select(F.col("small").alias("node"), F.col("small").alias("component")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of ``n`` local nodes under links (a, b): the smallest index reachable."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
