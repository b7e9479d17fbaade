"""Session defaults and the few runtime decisions that need the session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Largest side that is broadcast on purpose; beyond it every operator has
# another way (blocks of queries, or a shuffled join).
BROADCAST_BYTES = 64 << 20


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # plans name whole paths, however long the folder's name is
        .config("spark.sql.maxMetadataStringLength", "1000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, wherever they were started.

    A cluster that installs the package doesn't need it; done once per session."""
    context = spark.sparkContext
    if getattr(context, "_folioscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folioscope-", dir=os.environ.get("TMPDIR", "/tmp"))) / "folioscope.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))  # Spark copies it to every executor
    context._folioscope_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only a local session may lack
    the setting, and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="folioscope-", dir=os.environ.get("TMPDIR", "/tmp"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for costly row-local work: as it is scanned, unless the scan has fewer
    partitions than the session has cores (one small file, say)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows of ``df`` for work that costs much more than moving them, dealt to four
    tasks a core: a scan may have as many partitions as the session has cores and still
    read all rows in one, as a row group is read whole."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Within it, many given paths are listed by four tasks a core at most, and the driver doesn't
    keep what was found for later reads; Spark's own limits are a task a path, up to 10,000, and
    250 MB of the driver's memory."""
    tasks, kept = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"
    given = {key: spark.conf.get(key, None) for key in (tasks, kept)}
    spark.conf.set(tasks, min(4 * spark.sparkContext.defaultParallelism, int(given[tasks] or 10_000)))
    spark.conf.set(kept, 0)
    try:
        yield
    finally:
        for key, value in given.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the cluster's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
