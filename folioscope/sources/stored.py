"""Chunk tables, indexes, questions and results on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.evaluate import report_rows
from folioscope.operators.index import searchable, upsert
from folioscope.schema import CHUNK, QUESTION


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk table; JSON arrays and JSON lines are read with the fixed schema."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(CHUNK).option("multiLine", path.endswith(".json")).json(path)
    return spark.read.schema(CHUNK).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def export_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, one chunk each, for readers outside Spark."""
    chunks.write.mode("overwrite").json(path)


def write_index(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index in the shape that the retrievers read."""
    return searchable(spark.read.parquet(path))


def save_index(records: DataFrame, table: str, buckets: int) -> None:
    """Index bucketed by chunk id.  A search reads it without a shuffle if ``buckets``
    equals its spark.sql.shuffle.partitions."""
    records.write.mode("overwrite").bucketBy(buckets, "chunk_id").sortBy("chunk_id").saveAsTable(table)


def upsert_index(spark: SparkSession, path: str, fresh: DataFrame, target: str) -> None:
    """Write to ``target`` the index at ``path`` with the rows of ``fresh`` replaced."""
    upsert(spark.read.parquet(path), fresh).write.mode("overwrite").parquet(target)


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Questions of a JSON array; ``limit`` keeps the first ones by id."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    return rows.orderBy("qid").limit(limit) if limit else rows


def all_questions(demo: DataFrame, benchmark: DataFrame) -> DataFrame:
    return demo.unionByName(benchmark, allowMissingColumns=True)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_report(results: DataFrame, summary: DataFrame, path: str) -> None:
    """Markdown report as ordered text parts: summary lines, then one line per result."""
    s = summary.select(
        F.explode(
            F.array(
                *[
                    F.concat(F.lit(f"- {c}: "), F.col(c).cast("string"))
                    for c in summary.columns
                ]
            )
        ).alias("line")
    ).withColumn("ord", F.lit(0))
    head = results.sparkSession.createDataFrame(
        [("| QID | Track | Question Summary | Retrieval | Citation | Modality | Latency |", 1), ("| :--- | :--- | :--- | :--- | :--- | :--- | :--- |", 2)],
        "line string, ord int",
    )
    rows = report_rows(results).select("line", F.lit(3).alias("ord"), "qid")
    parts = s.withColumn("qid", F.lit("")).unionByName(head.withColumn("qid", F.lit(""))).unionByName(rows)
    parts.orderBy("ord", "qid", "line").select("line").write.mode("overwrite").text(path)


def write_media(files: DataFrame, folder: str) -> None:
    """Copy figure files (target, content) into ``folder`` unless present.

    ``folder`` is a URI (or absolute path) of a file system that all executors share."""

    def copy(rows) -> None:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for r in rows:
            target = f"{root}/{r['target']}"
            if system.get_file_info(target).type == fs.FileType.NotFound:
                partial = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(partial) as out:
                    out.write(r["content"])
                system.move(partial, target)

    files.select("target", "content").foreachPartition(copy)
