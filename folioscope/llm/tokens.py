"""Token counts from flat token files: separator scan with stitched block borders."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import column, shared_folder, small_batches, stored
from folioscope.llm.packing import token_ids

# Tokens of a block, and blocks of a stretch that is scanned by itself first.
BLOCK_TOKENS, STRETCH = 1 << 16, 1 << 10
# Ranges that follow each other in one task, and ranges a task gets about.
RANGES_TOGETHER, RANGES_A_TASK = 16, 512


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it (unescaped), and the path in it. Those
    with a scheme that Arrow doesn't know raise."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[6:].lstrip("/")
    if ":/" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def ranges(files: DataFrame, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of raw token files (file, path, length): byte ranges are dealt
    to all tasks, and each is read by a seek, so a file of any size is read by many."""
    step = width * block_tokens
    cuts = files.where("length > 0").select("file", "path", "length", F.explode(F.expr(f"sequence(0L, cast((length - 1) div {step} as bigint))")).alias("block"))
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism, -(-(cuts.count()) // RANGES_A_TASK))
    cuts = cuts.repartition(tasks, "file", F.floor(F.col("block") / RANGES_TOGETHER))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, rows in frame.groupby("path", sort=False):
                system, inner = opened(path)
                with system.open_input_file(inner) as source:
                    for at in range(0, len(rows), RANGES_TOGETHER):
                        some = rows.iloc[at : at + RANGES_TOGETHER]
                        ids = [source.read_at(min(step, length - block * step), block * step) for block, length in zip(some["block"].tolist(), some["length"].tolist())]
                        yield some[["file", "block"]].assign(ids=ids)

    return cuts.mapInPandas(read, f"file {dict(files.dtypes)['file']}, block long, ids binary")


def flat_blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of the raw token files below ``path``: little-endian ids of
    ``width`` bytes, cut into blocks without regard to documents. Spark lists the files
    with their lengths; their content is only read by range."""
    files = spark.read.format("binaryFile").load(path)
    return ranges(files.select(F.col("path").alias("file"), "path", "length"), width, block_tokens)


def write_flat(docs: DataFrame, folder: str, vocab: dict, separator: int, width: int = 2, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents as raw token files below ``folder``, one per partition, each document
    followed by ``separator``: a row (file, path, length) for each file, and rows (file,
    number, doc_id, named) that say which document came when, without its length.

    Every attempt of a task writes a file of its own name, and only the rows of the one
    that ended well name theirs; store them at once."""
    small_batches()
    given = column(docs, doc_id)
    rows = docs.select(given.isNotNull().alias("named"), F.coalesce(given.cast("long"), F.lit(0)).alias("doc_id"), column(docs, text).alias("text"))
    kind, names = f"<u{width}", ["file", "number", "doc_id", "named", "path", "length"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, document, held, waiting, length, sink = TaskContext.get().partitionId(), 0, 0, [], 0, None
        path = f"{folder.rstrip('/')}/{file:06d}-{uuid.uuid4().hex}.bin"
        system, inner = opened(path)
        try:
            for frame in frames:
                for text in frame["text"]:
                    if sink is None:
                        system.create_dir(inner.rpartition("/")[0], recursive=True)
                        sink = system.open_output_stream(inner)
                    ids = np.append(token_ids(text, **vocab, ordinary=True), separator).astype(kind)
                    waiting.append(ids.tobytes())
                    held += len(ids)
                    length += width * len(ids)
                    if held >= block_tokens:
                        sink.write(b"".join(waiting))
                        waiting, held = [], 0
                yield pd.DataFrame({"file": file, "number": np.arange(document, document + len(frame)), "doc_id": frame["doc_id"].to_numpy(), "named": frame["named"].to_numpy(), "path": None, "length": 0})[names]
                document += len(frame)
            if sink is not None:
                sink.write(b"".join(waiting))
        finally:
            if sink is not None:
                sink.close()
        if length:
            yield pd.DataFrame([(file, 0, 0, False, path, length)], columns=names)

    return rows.mapInPandas(write, "file long, number long, doc_id long, named boolean, path string, length long")


def scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, block, seps, head, tail, inner) of each block: separators, tokens before
    the first and after the last one, and tokens between them. Without a separator all
    tokens are the tail."""
    kind = f"<u{width}"

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for raw in frame["ids"]:
                ids = np.frombuffer(raw or b"", kind)
                at = np.flatnonzero(ids == separator)
                rows.append((len(at), at[0], len(ids) - at[-1] - 1, np.diff(at) - 1) if len(at) else (0, 0, len(ids), np.zeros(0, np.int64)))
            yield pd.concat([frame[["file", "block"]].reset_index(drop=True), pd.DataFrame(rows, columns=["seps", "head", "tail", "inner"])], axis=1)

    return blocks.select("file", "block", "ids").mapInPandas(look, f"file {dict(blocks.dtypes)['file']}, block long, seps long, head long, tail long, inner array<long>")


def token_counts(blocks: DataFrame, separator: int, width: int = 2, stretch: int = STRETCH) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in flat token blocks (file,
    block, ids), separators not counted.

    Blocks are scanned apart; a prefix scan over their summaries, first inside stretches
    of blocks and then over stretches, gives each block the documents before it and the
    tokens of the one it continues. Two separators in a row enclose an empty document;
    tokens after the last one make a document that has not ended. Null or empty blocks
    hold nothing, an empty table gives no row. Blocks are numbered from 0 within a file;
    a repeated block is counted once."""
    seen = stored(scan(blocks.where("file is not null and block is not null"), separator, width).dropDuplicates(["file", "block"]))
    seen = seen.withColumn("stretch", F.floor(F.col("block") / stretch))
    before = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    local = seen.withColumn("docs", F.coalesce(F.sum("seps").over(before), none)).withColumn("run", F.coalesce(F.sum("tail").over(before), none))
    # run before the last block with a separator: what follows it is still open
    local = local.withColumn("cut", F.max(F.when(F.col("seps") > 0, F.col("run"))).over(before))
    wide = local.groupBy("file", "stretch").agg(F.sum("seps").alias("all_docs"), F.sum("tail").alias("all_run"), F.max(F.when(F.col("seps") > 0, F.col("run"))).alias("last_cut"), F.max("block").alias("last_block"))
    order = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("docs0", F.coalesce(F.sum("all_docs").over(order), none)).withColumn("run0", F.coalesce(F.sum("all_run").over(order), none))
    wide = wide.withColumn("cut0", F.max(F.col("run0") + F.col("last_cut")).over(order)).withColumn("last", F.max("last_block").over(Window.partitionBy("file")))
    wide = stored(wide.select("file", "stretch", "docs0", "run0", "cut0", "last"))
    both = local.join(wide, ["file", "stretch"])
    carry = F.col("run0") + F.col("run") - F.coalesce(F.col("run0") + F.col("cut"), F.col("cut0"), none)
    state = both.select("file", "block", "seps", "head", "tail", "inner", (F.col("docs0") + F.col("docs")).alias("first"), carry.alias("carry"), "last")
    counts = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    ended = state.select("file", "first", F.posexplode(counts).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    open_ = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    rest = state.where(F.col("block") == F.col("last")).select("file", (F.col("first") + F.col("seps")).alias("ordinal"), open_.alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest.where("n_tokens > 0"))


def document_tokens(docs: DataFrame, vocab: dict, separator: int, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, file, ordinal, n_tokens): ``docs`` written as raw token files to the
    shared folder, and counted there by their separators alone.

    Null and empty texts have no token; a text that spells the separator is ordinary
    text. A null id stays null, repeated rows each count, other columns are ignored."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/{uuid.uuid4().hex}"
    written = stored(write_flat(docs, folder, vocab, separator, width, doc_id, text))
    counted = token_counts(ranges(written.where("path is not null").select("file", "path", "length"), width), separator, width)
    names = written.where("path is null").select("file", F.col("number").alias("ordinal"), F.when(F.col("named"), F.col("doc_id")).alias("doc_id"))
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
