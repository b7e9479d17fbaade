"""Exact cosine nearest neighbours and modality-weighted vector scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.session import checkpointed
from folioscope.sizing import fits_broadcast

ITEM_BLOCK_BYTES = 64 << 20  # item vectors held by one cell of the grid
QUERY_BYTES = 8 << 20  # query vectors held by one task
TASKS_PER_LANE = 256  # tasks whose findings for a query are cut together
TILE_CELLS = 1 << 22  # similarities computed at a time


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """Running best ``fetch`` neighbours of a block of query vectors.

    Similarities are computed in tiles of bounded size; candidates below a query's
    current worst kept neighbour are dropped at once, the rest merged in batches.
    """

    def __init__(self, query_rows: np.ndarray, vectors: np.ndarray, fetch: int):
        self.vectors, self.fetch, self.query_rows = vectors, fetch, query_rows
        self.floor = np.full(len(vectors), -np.inf)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, items: np.ndarray) -> None:
        step = max(1, TILE_CELLS // max(1, len(self.vectors)))
        for at in range(0, len(items), step):
            self._tile(ids[at : at + step], items[at : at + step])

    def _tile(self, ids: np.ndarray, items: np.ndarray) -> None:
        sims = np.round(self.vectors @ items.T, 12)
        floor = self.floor[:, None]
        if sims.shape[1] > self.fetch:
            floor = np.maximum(floor, np.partition(sims, -self.fetch, axis=1)[:, -self.fetch][:, None])
        q, i = np.nonzero(sims >= floor)
        if len(q):
            self.pending.append((q, ids[i], sims[q, i]))
            self.waiting += len(q)
        if self.waiting > 4 * self.fetch * len(self.vectors):
            self._merge()

    def _merge(self) -> None:
        if not self.pending:
            return
        q, found, s = (np.concatenate(parts) for parts in zip(*self.pending))
        order = np.lexsort((found, -s, q))
        q, found, s = q[order], found[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.fetch
        last = place == self.fetch - 1
        self.floor[q[last]] = s[last]
        self.pending, self.waiting = [(q[keep], found[keep], s[keep])], 0

    def batch(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.RecordBatch | None:
        self._merge()
        if not self.pending:
            return None
        q, found, s = self.pending[0]
        return pa.RecordBatch.from_arrays(
            [query_ids.take(pa.array(self.query_rows[q])), pa.array(found.tolist(), id_type), pa.array(s)],
            names=["qid", "item_id", "similarity"],
        )


def knn(queries: DataFrame, items: DataFrame, fetch: int, limit: int = QUERY_BYTES) -> DataFrame:
    """``fetch`` most similar items per query: (qid, item_id, similarity).

    ``queries(qid, vector)`` and ``items(item_id, embedding)``.  Tasks keep only
    their own best ``fetch`` per query.  Vectors that are null, hold a null or differ in
    length from the queries' longest are left out.  Query vectors within ``limit`` are shipped
    to the scan of the items, which then needs no shuffle; larger sets meet the
    items in a grid of bounded blocks.
    """
    dims = queries.select(F.max(F.size("vector"))).first()[0] or 1
    items, queries = items.where(comparable(F.col("embedding"), dims)), queries.where(comparable(F.col("vector"), dims))
    partial = (
        _scan(queries, items, fetch)
        if fits_broadcast(queries, 8 * dims + 64, limit)
        else _grid(queries, items, fetch, max(1, limit // (8 * dims + 64)))
    )
    # What very many tasks found for a query is cut in lanes before it meets in one place.
    lanes = items.rdd.getNumPartitions() // TASKS_PER_LANE
    if lanes > 1:
        partial = _nearest(partial, fetch, F.pmod(F.xxhash64("item_id"), F.lit(lanes)))
    return _nearest(partial, fetch)


def _nearest(found: DataFrame, fetch: int, *lane: Column) -> DataFrame:
    best = Window.partitionBy("qid", *lane).orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= fetch).drop("place")


def comparable(vector: Column, dims: int) -> Column:
    """A vector of ``dims`` finite or infinite numbers, none of them null."""
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, lambda v: v.isNull()), F.lit(False))


def _out_schema(queries: DataFrame, items: DataFrame) -> str:
    q, i = queries.schema["qid"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return f"qid {q}, item_id {i}, similarity double"


def _scan(queries: DataFrame, items: DataFrame, fetch: int) -> DataFrame:
    held = queries.select("qid", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (held["qid"].combine_chunks(), _matrix(held["vector"]) if len(held) else np.zeros((0, 1)))
    )

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best = _Best(np.arange(len(vectors)), vectors, fetch)
        id_type = None
        for b in batches:
            if b.num_rows and len(vectors):
                id_type = b.column("item_id").type
                best.add(b.column("item_id").to_numpy(zero_copy_only=False), _matrix(b.column("embedding")))
        out = best.batch(query_ids, id_type)
        if out is not None:
            yield out

    return items.select("item_id", "embedding").mapInArrow(best_of_task, _out_schema(queries, items))


def _grid(queries: DataFrame, items: DataFrame, fetch: int, query_rows: int) -> DataFrame:
    """Block nested loop: every (query block, item block) cell is one bounded task."""
    q_blocks = math.ceil(queries.count() / query_rows)
    dims = items.select(F.max(F.size("embedding"))).first()[0] or 1
    i_blocks = max(1, math.ceil(items.count() * dims * 8 / ITEM_BLOCK_BYTES))

    def cells(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(
        "qid",
        F.col("vector").cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int").alias("q_block"),
        cells(i_blocks).alias("i_block"),
    )
    i = items.select(
        "item_id",
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.pmod(F.xxhash64("item_id"), F.lit(i_blocks)).cast("int").alias("i_block"),
        cells(q_blocks).alias("q_block"),
    )

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("qid", left.schema.field("qid").type), ("item_id", right.schema.field("item_id").type), ("similarity", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        best = _Best(np.arange(len(left)), _matrix(left["vector"]), fetch)
        best.add(right["item_id"].to_numpy(), _matrix(right["embedding"]))
        out = best.batch(left["qid"].combine_chunks(), right.schema.field("item_id").type)
        return pa.Table.from_batches([out])

    keys = ["q_block", "i_block"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInArrow(cell, _out_schema(queries, items))


def modality_multiplier(modality: Column, media_path: Column, target: Column, boost: Column) -> Column:
    """Boost the wanted modality; figures count 1.3 for any chunk with media."""
    has_media = F.length(F.coalesce(media_path, F.lit(""))) > 0
    return F.when(modality == target, boost).when((target == "image-caption") & has_media, 1.3).otherwise(1.0)


def vector_topk(queries: DataFrame, index: DataFrame, max_k: int) -> DataFrame:
    """Best ``k`` chunks per question vector after the modality weighting.

    ``queries(query_id, step, vector, target, k)``, ``index(chunk_id, document_name,
    modality, media_path, embedding)``.  Three times ``k`` (at least 15) nearest
    chunks are re-scored, read-me files being left out beforehand.
    """
    queries = checkpointed(queries)  # a small table, read several times below
    usable = index.where(~F.startswith(F.lower("document_name"), F.lit("readme")))
    near = knn(
        queries.select(F.struct("query_id", "step").alias("qid"), "vector").select(
            F.to_json("qid").alias("qid"), "vector"
        ),
        usable.select(F.col("chunk_id").alias("item_id"), "embedding"),
        max(3 * max_k, 15),
    )
    asked = queries.select(
        F.to_json(F.struct("query_id", "step")).alias("qid"), "query_id", "step", "target", "k"
    )
    nearest = Window.partitionBy("query_id", "step").orderBy(F.desc("similarity"), "chunk_id")
    best = Window.partitionBy("query_id", "step").orderBy(F.desc("relevance_score"), F.desc("similarity"), "chunk_id")
    raw = F.greatest(F.lit(0.0), F.col("similarity"))
    weight = modality_multiplier(
        F.col("modality"), F.col("media_path"), F.col("target.target_modality"), F.col("target.boost_weight")
    )
    return (
        near.join(asked, "qid")
        .withColumnRenamed("item_id", "chunk_id")
        .withColumn("near", F.row_number().over(nearest))
        .where(F.col("near") <= F.greatest(F.col("k") * 3, F.lit(15)))
        .join(usable.select("chunk_id", "modality", "media_path"), "chunk_id")
        .withColumn("raw_similarity", rounded(raw, 4))
        .withColumn("relevance_score", rounded(raw * weight, 4))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= F.col("k"))
        .select("query_id", "step", "chunk_id", "raw_similarity", "relevance_score", "rank")
    )
