"""Embedding near-duplicates by product quantisation with coarse inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import column, components, forest, stored

# Vectors per inverted list aimed at, most lists, and rows of either side of a tile.
LIST_ROWS, MOST_LISTS, TILE_ROWS = 2_000, 1_024, 4_096
# Parts of a residual that are quantised apart, and codes of each part.
SUBSPACES, CODES = 8, 256


def means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means centres from evenly spaced starting rows (fewer if rows repeat)."""
    centres = np.unique(x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)], axis=0)
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, c, len(centres)) for c in x.T], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    bias = (centres**2).sum(1)
    return np.concatenate([(bias - 2 * x[at : at + 4096] @ centres.T).argmin(1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and code books of the parts of what is left beside them."""

    coarse: np.ndarray
    books: list[np.ndarray]

    def parts(self) -> list[slice]:
        ends = np.linspace(0, self.coarse.shape[1], len(self.books) + 1).astype(int)
        return [slice(a, b) for a, b in zip(ends, ends[1:])]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row, and its distance from what they stand for."""
        rest = x - self.coarse[cell]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts(), self.books)], 1)
        there = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - there) ** 2).sum(1))

    def table_distances(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries from coded rows of a list, by table lookup."""
        rest = query - self.coarse[cell]
        total = np.zeros((len(query), len(codes)))
        for k, (p, b) in enumerate(zip(self.parts(), self.books)):
            part = rest[:, p]
            table = (part**2).sum(1)[:, None] - 2 * part @ b.T + (b**2).sum(1)
            total += table[:, codes[:, k]]
        return np.maximum(total, 0)

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for every other list whose border with the row's own lies within
        ``reach`` of the row. The distances of two neighbours in two lists from the border
        sum to their own distance at most, so one of them asks if ``reach`` is half of it."""
        rows, lists = [], []
        for at in range(0, len(x), 1024):
            block, own = x[at : at + 1024], cell[at : at + 1024]
            d = (self.coarse**2).sum(1) - 2 * block @ self.coarse.T
            norm = (self.coarse**2).sum(1)
            apart = np.sqrt(np.maximum(norm[own][:, None] + norm - 2 * self.coarse[own] @ self.coarse.T, 1e-18))
            border = (d - d[np.arange(len(block)), own][:, None]) / (2 * apart)
            r, c = np.nonzero((border <= reach + 1e-9) & (np.arange(len(self.coarse)) != own[:, None]))
            rows.append(r + at), lists.append(c)
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(lists or [np.zeros(0, int)])


def fit(vectors: DataFrame, rows: int, bound: int) -> Quantiser:
    """Quantiser of unit vectors, fitted on at most ``bound`` of ``vectors`` (id,
    vector) with the smallest id hashes. ``rows``: how many there are."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(bound).select("vector").collect()
    x = np.array([r["vector"] for r in sample], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coarse = means(x, int(np.clip(rows // LIST_ROWS, 1, MOST_LISTS)))
    rest = x - coarse[nearest(x, coarse)]
    ends = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    return Quantiser(coarse, [means(rest[:, a:b], CODES) for a, b in zip(ends, ends[1:])])


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.98, reach: float = 0.1, bound: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Rows with equal, not null labels link when their cosine in double precision is
    ``least`` or more. Equal vectors of a label are searched once and count as links of
    each other. Every vector is listed under its nearest coarse centre with the codes of
    its residual; it asks its own list and those whose border lies within ``reach``
    (half of sqrt(2 - 2 * least) finds every pair, as either end may ask; less trades
    recall for probes). Of pairs whose ends both ask, the one from the earlier list counts.
    Table distances, widened by what the code of a vector loses, choose the pairs whose
    cosine is computed. Lists of any length are cut into tiles of bounded size.

    Null, empty, zero, null-holding and non-finite vectors, null labels and null ids link
    with nothing (a null id has a null component). Vectors of different lengths never
    link. Rows that share an id are one node. Other columns are ignored; an empty table
    gives no row. The quantiser is fitted on at most ``bound`` vectors."""
    rows = vectors.select(column(vectors, vec_id).cast("long").alias("id"), column(vectors, label).alias("label"), column(vectors, embedding).cast("array<double>").alias("vector"))
    fine = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    same = stored(fine.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies")))
    dims = [r[0] for r in same.select(F.size("vector")).distinct().collect()]
    found = [search(same.where(F.size("vector") == d), least, reach, bound) for d in dims]
    copies = fine.join(same.select("label", "vector", F.col("id").alias("first"), "copies"), ["label", "vector"]).select("id", "first", "copies")
    members = stored(copies)
    tallies = vectors.sparkSession.createDataFrame([], "first long, n long")
    edges = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    for out in found:
        tallies = tallies.union(out.where("b is null").select("a", "n"))
        edges = edges.union(out.where("b is not null").select("a", "b"))
    tallies = tallies.groupBy("first").agg(F.sum("n").alias("n"))
    linked = members.join(tallies, "first", "left").select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    whole = rows.select("id").join(linked, "id", "left").join(components(edges).withColumnRenamed("node", "id"), "id", "left")
    out = whole.select(F.col("id").alias(vec_id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(column(out, vec_id) == F.col("component_id"), F.lit(True)))


def search(same: DataFrame, least: float, reach: float, bound: int) -> DataFrame:
    """Rows (a, b, n): b null: vector ``a`` has n more links; else an edge that
    connects. ``same``: distinct vectors (label, vector, id, copies) of one length."""
    coder = fit(same, same.count(), bound)
    radius = float(np.sqrt(2 - 2 * least))
    kind = dict(same.dtypes)["label"]

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            raw = np.array(frame["vector"].tolist(), float)
            x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
            cell = nearest(x, coder.coarse)
            codes, lost = coder.encode(x, cell)
            plain = [v.tobytes() for v in raw]
            base = pd.DataFrame({"label": frame["label"], "id": frame["id"], "copies": frame["copies"], "raw": plain})
            row, other = coder.probes(x, cell, reach)
            probed = np.zeros((len(x), len(coder.coarse)), bool)
            probed[row, other] = True
            yield base.assign(cell=cell, home=cell, own=True, codes=[c.tobytes() for c in codes], lost=lost, probed=[p.tobytes() for p in np.packbits(probed, axis=1)])
            for at in range(0, len(row), 20_000):
                part = base.iloc[row[at : at + 20_000]].reset_index(drop=True)
                yield part.assign(cell=other[at : at + 20_000], home=cell[row[at : at + 20_000]], own=False, codes=None, lost=0.0, probed=None)

    fields = f"label {kind}, id long, copies long, raw binary, cell int, home int, own boolean, codes binary, lost double, probed binary"
    lists = stored(same.mapInPandas(placed, fields))
    sizes = lists.groupBy("label", "cell").agg(F.ceil(F.count(F.when(F.col("own"), 1)) / TILE_ROWS).cast("int").alias("down"), F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("across"))
    dealt = lists.join(sizes.where("down > 0"), ["label", "cell"])
    # every row asks; own rows are also asked
    asking = dealt.withColumn("q", F.pmod(F.xxhash64("id"), F.col("across")).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("down") - 1))).withColumn("asks", F.lit(True))
    asked = dealt.where("own").withColumn("m", F.pmod(F.xxhash64("id", F.lit(1)), F.col("down")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("across") - 1))).withColumn("asks", F.lit(False))

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        ask, there = frame[frame["asks"]], frame[~frame["asks"]]
        if not len(ask) or not len(there):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        ids = np.concatenate([ask["id"].to_numpy(np.int64), there["id"].to_numpy(np.int64)])
        weight = np.concatenate([ask["copies"].to_numpy(np.int64), there["copies"].to_numpy(np.int64)])
        a = np.stack([np.frombuffer(v, float) for v in ask["raw"]])
        b = np.stack([np.frombuffer(v, float) for v in there["raw"]])
        long_a, long_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        codes, lost = np.stack([np.frombuffer(c, np.uint8) for c in there["codes"]]), there["lost"].to_numpy(float)
        foreign, home = ~ask["own"].to_numpy(bool), ask["home"].to_numpy(int)
        probed = np.stack([np.frombuffer(p, np.uint8) for p in there["probed"]])
        tally, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(a), 256):
            unit = a[at : at + 256] / long_a[at : at + 256, None]
            rough = np.sqrt(coder.table_distances(unit, cell, codes))
            q, m = np.nonzero(rough <= radius + lost + 1e-6)
            links = []
            for k in range(0, len(q), 50_000):
                x, y = q[k : k + 50_000] + at, m[k : k + 50_000]
                near = (np.einsum("ij,ij->i", a[x], b[y]) / (long_a[x] * long_b[y]) >= least) & (ids[x] != ids[len(a) + y])
                # the other end, in an earlier list, asks as well
                near &= (home[x] <= cell) | (probed[y, home[x] // 8] >> (7 - home[x] % 8) & 1 == 0)
                links.append((x[near], len(a) + y[near]))
            if links:
                x, y = (np.concatenate(v) for v in zip(*links))
                np.add.at(tally, x, weight[y])
                outside = foreign[x]  # own rows ask for themselves
                np.add.at(tally, y[outside], weight[x[outside]])
                root = forest(len(ids), np.concatenate([np.arange(len(ids)), x]), np.concatenate([root, y]))
        joined, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(tally)
        return pd.DataFrame({
            "a": np.concatenate([ids[some], ids[joined]]), "n": np.concatenate([tally[some], np.zeros(len(joined), np.int64)]),
            "b": pd.array([None] * len(some) + ids[root[joined]].tolist(), dtype="Int64"),
        })

    return stored(asking.unionByName(asked).groupBy("label", "cell", "q", "m").applyInPandas(compared, "a long, b long, n long"))
