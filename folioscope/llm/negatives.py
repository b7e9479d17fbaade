"""Hard negatives by inner product: length buckets with sorted coordinate lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_batches, stored

# Rows of a bucket, buckets and anchors that one task meets at most, coordinates that an
# anchor looks at, and the share of a bucket beyond which its whole matrix is multiplied.
BUCKET_ROWS, TASK_BUCKETS, TASK_ANCHORS, FOCUS, DENSE = 2_048, 64, 65_536, 5, 0.25
NONE = np.iinfo(np.int64).min
FEW, MANY = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


def whole(vectors: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as doubles (infinite ones as the largest)."""
    x = np.floor(np.array(vectors, np.float64).reshape(len(vectors), -1) * scale)
    return np.nan_to_num(x, posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` and ``b``, as longs; those that
    a long can't hold become its least or largest value."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    with np.errstate(over="ignore"):
        most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    x, y = (np.array([[int(v) for v in row] for row in m], object) for m in (a, b))
    return np.array([[min(max(int((p * q).sum()), FEW), MANY) for q in y] for p in x], np.int64).reshape(len(a), len(b))


@dataclass
class Bucket:
    """Rows of like length. ``order[f]``: its rows by rising value of coordinate f."""

    ids: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    order: np.ndarray
    longest: float = 0.0
    unit: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            length = np.linalg.norm(self.matrix, axis=1)
            self.longest = float(length.max()) if len(length) else 0.0
            self.unit = np.where(length[:, None] > 0, self.matrix / length[:, None], 0.0)

    @staticmethod
    def of(frame: pd.DataFrame, matrix: np.ndarray) -> Bucket:
        by_id = np.lexsort((frame["number"].to_numpy(), frame["id"].to_numpy()))
        made = Bucket(frame["id"].to_numpy(np.int64)[by_id], frame["number"].to_numpy(np.int64)[by_id], frame["label"].to_numpy()[by_id], matrix[by_id], np.zeros((0, 0), np.int32))
        made.order = np.argsort(made.unit, axis=0, kind="stable").T.astype(np.int32)
        return made


@dataclass
class Anchors:
    """Rows that search, with the score each has to reach to change its result."""

    ids: np.ndarray
    numbers: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray
    least: np.ndarray

    def __post_init__(self) -> None:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            self.length = np.linalg.norm(self.matrix, axis=1)
            self.unit = np.where(self.length[:, None] > 0, self.matrix / self.length[:, None], 0.0)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]


def feasible(anchors: Anchors, bucket: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, open): for every anchor and focus coordinate the part of the
    bucket's sorted list in which rows may still reach the anchor's least score; open
    is False for anchors whom no row of the bucket can serve.

    A row of cosine c or more with the anchor lies within arccos(c) of it, so its angle
    to a coordinate axis differs from the anchor's by no more."""
    n, f = anchors.focus.shape
    low, high = np.zeros((n, f), np.int64), np.full((n, f), len(bucket.ids))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        need = anchors.least / (anchors.length * bucket.longest)
    # a score of zero or less is no bound on the angle; neither are lengths beyond doubles
    bound = (anchors.least > 0) & np.isfinite(anchors.length) & np.isfinite(bucket.longest)
    reach = ~bound | (need <= 1 + 1e-9)
    at = np.flatnonzero(bound & reach)
    if len(at):
        spread = np.arccos(np.minimum(need[at], 1.0))[:, None]
        own = np.arccos(np.clip(np.take_along_axis(anchors.unit[at], anchors.focus[at], 1), -1, 1))
        least, most = np.cos(np.minimum(np.pi, own + spread)) - 1e-9, np.cos(np.maximum(0, own - spread)) + 1e-9
        for c in np.unique(anchors.focus[at]):
            row, k = np.nonzero(anchors.focus[at] == c)
            values = bucket.unit[bucket.order[c], c]
            low[at[row], k] = np.searchsorted(values, least[row, k], "left")
            high[at[row], k] = np.searchsorted(values, most[row, k], "right")
    return low, high, reach & ((high > low).all(1) if f else True)


def reached(anchors: Anchors, bucket: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all pairs that reach the anchor's least score, from the
    candidates that all its feasible ranges share."""
    low, high, some = feasible(anchors, bucket)
    m, width = len(bucket.ids), (high - low).min(1) if low.shape[1] else np.full(len(low), len(bucket.ids))
    wide = np.flatnonzero(some & (width > DENSE * m))
    for at in range(0, len(wide), 256):
        block = wide[at : at + 256]
        score = products(anchors.matrix[block], bucket.matrix)
        a, b = np.nonzero(score >= anchors.least[block, None])
        yield block[a], b, score[a, b]
    for i in np.flatnonzero(some & (width <= DENSE * m)):
        found = np.concatenate([bucket.order[c, x:y] for c, x, y in zip(anchors.focus[i], low[i], high[i])])
        both = np.flatnonzero(np.bincount(found, minlength=m) == len(anchors.focus[i]))
        if len(both):
            score = products(anchors.matrix[i : i + 1], bucket.matrix[both])[0]
            hit = score >= anchors.least[i]
            yield np.full(int(hit.sum()), i), both[hit], score[hit]


class Best:
    """The best ``k`` rows of every slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.held = k, np.zeros((0, 4), np.int64)  # slot, score, id, number
        self.last = np.full(slots, NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        all_ = np.concatenate([self.held, np.stack([slot, score, ids, numbers], 1)])
        all_ = all_[np.lexsort((all_[:, 3], all_[:, 2], -all_[:, 1], all_[:, 0]))]
        start = np.r_[0, np.flatnonzero(np.diff(all_[:, 0])) + 1]
        rank = np.arange(len(all_)) - np.repeat(start, np.diff(np.r_[start, len(all_)]))
        self.held = all_[rank < self.k]
        full = all_[rank == self.k - 1]
        self.last[full[:, 0]] = full[:, 1]


def positives_of(anchors: Anchors, buckets: list[Bucket], k: int) -> np.ndarray:
    """(anchor, score, id, number) of each anchor's best ``k`` rows of its own label."""
    best = Best(len(anchors.ids), k)
    for bucket in buckets:
        anchors.least = best.last
        for a, b, score in reached(anchors, bucket):
            other = bucket.ids[b] != anchors.ids[a]
            a, b, score = a[other], b[other], score[other]
            best.add(a, score, bucket.ids[b], bucket.numbers[b])
    return best.held


def part_of(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of each long, rounded up or down, without leaving 64 bits."""
    tens, rest = np.divmod(score, 100)
    return tens * percent + (-((-rest * percent) // 100) if up else (rest * percent) // 100)


def negatives_of(anchors: Anchors, owner: np.ndarray, scores: np.ndarray, buckets: list[Bucket], k: int, low: int, high: int) -> np.ndarray:
    """(slot, score, id, number): for each slot (a positive of anchor ``owner`` with one
    of ``scores``) the best ``k`` rows of other labels between ``low`` and ``high`` percent."""
    floor, roof = part_of(scores, low, True), part_of(scores, high, False)
    best = Best(len(owner), k)
    first = np.searchsorted(owner, np.arange(len(anchors.ids) + 1))
    most = int(np.diff(first).max()) if len(anchors.ids) else 0
    for bucket in buckets:
        least = np.where(floor <= roof, np.maximum(best.last, floor), MANY)
        anchors.least = np.full(len(anchors.ids), MANY)
        np.minimum.at(anchors.least, owner, least)
        for a, b, score in reached(anchors, bucket):
            other = bucket.labels[b] != anchors.labels[a]
            a, b, score = a[other], b[other], score[other]
            for step in range(most):
                slot = first[a] + step
                inside = slot < first[a + 1]
                inside[inside] &= (score[inside] <= roof[slot[inside]]) & (score[inside] >= least[slot[inside]])
                if inside.any():
                    best.add(slot[inside], score[inside], bucket.ids[b[inside]], bucket.numbers[b[inside]])
    return best.held


def unpacked(rows: pd.DataFrame, dim: int) -> list[Bucket]:
    """Buckets of a task, longest first."""
    out = []
    for r in rows.sort_values(["longest", "bucket"], ascending=[False, True]).itertuples():
        m = len(r.ids) // 8
        matrix = np.frombuffer(r.matrix, r.kind).reshape(m, dim).astype(np.float64)
        out.append(Bucket(np.frombuffer(r.ids, np.int64), np.frombuffer(r.numbers, np.int64), np.array([r.label] * m, object), matrix, np.frombuffer(r.listed, np.int32).reshape(dim, m)))
    return out


def bucketed(rows: DataFrame, scale: float) -> DataFrame:
    """Stored buckets of ``rows`` (number, id, label, dim, vector): at most BUCKET_ROWS
    rows of one label and neighbouring lengths, with their sorted coordinate lists."""
    label = dict(rows.dtypes)["label"]
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    parts = max(1, -(-rows.count() // (8 * BUCKET_ROWS)))
    ranged = rows.withColumn("length", length).repartitionByRange(parts, "dim", "label", F.desc("length"), "number").sortWithinPartitions("dim", "label", F.desc("length"), "number")

    def flushed(frame: pd.DataFrame) -> dict:
        made = Bucket.of(frame, whole(frame["vector"].tolist(), scale))
        # as few bytes as the values need
        most = float(np.abs(made.matrix).max()) if made.matrix.size else 0.0
        kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
        return {
            "dim": int(frame["dim"].iloc[0]), "label": frame["label"].iloc[0], "longest": made.longest, "kind": kind, "ids": made.ids.tobytes(),
            "numbers": made.numbers.tobytes(), "matrix": made.matrix.astype(kind).tobytes(), "listed": made.order.tobytes(),
        }

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            group = (frame[["dim", "label"]] != frame[["dim", "label"]].shift()).any(axis=1).cumsum()
            done, held = [], None
            for _, same in frame.groupby(group, sort=False):
                while len(same) > BUCKET_ROWS:
                    done.append(flushed(same.iloc[:BUCKET_ROWS]))
                    same = same.iloc[BUCKET_ROWS:]
                if held is not None:
                    done.append(flushed(held))
                held = same
            if done:
                yield pd.DataFrame(done)
        if held is not None and len(held):
            yield pd.DataFrame([flushed(held)])

    fields = f"dim int, label {label}, longest double, kind string, ids binary, numbers binary, matrix binary, listed binary"
    return stored(ranged.mapInPandas(cut, fields).withColumn("bucket", F.monotonically_increasing_id()))


def grid(asking: DataFrame, buckets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Anchors and buckets dealt to blocks (q, s) within equal ``keys``: every anchor
    meets every bucket of its keys once, in blocks of bounded size. Few buckets are still
    spread over the session's cores."""
    cores = asking.sparkSession.sparkContext.defaultParallelism
    asked = asking.groupBy(*keys).agg(F.ceil(F.count("*") / TASK_ANCHORS).cast("int").alias("down"))
    slices = F.greatest(F.ceil(F.count("*") / TASK_BUCKETS), F.least(F.count("*"), F.lit(1 if "label" in keys else 2 * cores)))
    sizes = stored(asked.join(buckets.groupBy(*keys).agg(slices.cast("int").alias("across")), keys))
    a = asking.join(sizes, keys).withColumn("q", F.pmod(F.xxhash64("number"), F.col("down")).cast("int"))
    b = buckets.join(sizes, keys).withColumn("s", F.pmod(F.xxhash64("bucket"), F.col("across")).cast("int"))
    a = a.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    b = b.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    return a.drop("down", "across"), b.drop("down", "across")


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: float = 256.0, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    the rows of ``vectors`` that meet the condition ``anchor``.

    A score is the integer inner product of the floors of ``scale`` times each component;
    higher ones come first, ties by smaller id. Positives of an anchor are its first
    ``n_positive`` rows of the same label; to each belong the first ``n_negative`` rows
    of other labels whose score is ``low`` to ``high`` percent of the positive's.

    Rows lie in buckets of one label and like length, with sorted lists of every
    coordinate of the unit vectors. A task takes its buckets by falling length, keeps
    for each anchor the score that would still change its result, skips buckets too
    short for it, intersects the feasible ranges of the anchor's FOCUS largest coordinates
    and computes the scores of the candidates left. Where the narrowest range holds over
    DENSE of a bucket, the whole bucket is multiplied at once.

    Rows with a null id, label or vector, or a null or non-finite component, take no part;
    vectors of different lengths never meet; zero vectors score 0. Repeated rows each
    count, but a row never meets one of its own id. Scores beyond a long become its
    ends. Other columns are ignored, an empty table gives no row."""
    small_batches()
    v = column(vectors, embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("number"), column(vectors, vec_id).cast("long").alias("id"), column(vectors, label).alias("label"),
        F.size(v).alias("dim"), v.cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"), (v.isNotNull() & ~bad).alias("fine"),
    ).where("id is not null and label is not null and fine").drop("fine")
    rows = stored(rows)
    kind = dict(rows.dtypes)["label"]
    buckets = bucketed(rows.drop("asks"), scale)
    asking = stored(rows.where("asks").drop("asks"))

    def block(frame: pd.DataFrame) -> Anchors:
        n = len(frame)
        return Anchors(frame["id"].to_numpy(np.int64), frame["number"].to_numpy(np.int64), frame["label"].to_numpy(object), whole(frame["vector"].tolist(), scale), np.full(n, NONE))

    def nearest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"number": [], "score": [], "positive": [], "other": []})
        anchors = block(a)
        got = positives_of(anchors, unpacked(b, int(b["dim"].iloc[0])), n_positive)
        return pd.DataFrame({"number": anchors.numbers[got[:, 0]], "score": got[:, 1], "positive": got[:, 2], "other": got[:, 3]})

    def between(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"number": [], "place": [], "score": [], "negative": [], "other": []})
        anchors = block(a)
        counts = a["scores"].map(len).to_numpy()
        owner, place = np.repeat(np.arange(len(a)), counts), np.concatenate([np.arange(n) for n in counts])
        got = negatives_of(anchors, owner, np.concatenate(a["scores"].tolist()).astype(np.int64), unpacked(b, int(b["dim"].iloc[0])), n_negative, low, high)
        return pd.DataFrame({"number": anchors.numbers[owner[got[:, 0]]], "place": place[got[:, 0]], "score": got[:, 1], "negative": got[:, 2], "other": got[:, 3]})

    keys = ["dim", "label"]
    a, b = grid(asking, buckets, keys)
    first = a.groupBy(*keys, "q", "s").cogroup(b.groupBy(*keys, "q", "s")).applyInPandas(nearest, "number long, score long, positive long, other long")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "positive", "other")
    chosen = first.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n_positive)
    listed = stored(chosen.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "score", "positive"))).alias("best")))
    ready = asking.join(listed, "number").withColumn("scores", F.col("best.score"))
    a, b = grid(stored(ready.drop("best")), buckets, ["dim"])
    found = a.groupBy("dim", "q", "s").cogroup(b.groupBy("dim", "q", "s")).applyInPandas(between, "number long, place int, score long, negative long, other long")
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), "negative", "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negative)
    return ranked.join(ready.select("number", "id", "best"), "number").select(
        F.col("id").alias("anchor_id"), F.get("best", F.col("place"))["positive"].alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.get("best", F.col("place"))["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )


SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER w AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 3
"""
