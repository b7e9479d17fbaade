"""Mixing sources to target weights with hash-threshold histograms."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_ids, spare_name, stored, word_array

# A hash is read 12 bits at a time: 4096 buckets, 5 levels use 60 bits.
BITS, LEVELS = 12, 5


def targets(sizes: dict, weights: list[int], share: Fraction, most: int) -> dict:
    """Words wanted of each source: ``share`` of all words split by weight, no source
    above ``most`` times its size, what lies above shared again by weight.

    Sources are weighted in code-point order, the null source last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: list(map(ord, s))) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, wanted, free = share * sum(sizes.values()), {s: Fraction(0) for s in names}, [s for s in names if sizes[s]]
    while free and left:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if wanted[s] + unit * weight[s] >= most * sizes[s]]
        if not full:
            for s in free:
                wanted[s] += unit * weight[s]
            break
        for s in full:
            left -= most * sizes[s] - wanted[s]
            wanted[s] = Fraction(most * sizes[s])
        free = [s for s in free if s not in full]
    return {s: float(v) for s, v in wanted.items()}


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """``docs`` and how often the mix takes each document.

    Adds size (words of the whole text; null: 0), source_size, target (words wanted
    of the source), copies (double) and taken (long, words taken); like-named columns
    of the input are replaced. A source with target T and size S gives every document
    floor(T / S) times, and once more those whose hash lies under a threshold.
    Thresholds come from sums of words by source and hash bucket: the bucket in which
    the rest of the budget ends is cut into finer buckets until single hashes are
    left, of which the one on the boundary is taken if that comes nearer. Rows with
    equal id, source and text have one hash; such a group on the boundary is taken in
    the same part of each row. Null and empty texts have no words to take; an empty
    table stays empty. The driver holds one number per source and level."""
    size, place, group = (spare_name(docs, n) for n in ("size", "place", "group"))
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(
        *[column(docs, c) for c in kept], F.size(word_array(column(docs, text))).cast("long").alias(size),
        F.xxhash64(column(docs, doc_id), column(docs, source), column(docs, text)).alias(place),
    )
    by = column(rows, source)
    light = stored(rows.select(by.alias("source"), F.col(size).alias("size"), F.col(place).alias("hash")))
    plan = thresholds(light, weights, share, most)
    rows = rows.withColumn(group, by)
    low, hashed = F.col("low"), F.shiftrightunsigned(F.col(place), 64 - BITS * LEVELS)
    joined = rows.join(small_ids(plan), F.col(group).eqNullSafe(F.col("plan_source")))
    extra = F.when(hashed < low, 1.0).when(hashed == low, F.col("part")).otherwise(0.0)
    copies = F.when(F.col(size) == 0, F.col("whole").cast("double")).otherwise(F.col("whole") + extra)
    return joined.select(
        *[column(rows, c) for c in kept], F.col(size).alias("size"), F.col("plan_size").alias("source_size"), F.col("plan_target").alias("target"),
        copies.alias("copies"), F.floor(F.col(size) * copies).cast("long").alias("taken"),
    )


def thresholds(light: DataFrame, weights: tuple, share: Fraction, most: int) -> DataFrame:
    """One row per source: target, whole copies, and the hash below which one more is
    taken (at that hash: ``part`` of one). ``light``: (source, size, hash)."""
    spark = light.sparkSession
    sizes = {r["source"]: r["n"] for r in light.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(sizes, list(weights), Fraction(share), most)
    state = {s: {"whole": int(wanted[s] // n) if n else 0, "rest": wanted[s] - n * (wanted[s] // n) if n else 0.0, "low": 0} for s, n in sizes.items()}
    kind = "plan_source string, whole int, rest double, low long"
    window = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        # buckets of this level inside the boundary bucket of the level before
        now = spark.createDataFrame([(s, v["whole"], float(v["rest"]), v["low"]) for s, v in state.items()], kind)
        bucket = F.shiftrightunsigned("hash", 64 - BITS * level)
        inside = light.join(small_ids(now), F.col("source").eqNullSafe(F.col("plan_source"))).where(F.shiftrightunsigned(bucket, BITS) == F.col("low"))
        sums = inside.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        running = sums.withColumn("upto", F.sum("n").over(window)).where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", "n", "upto")).alias("b"))
        found = {r["source"]: r["b"] for r in running.collect()}
        for s, v in state.items():
            b = found.get(s)
            if b is None:  # nothing beyond the rest: only a source without words
                v["low"], v["n"] = (v["low"] + 1 << BITS) if level == 1 else (v["low"] << BITS), 0
            else:
                v["low"], v["n"], v["rest"] = b["bucket"], b["n"], v["rest"] - (b["upto"] - b["n"])
    edge = {}
    now = spark.createDataFrame([(s, v["whole"], float(v["rest"]), v["low"]) for s, v in state.items()], kind)
    at = light.join(small_ids(now), F.col("source").eqNullSafe(F.col("plan_source"))).where(F.shiftrightunsigned("hash", 64 - BITS * LEVELS) == F.col("low"))
    for r in at.groupBy("source").agg(F.count(F.when(F.col("size") > 0, 1)).alias("rows")).collect():
        edge[r["source"]] = r["rows"]
    out = []
    for s, v in state.items():
        part = v["rest"] / v["n"] if v.get("n") else 0.0
        if edge.get(s, 0) < 2:
            part = float(part >= 0.5)
        out.append((s, sizes[s], float(wanted[s]), v["whole"], v["low"], part))
    return spark.createDataFrame(out, "plan_source string, plan_size long, plan_target double, whole int, low long, part double")
