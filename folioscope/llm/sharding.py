"""Sharding by extendible hashing: a directory of hash prefixes that splits where full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_ids, spare_name, stored

# Hash bits in use, bits that one level of the directory adds, parts of a full key.
HASH_BITS, LEVEL_BITS, SALTS = 60, 12, 64


def hash_of(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def directory(light: DataFrame, limit: int) -> list[DataFrame]:
    """Levels of the directory: (bucket, depth, shard_bytes) by the first 12, 24, ...
    bits of ``light`` (h, bytes). A bucket has the depth of the first prefix that fits
    ``limit``; where none fits, depth is null and the next level goes on from it."""
    levels, over, at = [], None, 0
    while at < HASH_BITS:
        at += LEVEL_BITS
        bucket = F.shiftrightunsigned("h", HASH_BITS - at)
        inside = light if over is None else light.join(small_ids(over), F.shiftrightunsigned("h", HASH_BITS - at + LEVEL_BITS) == F.col("bucket"), "left_semi")
        sums = stored(inside.groupBy(bucket.alias("bucket")).agg(F.sum("bytes").alias("n")))
        # the sums of all shorter prefixes of this level, of which the shortest fitting one counts
        shorter = F.explode(F.sequence(F.lit(at - LEVEL_BITS + (at > LEVEL_BITS)), F.lit(at)))
        tried = sums.select("bucket", "n", shorter.alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(bucket, {at} - depth)"))
        fits = tried.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
        best = tried.join(fits, ["depth", "prefix"]).groupBy("bucket").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
        level = stored(sums.join(best, "bucket", "left").select("bucket", F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes")))
        levels.append(level)
        over = stored(level.where("depth is null").select("bucket"))
        if over.isEmpty():
            break
    return levels


def shards(docs: DataFrame, limit: int = 256 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with bytes, depth, prefix, page and shard_bytes (like-named columns are
    replaced): the shard (depth, prefix, page) of every row.

    A shard holds the rows whose key hash starts with ``depth`` bits equal to
    ``prefix``; only shards above ``limit`` bytes of text split on another bit. Rows that
    share a whole hash can't be split so: they go to numbered pages of at most ``limit``
    bytes. A row above half the limit has a page of its own there, and one above the limit is
    the only case of a page that exceeds it. Null
    texts have 0 bytes, null keys hash as empty ones, an empty table stays empty."""
    added = ["bytes", "depth", "prefix", "page", "shard_bytes"]
    kept = [c for c in docs.columns if c.lower() not in added]
    h, size = spare_name(docs, "h"), spare_name(docs, "size")
    rows = docs.select(*[column(docs, c) for c in kept], hash_of(column(docs, key)).alias(h), F.coalesce(F.octet_length(column(docs, text)), F.lit(0)).cast("long").alias(size))
    levels = directory(stored(rows.select(F.col(h).alias("h"), F.col(size).alias("bytes"))), limit)
    found = rows
    for k, level in enumerate(levels):
        named = level.select(F.col("bucket").alias(f"{h}b{k}"), F.col("depth").alias(f"{h}d{k}"), F.col("shard_bytes").alias(f"{h}s{k}"))
        side = F.broadcast(named) if k == 0 else small_ids(named)  # the first level has 4096 rows at most
        found = found.join(side, F.shiftrightunsigned(F.col(h), HASH_BITS - LEVEL_BITS * (k + 1)) == F.col(f"{h}b{k}"), "left")
    depth = F.coalesce(*[F.col(f"{h}d{k}") for k in range(len(levels))])
    total = F.coalesce(*[F.col(f"{h}s{k}") for k in range(len(levels))])
    found = found.withColumn(f"{h}d", depth).withColumn(f"{h}s", total)
    prefix = F.expr(f"shiftrightunsigned({h}, {HASH_BITS} - {h}d)")
    placed = found.where(F.col(f"{h}d").isNotNull()).select(
        *[column(rows, c) for c in kept], F.col(size).alias("bytes"), F.col(f"{h}d").alias("depth"), prefix.alias("prefix"), F.lit(0).cast("long").alias("page"), F.col(f"{h}s").alias("shard_bytes"),
    )
    if len(levels) * LEVEL_BITS < HASH_BITS:
        return placed
    # one hash exceeds the limit by itself: pages, numbered apart in salted parts
    full = found.where(F.col(f"{h}d").isNull()).withColumn(f"{h}o", F.monotonically_increasing_id()).withColumn(f"{h}salt", F.pmod(F.col(f"{h}o"), F.lit(SALTS)))
    big = 2 * F.col(size) > limit
    running = Window.partitionBy(h, f"{h}salt").orderBy(f"{h}o").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(big, F.lit(0)).otherwise(F.col(size))).over(running), F.lit(0))
    alone = F.coalesce(F.sum(big.cast("long")).over(running), F.lit(0))
    page = F.when(big, -1 - alone).otherwise(F.floor(before / (limit / 2)))
    paged = full.withColumn(f"{h}page", (page * SALTS + F.when(big, -F.col(f"{h}salt")).otherwise(F.col(f"{h}salt"))).cast("long"))
    whole = F.sum(size).over(Window.partitionBy(h, f"{h}page"))
    return placed.union(paged.select(*[column(rows, c) for c in kept], F.col(size), F.lit(HASH_BITS), F.col(h), F.col(f"{h}page"), whole))


SQL = """
WITH rows AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents),
tried AS (SELECT *, unnest(range(0, 61))::INT AS depth FROM rows),
sums AS (SELECT depth, h >> (60 - depth) AS prefix, sum(bytes)::BIGINT AS shard_bytes FROM tried GROUP BY ALL),
leaf AS (
  SELECT r.doc_id, r.h, r.bytes, min(s.depth) AS depth FROM tried r JOIN sums s ON r.depth = s.depth AND r.h >> (60 - r.depth) = s.prefix
  WHERE s.shard_bytes <= 1048576 GROUP BY ALL)
SELECT l.doc_id, l.bytes, l.depth, s.prefix::BIGINT AS prefix, 0::BIGINT AS page, s.shard_bytes
FROM leaf l JOIN sums s ON l.depth = s.depth AND l.h >> (60 - l.depth) = s.prefix
"""
