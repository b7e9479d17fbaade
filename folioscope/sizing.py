"""Size checks that decide between a broadcast side and a partitioned one."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import BROADCAST_BYTES


def blocks_needed(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> int:
    """How many blocks of at most ``limit`` bytes hold ``df`` (one small count)."""
    return max(1, math.ceil(df.count() * row_bytes / limit))


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    return blocks_needed(df, row_bytes, limit) == 1


def small_side(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint only if it is proven small; else unhinted,
    so that the join shuffles and AQE may split skewed keys."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def block_of(df: DataFrame, keys: list[str], block: int, blocks: int) -> DataFrame:
    return df if blocks == 1 else df.where(F.pmod(F.xxhash64(*keys), F.lit(blocks)) == block)
