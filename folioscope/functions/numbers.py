"""Rounding shared by all scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 4) -> Column:
    """Half-to-even rounding in plain double arithmetic (no decimals per row)."""
    scale = float(10**places)
    return F.rint(c * scale) / scale
