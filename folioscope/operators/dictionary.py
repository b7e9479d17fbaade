"""Dictionaries of any size against texts, in one pass over the texts.

Keys come as a table.  A multi-pattern automaton finds all keys of a block at once, in
time that grows with the text and not with the number of keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import checkpointed
from folioscope.sizing import small_side

# Bytes of the keys that one automaton holds; more keys are found in several passes.
KEY_BYTES = 16 << 20
BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000
AUTOMATA: dict[str, object] = {}


def _automaton(name: str, shared) -> object:
    """The automaton of a broadcast block of keys, built once by each worker."""
    import ahocorasick

    if name not in AUTOMATA:
        made = ahocorasick.Automaton()
        ends, text, places = shared.value
        text = text.decode()
        for i, place in enumerate(places.tolist()):
            made.add_word(text[ends[i] : ends[i + 1]], place)
        made.make_automaton()
        AUTOMATA.clear()
        AUTOMATA[name] = made
    return AUTOMATA[name]


def _packed(rows: list) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(ends, text, places) of the keys in ``rows``: a few bytes a key besides its
    letters, as every worker holds them next to its automaton."""
    ends = np.cumsum([0, *[len(r["key"]) for r in rows]])
    return ends, "".join(r["key"] for r in rows).encode(), np.array([r["place"] for r in rows], np.int64)


def _places(text: Column, shared) -> Column:
    name = uuid.uuid4().hex

    @F.pandas_udf("array<long>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(name, shared)
        for batch in batches:
            yield pd.Series([None if t is None else sorted({place for _, place in automaton.iter(t)}) for t in batch], dtype=object)

    return found(text)


def with_keys(rows: DataFrame, text: Column, keys: DataFrame, name: str = "places", key_bytes: int = KEY_BYTES) -> DataFrame:
    """``rows`` with the array ``name`` of the places of all ``keys`` (key, place) that
    occur in ``text`` as they are, rising and each once; null for a null text.

    Equal keys count as the one of smallest place; null keys never occur, an empty one
    occurs in every text. The keys of a block, at most ``key_bytes`` of them, are collected
    and broadcast; blocks are as many as the measured bytes need."""
    once = checkpointed(keys.where("key is not null").groupBy("key").agg(F.min(F.col("place").cast("long")).alias("place")))
    held = once.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    blocks = max(1, -(-held // key_bytes))
    context, conf = rows.sparkSession.sparkContext, rows.sparkSession.conf
    if conf.get(BATCH_CONF) == "10000":  # Spark's default; workers hold whole batches of long texts
        conf.set(BATCH_CONF, str(BATCH_ROWS))
    filled, every = once.where("key <> ''"), [r["place"] for r in once.where("key = ''").collect()]
    found = F.when(text.isNotNull(), F.array(*[F.lit(p).cast("long") for p in every]).cast("array<long>"))
    for block in range(blocks):
        part = filled.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        held_keys = part.collect()
        if held_keys:
            shared = context.broadcast(_packed(held_keys))
            found = F.concat(found, _places(text, shared))
    return rows.withColumn(name, F.array_sort(found))


def first_key(rows: DataFrame, text: Column, keys: DataFrame) -> DataFrame:
    """``rows`` with the columns of the first of ``keys`` (key, place, ...), by place, that
    occurs in ``text``; null where none does. Places must be distinct."""
    met = with_keys(rows, text, keys, "_places").withColumn("_first", F.get("_places", F.lit(0))).drop("_places")
    found = keys.where("key is not null").withColumnRenamed("place", "_first")
    return met.join(small_side(found, 256), "_first", "left").withColumnRenamed("_first", "place")
