"""Overlapping, boundary-respecting text chunks as a fold per text.

The text is first turned into a flat list of steps: a paragraph that may fit
(``P``), a forced break before an oversized paragraph (``B``) and that
paragraph's sentences (``S``).  A fold then packs the steps.  A fold copies its state
at every step, so the steps are dealt to blocks: the inner fold holds the chunks closed in
its block only, and the outer one gathers them block by block.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import let, strip

# Steps of one inner fold.
BLOCK_STEPS = 256
# Texts with more characters are folded in blocks; the chunks are the same.
LONG_TEXT = 100_000
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"


def _steps(text: Column, size: int) -> Column:
    def kept(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda p: p != "")

    def step(kind: str, s: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), s.alias("s"))

    def expand(p: Column) -> Column:
        sentences = F.transform(kept(F.split(p, SENTENCE_GAP)), lambda s: step("S", s))
        return F.when(F.length(p) <= size, F.array(step("P", p))).otherwise(
            F.concat(F.array(step("B", F.lit(""))), sentences)
        )

    return F.flatten(F.transform(kept(F.split(text, "\n\n")), expand))


def chunk_texts(text: Column, size: int = 800, overlap: int = 150) -> Column:
    """Array of chunk bodies of ``text`` (blank bodies kept, so ordinals hold)."""
    body = strip(text)

    def state(open_: Column, n: Column, done: Column) -> Column:
        return F.struct(open_.alias("open"), n.cast("int").alias("n"), done.alias("done"))

    def tail(s: Column) -> Column:
        return F.substring(s, -overlap, overlap)

    def pack(acc: Column, x: Column) -> Column:
        is_sentence = x["kind"] == "S"
        gap = F.when(is_sentence, F.lit(1)).otherwise(F.lit(2))
        fits = (x["kind"] != "B") & (acc["n"] + F.length(x["s"]) <= size)
        joined = F.when(is_sentence, F.array_join(acc["open"], " ")).otherwise(F.array_join(acc["open"], "\n\n"))
        # A paragraph break drops the overlap when the closed body is short.
        carried = F.when(is_sentence | (F.length(joined) > overlap), tail(joined)).otherwise(F.lit(""))
        added = F.when(x["kind"] == "B", F.array().cast("array<string>")).otherwise(F.array(x["s"]))
        grown = F.when(x["kind"] == "B", F.lit(0)).otherwise(F.length(x["s"]) + gap)
        seed = F.when(carried != "", F.array(carried)).otherwise(F.array().cast("array<string>"))
        return F.when(fits, state(F.concat(acc["open"], added), acc["n"] + grown, acc["done"])).otherwise(
            F.when(F.size(acc["open"]) == 0, state(added, acc["n"] + grown, acc["done"])).otherwise(
                state(F.concat(seed, added), F.length(carried) + grown, F.concat(acc["done"], F.array(joined)))
            )
        )

    def closed(acc: Column, done: Column) -> Column:
        rest = strip(F.array_join(acc["open"], "\n\n"))
        last = F.try_element_at(done, F.lit(-1))
        return F.when((rest != "") & ~rest.eqNullSafe(last), F.concat(done, F.array(rest))).otherwise(done)

    empty = F.array().cast("array<string>")

    def pack_block(acc: Column, block: Column) -> Column:
        inner = F.aggregate(block, state(acc["open"], acc["n"], empty), pack)
        return let(inner, lambda i: state(i["open"], i["n"], F.concat(acc["done"], F.array(i["done"]))))

    def blocks(steps: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / BLOCK_STEPS).cast("int"))
        return F.transform(starts, lambda k: F.slice(steps, k * BLOCK_STEPS + 1, BLOCK_STEPS))

    start = state(empty, F.lit(0), F.array().cast("array<array<string>>"))
    long_ = F.aggregate(let(_steps(body, size), blocks), start, pack_block, lambda acc: let(F.flatten(acc["done"]), lambda done: closed(acc, done)))
    # one fold is faster where few chunks are copied
    short = F.aggregate(_steps(body, size), state(empty, F.lit(0), empty), pack, lambda acc: closed(acc, acc["done"]))
    packed = F.when(F.length(body) > LONG_TEXT, long_).otherwise(short)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", empty)
        .when(F.length(body) <= size + 100, F.array(body))
        .otherwise(packed)
    )
