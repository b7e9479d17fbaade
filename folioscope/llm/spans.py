"""Substring dedup: sliding spans of consecutive sentences, clauses and parts of long clauses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_batches, spare_name, stored

# A sentence or clause with the marks that end it; text without marks is one.
SENTENCE = re.compile(r"[^.!?;:,|\n]*[.!?;:,|\n]+|[^.!?;:,|\n]+")
# A span has so many sentences and words at least.
SENTENCES, WORDS = 3, 20
# Longer sentences and clauses are cut into parts of at most so many words. A repeated
# passage loses fewer than 2 * CUT words at either end before its cuts agree with those
# of the other copy, and a span may end CUT - 1 words late: 8 leaves a span in 49 words.
CUT = 8
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def borders(words: list[bytes], clause: np.ndarray) -> np.ndarray:
    """Places of ``words`` before which their clause is cut: the last smallest hash of any
    CUT words in a row, the first of a clause aside. Whether a place is one depends on the
    CUT - 1 words on either side only, and no part has more than CUT words."""
    value = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    if len(value) <= CUT:
        return np.zeros(0, np.int64)
    lowest = np.lib.stride_tricks.sliding_window_view(value, CUT)[:, ::-1].argmin(1)
    at = np.arange(len(lowest))
    # windows inside one clause and behind its first word
    inside = (clause[CUT - 1 :] == clause[: len(at)]) & np.concatenate([[False], clause[1 : len(at)] == clause[: len(at) - 1]])
    return np.unique((at + CUT - 1 - lowest)[inside])


def sentences(text: str | None) -> list[tuple[int, int, bytes]]:
    """(start, end, words) of the sentences and clauses of a whole text that hold a
    word; those of more than CUT words are cut into parts at ``borders``. What lies
    between two belongs to the one before."""
    out, words, clause, places = [], [], [], []
    for m in SENTENCE.finditer(text or ""):
        own = m[0].encode("utf-8", "replace").split()
        if own and any(c.isalnum() for c in m[0]):
            if len(own) > CUT:
                starts = [w.start() + m.start() for w in WORD.finditer(m[0])]
                clause += [len(out)] * len(own)
                words += own
                places += starts
            out.append((m.start(), m.end(), b" ".join(own)))
    if not words:
        return out
    numbers = np.array(clause)
    cuts: dict[int, list[int]] = {}
    for at in borders(words, numbers).tolist():
        cuts.setdefault(clause[at], []).append(at)
    first = np.searchsorted(numbers, np.arange(len(out) + 1)).tolist()
    parts = []
    for k, whole in enumerate(out):
        if k not in cuts:
            parts.append(whole)
            continue
        ends = [*cuts[k], first[k + 1]]
        start, at = whole[0], first[k]
        for end in ends:
            stop = places[end] if end < first[k + 1] else whole[1]
            parts.append((start, stop, b" ".join(words[at:end])))
            start, at = stop, end
    return parts


def span_ends(found: list[tuple[int, int, bytes]], least: int = SENTENCES, words: int = WORDS) -> np.ndarray:
    """For each sentence the end of the shortest span from it that has ``least``
    sentences and ``words`` words; 0 where the text ends before."""
    total = np.concatenate([[0], np.cumsum([w.count(b" ") + 1 for _, _, w in found])]).astype(np.int64)
    start = np.arange(len(found))
    end = np.maximum(start + least, np.searchsorted(total, total[:-1] + words))
    return np.where(end <= len(found), end, 0)


# Odd factors of two polynomial hashes modulo 2**64, and of the last mix.
FACTORS = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03]
MIX = np.uint64(0xFF51AFD7ED558CCD)


def hashes(found: list[tuple[int, int, bytes]], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, 64 and 32 bits of the hash) of every span: differences of prefix sums of
    the sentences' hashes times rising powers, brought to power 0 at the span's start."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for _, _, w in found), np.uint64, len(found))
    start = np.flatnonzero(ends)
    values = []
    for factor in FACTORS:
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(len(own), f, np.uint64)]) for f in (factor, pow(factor, -1, 2**64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up[:-1])])
        value = (sums[ends[start]] - sums[start]) * down[start] + (ends[start] - start).astype(np.uint64)
        value = (value ^ (value >> np.uint64(33))) * MIX
        values.append(value ^ (value >> np.uint64(29)))
    return start, values[0].view(np.int64), (values[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def repeated_spans(rows: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(id, at, n): spans of ``rows`` (id, text) that begin at sentence ``at`` and are not
    the first of their kind by id and place; and for each row one with at = -1 and its
    number of sentences ``n``.

    A task sends one span of each kind and batch only, its first; the others of the
    batch can't be first, and are known to repeat without meeting the rest."""

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, starts, high, low, counts = [], [], [], [], []
            for i, text in zip(frame["id"], frame["text"]):
                found = sentences(text)
                start, h, g = hashes(found, span_ends(found, least, words))
                ids.append(np.full(len(start), i, np.int64)), starts.append(start.astype(np.int32)), high.append(h), low.append(g), counts.append(len(found))
            whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (high, low, ids, starts)]
            out = pd.DataFrame(dict(zip(["h", "g", "id", "at"], whole)))
            out = out.sort_values(["id", "at"], kind="stable")
            again = out.duplicated(["h", "g"]).to_numpy()
            # rows known to repeat are spread by their own place
            out["h"] = np.where(again, out["id"].to_numpy() * 1_000_003 + out["at"].to_numpy(), out["h"])
            out["again"], out["n"] = again, pd.array([None] * len(out), "Int64")
            yield out
            # a row for each text, spread alike
            own = frame["id"].to_numpy(np.int64)
            yield pd.DataFrame({"h": own * 1_000_003 - 1, "g": 0, "id": own, "at": -1, "again": True, "n": pd.array(counts, "Int64")})

    shape = "h long, g int, id long, at int, again boolean, n long"
    kind = Window.partitionBy("again", "h", "g").orderBy("id", "at")
    # a repeated row has the same first place as its twin and stays with it
    seen = rows.mapInPandas(spans, shape).withColumn("first", F.first(F.struct("id", "at")).over(kind))
    return seen.where("again or first.id <> id or first.at <> at").select("id", "at", "n")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with every sentence removed that some non-first repeated span covers,
    where sentences are those of ``sentences``: also clauses and parts of long ones.

    Adds n_sentences, n_removed and removed_chars (like-named columns are replaced).
    Spans repeat if their words and marks agree, whatever white space parts them; the
    first by smallest id and place stays. Null and empty texts stay as they are; rows
    without an id aren't compared; rows that share an id are one document, from which
    the same sentences go. An empty table stays empty."""
    small_batches()
    ident, at = spare_name(docs, "id"), spare_name(docs, "at")
    given = docs.select(column(docs, doc_id).cast("long").alias("id"), column(docs, text).alias("text")).where("id is not null")
    places, count = F.collect_set(F.when(F.col("at") >= 0, F.col("at"))), F.when(F.count("n") == 1, F.max("n"))
    repeats = stored(repeated_spans(given, least, words).groupBy("id").agg(places.alias("at"), count.alias("n")))
    number = spare_name(docs, "n")
    repeats = repeats.select(F.col("id").alias(ident), F.col("at").alias(at), F.col("n").alias(number))

    @F.pandas_udf("text string, n_sentences long, n_removed long, removed_chars long")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts in batches:
            out = []
            for value, some in zip(texts, starts):
                found = sentences(value)
                gone = np.zeros(len(found) + 1, np.int64)
                if some is not None and len(some):
                    ends = span_ends(found, least, words)
                    start = np.array([s for s in some if s < len(found) and ends[s]], np.int64)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, ends[start], -1)
                gone = np.cumsum(gone)[:-1] > 0
                if not gone.any():
                    out.append((value, len(found), 0, 0))
                    continue
                kept, last, removed = [], 0, 0
                for (a, b, _), drop in zip(found, gone):
                    if drop:
                        kept.append(value[last:a])
                        last, removed = b, removed + b - a
                out.append(("".join([*kept, value[last:]]), len(found), int(gone.sum()), removed))
            yield pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "removed_chars"])

    new = spare_name(docs, "new")
    added = ["n_sentences", "n_removed", "removed_chars"]
    kept = [c for c in docs.columns if c.lower() not in added]
    key = column(docs, doc_id).cast("long")
    met = docs.where(key.isNotNull()).join(repeats, key == F.col(ident), "left").select(*[column(docs, c) for c in docs.columns], F.col(at), F.col(number))
    # rows without an id don't meet in one place
    whole = met.union(docs.where(key.isNull()).withColumn(at, F.lit(None).cast("array<int>")).withColumn(number, F.lit(None).cast("long")))
    # only texts that lose something, or whose sentences weren't counted alone, are split again
    asks = F.col(number).isNull() | (F.size(at) > 0)
    joined = whole.withColumn(new, clean(F.when(asks, column(docs, text)), F.when(asks, F.col(at))))
    shown = {"text": column(docs, text), "n_sentences": F.col(number), "n_removed": F.lit(0).cast("long"), "removed_chars": F.lit(0).cast("long")}
    taken = {c: F.when(asks, F.col(f"{new}.{c}")).otherwise(value) for c, value in shown.items()}
    return joined.select(*[taken["text"].alias(c) if c == text else column(docs, c) for c in kept], *[taken[c].alias(c) for c in added])
