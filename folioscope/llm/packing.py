"""Best-fit packing of token pieces by bin completion with branch and bound."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_batches, stored

# Pieces that one task packs: more only save a part of one sequence per group.
GROUP_PIECES = 20_000
# Token ids that a Python worker hands over at a time.
FRAME_IDS = 1 << 20


@lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks) as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary() -> dict:
    """Places of the public byte-level vocabulary in both of its formats."""
    import public_tokenizers

    return {"path": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": "<|endoftext|>"}


def token_ids(text: str | None, path: str, ranks: str, pattern: str, special: str, ordinary: bool = False) -> np.ndarray:
    """Ids of a whole text. The ranks give the same ids as the tokenizer file, in less
    time; texts that spell the special token go through the tokenizer file."""
    text = text or ""
    if special in text and not ordinary:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoder(ranks, pattern).encode_to_numpy(text).astype(np.uint32, copy=False) if text else np.zeros(0, np.uint32)


def pieces(rows: DataFrame, limit: int, vocab: dict) -> DataFrame:
    """(named, doc_id, piece, start, length, ids) of ``rows`` (named, doc_id, text):
    every document with its end id 0, as little-endian ids of four bytes. Longer ones are
    cut into pieces of ``limit``, of which the first may be shorter."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, held = [], 0
            for known, i, text in zip(frame["named"], frame["doc_id"], frame["text"]):
                ids = np.append(token_ids(text, **vocab), np.uint32(0)).astype("<u4")
                start, number = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % limit or limit
                    out.append((known, i, number, start, length, ids[start : start + length].tobytes()))
                    start, number, held = start + length, number + 1, held + length
                if held >= FRAME_IDS:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["named", "doc_id", "piece", "start", "length", "ids"]
    return rows.mapInPandas(cut, "named boolean, doc_id long, piece int, start long, length long, ids binary")


def best_fit(counts: np.ndarray, limit: int) -> list[list[int]]:
    """Fillings by best fit decreasing over ``counts`` of pieces by length: each piece
    goes where it leaves the least space."""
    space: dict[int, list[list[int]]] = defaultdict(list)
    open_at = np.zeros(limit + 1, bool)
    bins = []
    for length in range(limit, 0, -1):
        for _ in range(int(counts[length])):
            fits = np.flatnonzero(open_at[length:])
            if len(fits):
                left = length + int(fits[0])
                filling = space[left].pop()
                open_at[left] = bool(space[left])
            else:
                left, filling = limit, []
                bins.append(filling)
            filling.append(length)
            space[left - length].append(filling)
            open_at[left - length] = left > length
    return bins


def completions(counts: np.ndarray, limit: int, afford: int, width: int) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest piece of ``counts`` that waste no more
    than ``afford``, least waste first.

    A filling is dominated when a longer piece that is left fits in place of one it
    holds, or one more piece fits; such are not made, as lengths are tried from the
    longest that fits and the last place always takes the longest. At most ``width``
    are enumerated."""
    lengths = np.flatnonzero(counts).tolist()
    largest, found, steps = lengths[-1], {}, [16 * width]
    have = counts.copy()
    have[largest] -= 1

    def fill(upto: int, space: int, taken: tuple[int, ...]) -> None:
        k = min(upto, bisect_right(lengths, space) - 1)
        open_ = False
        while k >= 0 and steps[0] > 0 and len(found) < width:
            v = lengths[k]
            if have[v]:
                steps[0] -= 1
                open_ = True
                have[v] -= 1
                fill(k, space - v, (*taken, v))
                have[v] += 1
                # without a second piece beside it, any shorter piece is dominated
                if space - v < lengths[0]:
                    break
            k -= 1
        if not open_ and space <= afford:
            found.setdefault(taken, space)

    fill(len(lengths) - 1, limit - largest, (largest,))
    return sorted(found, key=lambda f: (found[f], len(f)))


def complete(counts: np.ndarray, limit: int, bins: int, nodes: int, width: int) -> list[tuple[int, ...]] | None:
    """Fillings that need fewer than ``bins`` bins, by depth-first bin completion; None
    if there are none or ``nodes`` steps don't find them.

    A branch ends when its waste exceeds what ``bins`` - 1 bins can afford."""
    afford = (bins - 1) * limit - int((counts * np.arange(limit + 1)).sum())
    now, used, left = counts.copy(), [], int(counts.sum())
    frames = [iter(completions(now, limit, afford, width))] if left and afford >= 0 else []
    while frames and nodes > 0:
        nodes -= 1
        filling = next(frames[-1], None)
        if filling is None:
            frames.pop()
            if used:
                back = used.pop()
                np.add.at(now, list(back), 1)
                left, afford = left + len(back), afford + limit - sum(back)
            continue
        np.subtract.at(now, list(filling), 1)
        used.append(filling)
        left, afford = left - len(filling), afford - limit + sum(filling)
        if not left:
            return used
        frames.append(iter(completions(now, limit, afford, width)))
    return None


def waste_bound(counts: np.ndarray, limit: int) -> int:
    """Bins needed at least: for every k, pieces over half of ``limit`` stand alone, and
    what pieces of k up to half need beyond the space beside those that admit them."""
    length = np.arange(limit + 1)
    number, total = counts.cumsum(), (counts * length).cumsum()
    half = limit // 2
    k = np.arange(0, half + 1)
    beside, full = number[limit - k] - number[half], number[limit] - number[limit - k]
    small = total[half] - np.concatenate([[0], total])[k]
    need = small - (beside * limit - (total[limit - k] - total[half]))
    return int((full + beside + np.maximum(0, -(-need // limit))).max())


def pack(lengths: np.ndarray, limit: int, nodes: int = 20_000, width: int = 8) -> list[list[int]]:
    """Fillings (lists of lengths) in as few bins as the search finds.

    Best fit decreasing is the first incumbent. While it needs more bins than the
    waste bound, bin completion looks for a better one; ``nodes`` bounds each
    search, after which the incumbent stands."""
    counts = np.bincount(lengths, minlength=limit + 1)
    best = best_fit(counts, limit)
    bound = waste_bound(counts, limit)
    while len(best) > bound:
        better = complete(counts, limit, len(best), nodes, width)
        if better is None:
            break
        best = [list(f) for f in better]
    return best


def packed(cuts: DataFrame, limit: int, group: int = GROUP_PIECES) -> DataFrame:
    """``cuts`` (with a column length) with sequence_id and offset.

    Pieces are dealt evenly into groups of about ``group`` that are packed apart, so no
    task depends on ids, sources or copies; each group wastes at most a part of its
    last sequences. Pieces as long as ``limit`` fill a sequence of their own."""
    cuts = stored(cuts)
    groups = max(1, -(-cuts.count() // group))
    fields = cuts.columns

    def packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=fields)], ignore_index=True)
        if not len(frame):
            return
        lengths = frame["length"].to_numpy(np.int64)
        by_length: dict[int, list[int]] = defaultdict(list)
        for row, length in enumerate(lengths.tolist()):
            by_length[length].append(row)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        base = TaskContext.get().partitionId() << 32
        for number, filling in enumerate(pack(lengths, limit)):
            at = 0
            for length in filling:
                row = by_length[length].pop()
                sequence[row], offset[row] = base + number, at
                at += length
        frame = frame.assign(sequence_id=sequence, offset=offset)
        step = max(1, FRAME_IDS // limit)
        for at in range(0, len(frame), step):
            yield frame.iloc[at : at + step]

    kind = ", ".join(f"`{c}` {t}" for c, t in cuts.dtypes)
    return cuts.repartition(groups).mapInPandas(packs, f"{kind}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = 2048, vocab: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset, ids_crc32): all ``docs``
    as token pieces with their ids, packed into sequences of at most ``limit`` tokens.
    ``sequences`` puts them together; ids_crc32 is computed from ids where it is read.

    Null and empty texts are the end id alone. Every row is a document of its own, also
    when rows repeat; a null id stays null. Other columns are ignored; an empty table
    gives no row. Documents longer than ``limit`` end on whole pieces."""
    small_batches()
    given = column(docs, doc_id)
    rows = docs.select(given.isNotNull().alias("named"), F.coalesce(given.cast("long"), F.lit(0)).alias("doc_id"), column(docs, text).alias("text"))
    out = packed(pieces(rows, limit, vocab or vocabulary()), limit)
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).withColumn("ids_crc32", F.crc32("ids")).drop("named")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens, doc_ids, starts) of the pieces of ``pack_documents``:
    the ids of each sequence in order (little-endian, four bytes each), and the document
    and first token of each of its pieces. An empty table gives no row."""
    parts = F.collect_list(F.struct("offset", "length", "doc_id", "ids"))
    whole = packed_pieces.groupBy("sequence_id").agg(F.sort_array(parts).alias("p"))
    # binary has no linear join of many parts, text does
    flat = F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), ""))
    out = whole.select("sequence_id", flat.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
    return out.select("sequence_id", "ids", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "doc_ids", "starts")
