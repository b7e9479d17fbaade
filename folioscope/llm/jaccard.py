"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import BROADCAST_ROWS, column, components, small_batches, small_ids, stored

# Lists that are ordered last: at most so many of the most frequent shingles.
FREQUENT = 1 << 17
# Slack of the occurrence test: documents must share 1 + SLACK * size listed shingles.
SLACK = 0.05
# Shingles that a task holds to count them.
HELD_SHINGLES = 3_000_000
# Shingles that one search task holds of either side.
TASK_SHINGLES = 4_000_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of a whole text
    (A-Z lower-cased, ASCII white space between words); fewer words make one
    shingle, no word makes none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=k)] if words else [], np.uint64).astype(np.int64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = one[: len(one) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(1, k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[j : len(one) - k + 1 + j]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique((mixed ^ (mixed >> np.uint64(29))).astype(np.int64))


def least_overlap(n, percent: int):
    """Shingles that a set of ``n`` must share with any set linked to it."""
    return -(-n * percent // 100)


def frequent_shingles(docs: DataFrame, k: int, limit: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their counts): those met at least three times among the
    documents that a task holds at once, at most ``limit`` with the largest sums.

    They only decide the order in which lists are taken, so neither the limit nor
    what a task misses can change a result; ``limit`` bounds what the driver and
    the workers hold."""

    def repeated(sets: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        for part in range(4):  # a quarter of all hashes at a time
            found, times = np.unique(np.concatenate([own[own & 3 == part] for own in sets]), return_counts=True)
            yield pd.DataFrame({"s": found[times > 2], "times": times[times > 2]})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            for text in frame["text"]:
                held.append(shingles(text, k))
                size += len(held[-1])
                if size > HELD_SHINGLES:
                    yield from repeated(held)
                    held, size = [], 0
        if held:
            yield from repeated(held)

    top = docs.select("text").mapInPandas(counted, "s long, times long").groupBy("s").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "s").limit(limit)
    frame = top.toPandas()
    order = np.argsort(frame["s"].to_numpy(np.int64), kind="stable")
    return frame["s"].to_numpy(np.int64)[order], frame["times"].to_numpy(np.int64)[order]


def listed(found: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that go into inverted lists, rare ones first, and how
    many of the set are rare. The lists of two linked sets have 1 + SLACK * size of the
    smaller one in common at least: of the shared shingles, the first so many in
    list order stand within both."""
    n = len(found)
    if not n:
        return found, 0
    take = min(n, n - int(least_overlap(n, percent)) + 1 + int(np.floor(SLACK * n)))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        common = frequent[at] == found
    else:
        at, common = np.zeros(n, np.int64), np.zeros(n, bool)
    rare = found[~common]
    if len(rare) >= take:
        return rare[:take], len(rare)
    last = np.lexsort((found[common], times[at[common]]))
    return np.concatenate([rare, found[common][last][: take - len(rare)]]), len(rare)


class Parts:
    """Disjoint parts of n elements, as the part of each; the smaller part moves."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = [[k] for k in range(n)]

    def unite(self, a: int, b: int) -> bool:
        a, b = int(self.of[a]), int(self.of[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def divide_skip(sets: list[np.ndarray], sizes: np.ndarray, percent: int, parts: Parts, mu: float = 0.01) -> list[tuple[int, int]]:
    """Links that connect the sets exactly as all pairs with a Jaccard index of at least
    ``percent`` / 100 do, beyond what ``parts`` unites already. ``sizes`` also counts
    elements that no other set has and that ``sets`` may leave out.

    T-occurrence search: every set in turn asks for sets that hold T of its elements.
    Its long lists are set aside (L of them by the DivideSkip rule), the short ones are
    merged, and whoever occurs T - L times there is looked up in the long lists by
    binary search."""
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    keys, starts, counts = np.unique(flat, return_index=True, return_counts=True)
    out = []
    for q, own in enumerate(sets):
        at = np.searchsorted(keys, own)
        at = at[counts[at] > 1]
        need = int(least_overlap(sizes[q], percent))
        if len(at) < max(1, need):
            continue
        at = at[np.argsort(counts[at], kind="stable")]
        skip = min(need - 1, int(need / (mu * np.log2(max(2, int(counts[at[-1]]))) + 1)))
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        # a stable sort of sorted runs is their merge
        merged = np.sort(np.concatenate([owner[starts[i] : starts[i] + counts[i]] for i in short]), kind="stable")
        found, seen = np.unique(merged, return_counts=True)
        fit = (found > q) & (seen >= need - skip) & (parts.of[found] != parts.of[q]) & (100 * np.minimum(sizes[found], sizes[q]) >= percent * np.maximum(sizes[found], sizes[q]))
        found, seen = found[fit], seen[fit]
        for left, i in enumerate(long):
            alive = seen + len(long) - left >= need
            found, seen = found[alive], seen[alive]
            if not len(found):
                break
            run = owner[starts[i] : starts[i] + counts[i]]
            seen = seen + (run[np.minimum(np.searchsorted(run, found), len(run) - 1)] == found)
        for d in found[100 * seen >= percent * (sizes[found] + sizes[q] - seen)].tolist():
            if parts.unite(q, d):
                out.append((q, d))
    return out


def search_group(sets: list[np.ndarray], percent: int, united: list[int]) -> list[tuple[int, int]]:
    """Links (by position) that connect the sets of a group; those at ``united`` are
    connected already.

    Elements of one set alone can't be shared. Sets that agree in the rest and in size
    have the same links, so one of them asks for all; among themselves they link or
    none does."""
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
    shared = keys[counts > 1]
    kinds: dict[tuple[int, bytes], int] = {}
    kind_of, cores = np.zeros(len(sets), np.int64), []
    for k, own in enumerate(sets):
        core = own[shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own] if len(shared) else own[:0]
        key = (len(own), core.tobytes())
        if key not in kinds:
            kinds[key] = len(kinds)
            cores.append(core)
        kind_of[k] = kinds[key]
    first = np.zeros(len(cores), np.int64)
    first[kind_of[::-1]] = np.arange(len(sets))[::-1]
    n = sizes[first]
    common = np.array([len(c) for c in cores], np.int64)
    whole = (common > 0) & (100 * common >= percent * (2 * n - common))
    parts = Parts(len(cores))
    inner = [k for k in united if whole[kind_of[k]]]
    for k in inner[1:]:
        parts.unite(kind_of[inner[0]], kind_of[k])
    links = divide_skip(cores, n, percent, parts)
    touched = whole.copy()
    touched[[k for link in links for k in link]] = True
    out = [(int(first[a]), int(first[b])) for a, b in links]
    return out + [(int(first[kind_of[k]]), k) for k in np.flatnonzero(touched[kind_of]).tolist() if first[kind_of[k]] != k]


def listed_rows(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """(named, id, n, rare, digest, s) for every row of ``rows`` (named, id, text)."""
    frequent, times = frequent_shingles(rows, k)

    def lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, rare, digests, lists = [], [], [], []
            for text in frame["text"]:
                found = shingles(text, k)
                own, seldom = listed(found, frequent, times, percent)
                sizes.append(len(found)), rare.append(seldom), lists.append(own)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            yield pd.DataFrame({"named": frame["named"], "id": frame["id"], "n": sizes, "rare": rare, "digest": digests, "s": lists})

    return rows.mapInPandas(lists, "named boolean, id long, n long, rare long, digest binary, s array<long>")


def with_sets(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``asked`` (id, keys: array of structs) with the shingle set of each id as ``own``,
    one row per key. Texts move only if there are more keys
    than may be sent to every task."""

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "own": [shingles(t, k).tobytes() for t in frame["text"]], "keys": frame["keys"]})

    rows = asked.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    asked = F.broadcast(asked) if rows <= BROADCAST_ROWS else asked
    kind = dict(asked.dtypes)["keys"]
    found = docs.select("id", "text").join(asked, "id").mapInPandas(sets, f"id long, own binary, keys {kind}")
    return found.select("id", "own", F.explode("keys").alias("key")).select("id", "own", "key.*")


def grouped(rows: DataFrame, *keys: str) -> DataFrame:
    return stored(rows.groupBy("id").agg(F.collect_set(F.struct(*keys)).alias("keys")))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets, by binary search in the larger one."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def jaccard_links(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect ``docs`` (id, text; no null id) exactly as all pairs
    with 100 * intersection >= percent * union do. ``rows``: their listed_rows."""
    # 1. occurrences: who shares enough of the listed shingles with documents whose size
    # admits a link; in a list by size, the nearest one tells whether there is any
    by_size = Window.partitionBy("s").orderBy("n", "id")
    # equal sets are linked to the smallest id, which alone goes on
    some = rows.where("named and n > 0")
    first = stored(some.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    copies = stored(some.select("id", "digest").join(first, "digest").where("id <> first").select("id", "digest", "first"))
    copied = copies.select("id", "digest").distinct()
    copied = F.broadcast(copied) if copies.count() <= BROADCAST_ROWS else copied
    postings = some.join(copied, ["id", "digest"], "left_anti").select("id", "n", "rare", F.explode("s").alias("s"))
    same = copies.select(F.col("id").alias("a"), F.col("first").alias("b"))
    below, above = F.col("below") * 100 >= F.col("n") * percent, F.col("n") * 100 >= F.col("above") * percent
    beside = lambda df: df.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
    shared = stored(beside(postings).where(below | above).select("s", "id", "n", "rare"))
    need = F.lit(1) + F.floor(F.lit(SLACK) * F.ceil(F.col("n") * percent / 100))
    able = shared.groupBy("id").agg(F.count_distinct("s").alias("hits"), F.min("n").alias("n")).where(F.col("hits") >= need)
    kept = shared.join(small_ids(stored(able.select("id"))), "id", "left_semi")
    # 2. a list falls into runs of fitting sizes; every run names a pivot, and the members
    # of all runs of a pivot form a group
    run = F.sum(F.coalesce(~below, F.lit(True)).cast("int")).over(by_size)
    by_run = Window.partitionBy("s", "run").orderBy("rare", "id")
    placed = beside(kept).where(below | above).withColumn("run", run).withColumn("pivot", F.first("id").over(by_run))
    star = stored(placed.where("pivot <> id").groupBy("id", "pivot").agg(F.max("n").alias("n")))
    parts = F.ceil(F.sum("n") / TASK_SHINGLES).cast("int")
    groups = stored(star.groupBy("pivot").agg(parts.alias("parts")))
    members = star.join(groups, "pivot").select("id", "pivot", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    heads = groups.select(F.col("pivot").alias("id"), "pivot", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = with_sets(docs, grouped(members.union(heads), "pivot", "parts", "part"), k)

    def searched(frame: pd.DataFrame) -> pd.DataFrame:
        """All links of a group of one part; a part of a larger group meets the pivot."""
        sets, ids = [np.frombuffer(x, np.int64) for x in frame["own"]], frame["id"].to_numpy(np.int64)
        if frame["parts"].iloc[0] == 1:
            links = search_group(sets, percent, [])
            return pd.DataFrame({"a": [ids[x] for x, _ in links], "b": [ids[y] for _, y in links], "inside": None, "whole": None}, columns=["a", "b", "inside", "whole"])
        head = int(np.flatnonzero(ids == frame["pivot"].iloc[0])[0])
        inside = [overlap(sets[head], own) for own in sets]
        out = pd.DataFrame({"a": ids, "b": ids[head], "inside": inside, "whole": [len(own) + len(sets[head]) - n for own, n in zip(sets, inside)]})
        return out[out["a"] != out["b"]]

    found = stored(dealt.groupBy("pivot", "part").applyInPandas(searched, "a long, b long, inside long, whole long"))
    linked = F.col("inside") * 100 >= F.col("whole") * percent
    links = same.union(found.where(F.col("inside").isNull() | linked).select("a", "b"))
    large = found.where("inside is not null").select(F.col("a").alias("id"), F.col("b").alias("pivot"), "whole", linked.alias("linked"), (1 - F.col("inside") / F.col("whole")).alias("far"))
    if large.isEmpty():
        return links
    # 3. Jaccard distance is a metric: in a large group an unlinked member can link a linked
    # one only if their distances to the pivot differ by no more than a link allows
    reach = 1 - percent / 100 + 1e-9
    open_groups = large.groupBy("pivot").agg(F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest")).where("nearest is not null")
    left = stored(large.join(open_groups, "pivot").where(~F.col("linked") | (F.col("far") >= F.col("nearest") - reach)).select("pivot", "id", "linked", "whole"))
    tiles = stored(left.groupBy("pivot").agg(F.ceil(F.sum("whole") / TASK_SHINGLES).cast("int").alias("parts")))
    placed = left.join(tiles, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "pivot", "id", "linked", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")
    )

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["id"].to_numpy(np.int64)
        pairs = search_group([np.frombuffer(x, np.int64) for x in frame["own"]], percent, np.flatnonzero(frame["linked"].to_numpy(bool)).tolist())
        return pd.DataFrame({"a": [ids[x] for x, _ in pairs], "b": [ids[y] for _, y in pairs]}, columns=["a", "b"])

    rest = with_sets(docs, grouped(tiled, "pivot", "linked", "i", "j"), k)
    return links.union(rest.groupBy("pivot", "i", "j").applyInPandas(tile, "a long, b long"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents link when their sets of distinct ``k``-word shingles have a Jaccard
    index of at least ``percent`` / 100; component_id is the smallest id reachable.
    Null and empty texts have no shingle and link with nothing. Rows that share an
    id are one node, linked by any of their texts; a null id is never linked and has
    a null component. Other columns are ignored; an empty table gives no row. Sets are
    compared by 64-bit shingle hashes. Ids are integers."""
    small_batches()
    given = column(docs, doc_id).cast("long")
    texts = docs.select(given.isNotNull().alias("named"), F.coalesce(given, F.lit(0)).alias("id"), column(docs, text).alias("text"))
    rows = stored(listed_rows(texts, k, percent))
    found = components(jaccard_links(texts.where("named"), rows, k, percent)).withColumnRenamed("node", "id")
    named = rows.where("named").select("id", "n").join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    unnamed = rows.where("not named").select(F.lit(None).cast("long"), "n", F.lit(None).cast("long"))
    return named.union(unnamed).toDF(doc_id, "n_shingles", "component_id")
