"""Exact dedup, hard negatives and spelling variants against plain models."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import dedup, negatives, queries, spelling
from folioscope.llm.common import table

SF = "/root/testdata/sf0.001"
LOW = {k: k + 32 for k in range(65, 91)}


def same_as_sql(spark, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = queries.QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = Counter(tuple(r[c] for c in columns) for r in out.collect())
    result = con.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert got == want and got


# 11: exact dedup


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in rows], "doc_id long, text string, digest string, row int, keep_id binary")


def check_kept(out, rows):
    want, groups = defaultdict(list), defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    assert Counter((r["doc_id"], r["text_sha256"]) for r in out) == Counter((i, h) for h, ids in groups.items() for i in ids)
    for r in out:
        ids = groups[r["text_sha256"]]
        most = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (most, len(ids))
        assert not r["kept"] or r["doc_id"] == most
        want[r["text_sha256"]].append(r["kept"])
    assert all(sum(k) == 1 for k in want.values())


@pytest.mark.parametrize("batches", [1, 3])
def test_exact_duplicates(spark, batches):
    rng = random.Random(4)
    long = "long Text " * 200_000
    rows = [(1, None), (2, ""), (3, " "), (None, "a"), (None, "A"), (4, "a"), (None, "only null ids"), (None, "Only null ids"), (5, long), (6, long.upper()), (7, "É"), (8, "é"), (9, "rep"), (9, "rep"), (9, "REP"), (-3, "rep")]
    rows += [(100 + k, rng.choice(["hot", "HOT", "Hot", f"t{k % 40}"])) for k in range(300)]
    check_kept(dedup.exact_duplicates(texts(spark, rows), batches=batches).collect(), rows)


def test_exact_duplicates_of_odd_tables(spark):
    assert dedup.exact_duplicates(texts(spark, [])).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x")], "key string, body string")
    out = dedup.exact_duplicates(named, "key", "body").collect()
    assert {(r["key"], r["keep_id"], r["kept"]) for r in out} == {("b", "b", True), ("a", "b", False), (None, "b", False)}


def test_exact_duplicates_match_sql(spark):
    same_as_sql(spark, "op11_exact_dedup", ["documents"])


def test_index_outlives_its_session_and_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    index = dedup.DigestIndex.open(spark, path, buckets=4)
    first, second = texts(spark, [(1, "a"), (2, "A"), (3, "b")]), texts(spark, [(9, "a"), (4, "c"), (8, "C")])
    rows = dedup.digest_rows(first)
    dedup.add_batch(index, rows, 0)
    # another session finds it by its path; adding a batch again changes nothing
    again = dedup.DigestIndex.open(spark, path, buckets=4)
    later = dedup.digest_rows(second)
    for _ in range(2):
        sizes = dedup.add_batch(again, later, 1)
        out = dedup.decisions(again, later, [sizes], since=1).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(9, 2, 1, False), (4, 8, 2, False), (8, 8, 2, True)}
    assert sorted(r["keep_id"] for r in spark.table(again.table).collect()) == [2, 3, 8]
    whole = again.compacted(str(tmp_path / "compacted"))
    assert sorted(r["keep_id"] for r in spark.table(whole.table).collect()) == [2, 3, 8]
    assert len(list((tmp_path / "compacted").rglob("*.parquet"))) <= 4


def test_index_is_not_shuffled_again(spark):
    index = dedup.DigestIndex.open(spark, f"{dedup.shared_folder(spark)}/index", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = dedup.digest_rows(texts(spark, [(k, f"t{k}") for k in range(50)]))
    dedup.add_batch(index, rows, 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rows.select("digest").join(index.before(1).select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


# 12: hard negatives


def brute_negatives(rows, anchor, n_positive=5, n_negative=3):
    ok = [(i, label, [int(np.floor(256.0 * x)) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, label, v in ok:
        if not anchor(i):
            continue
        scored = sorted((-max(min(sum(p * q for p, q in zip(v, w)), 2**63 - 1), 1 - 2**63), j, other) for j, other, w in ok if j != i and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2] == label][:n_positive]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, k + 1, m, -p, -n) for k, (n, m, _) in enumerate(fits[:n_negative])]
    return Counter(out)


def mined(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, number int, dim string")
    out = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0)
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in out.collect())


@pytest.mark.parametrize("shape", ["clustered", "lengths"])
def test_hard_negatives_match_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(negatives, "BUCKET_ROWS", 60)
    monkeypatch.setattr(negatives, "TASK_BUCKETS", 4)
    monkeypatch.setattr(negatives, "TASK_ANCHORS", 5)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8))
    rows = []
    for k in range(700):
        v = base[k % 12] + rng.normal(size=8) * 0.2 if shape == "clustered" else rng.normal(size=8) * rng.lognormal(0, 1.5)
        rows.append((k, v.tolist(), int(k * 7 % 5) if k % 90 else None))
    rows += [(1000 + k, rows[7][1], 3) for k in range(90)] + [(50, rows[3][1], 2), (50, rows[3][1], 2), (61, rows[3][1], 1), (61, rows[3][1], 1)]
    rows += [(1100, None, 1), (1150, [0.0] * 8, 1), (1200, [1.0, None] + [0.0] * 6, 1), (1250, [float("nan")] * 8, 1), (1300, [float("-inf")] * 8, 1), (1350, [], 1), (1351, [], 1), (1352, [], 2), (1400, [1.0, 2.0], 1), (1401, [1.0, 2.1], 1), (1402, [1.0, 1.5], 2), (None, rows[7][1], 1)]
    assert mined(spark, rows) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_huge_components_stay_exact(spark):
    rows = [(50, [2.0**22, 3.0], 1), (1, [2.0**22 + 1, 5.0], 1), (2, [2.0**21 + 1, 7.0], 2), (3, [2.0**21 + 3, 7.0], 2), (4, [1e300, 1.0], 1), (5, [2.0**22 - 2.0**18, 1e10], 3)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows, lambda i: i % 50 == 0) and got


def test_no_rows_no_negatives(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(50, [1.0], 1)]) == Counter()


def test_hard_negatives_match_sql(spark):
    same_as_sql(spark, "op12_hard_negatives", ["embeddings"])


def test_feasible_ranges_prune_and_lose_nothing():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    v = np.floor(256 * (base[np.arange(2000) % 40] + rng.normal(size=(2000, 8)) * 0.02))
    q = v[:40]
    frame = negatives.pd.DataFrame({"id": np.arange(2000), "number": np.arange(2000), "label": 0})
    bucket = negatives.Bucket.of(frame, v)
    score = (q @ v.T).astype(np.int64)
    least = np.sort(score, axis=1)[:, -20]
    anchors = negatives.Anchors(np.arange(40), np.arange(40), np.zeros(40), q, least)
    low, high, some = negatives.feasible(anchors, bucket)
    width = (high - low).min(1)
    assert some.all() and np.median(width) < 400  # the narrowest list is a fifth of the bucket at most
    got = {(a, b, s) for x, y, z in negatives.reached(anchors, bucket) for a, b, s in zip(x.tolist(), y.tolist(), z.tolist())}
    assert got == {(a, b, int(score[a, b])) for a, b in zip(*np.nonzero(score >= least[:, None]))}
    anchors.least = (anchors.length * bucket.longest * 1.01).astype(np.int64)
    assert not negatives.feasible(anchors, bucket)[2].any()  # no row is long enough


# 13: spelling


def brute_variants(n, ratio=2):
    by_hole = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_hole[w[:k], w[k + 1 :]].add(w)  # one code point replaced
    near = defaultdict(set)
    for same in by_hole.values():
        for w in same:
            near[w] |= same - {w}
    for w in n:
        for k in range(len(w)):
            short = w[:k] + w[k + 1 :]
            if short in n:
                near[w].add(short), near[short].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def asked_words(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] += 1
    return n


def test_variants_match_brute_force(spark):
    rng = random.Random(2)
    n = Counter()
    for _ in range(60):
        word = "".join(rng.choice("abeoéß÷") for _ in range(rng.randrange(1, 9)))
        for _ in range(12):
            at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
            n[word[:at] + (rng.choice("abzł\U0001f600") if kind else "") + word[at + (kind < 2) :]] += rng.randrange(1, 400)
    n.pop("", None)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    for symbols in (2, 6):
        got = {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words, symbols=symbols).collect()}
        assert got == brute_variants(n)
    assert spelling.variants(words.limit(0)).count() == 0


def test_long_chains_of_forms_end_at_their_root(spark):
    words = spark.createDataFrame([("x" * (5 + k), 2**k) for k in range(40)] + [(None, 3), ("", 4)], "word string, n long")
    out = {r["word"]: r for r in spelling.variants(words).collect()}
    assert all(out["x" * (5 + k)]["root"] == "x" * 44 for k in range(40))
    assert (out[""]["n_near"], out[""]["root"], out[None]["n_near"], out[None]["root"]) == (0, "", 0, None)


def test_spelling_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    n = {w: k for w, k in asked_words(rows).items() if len(w) >= 5 and k >= 3}
    got = {tuple(r) for r in queries.op13_spelling(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_variants(n)


def test_word_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Ab÷É é_AB 1"), (None, "ab ab"), (4, "q" * 3_000_000)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, word string, run int")
    assert {r["word"]: r["n"] for r in spelling.word_counts(df).collect()} == {"ab": 3, "ab÷É": 1, "é": 1, "q" * 3_000_000: 1}
