"""The training-data operators against plain models on small fixtures."""

import hashlib
import heapq
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.llm import jaccard, mixing, packing, privacy, quality, queries, rules, sharding, spans, tokens, vectors
from folioscope.llm.common import components, table

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, size string"
WORDS = [f"w{k}" for k in range(400)]


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns that clash with those of operators."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, "x", "y") for i, t, s in rows], DDL)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "a"), (None, "two words", "b"), (5, long, "b"), (6, long, "b"), (7, "one", "a"), (7, "one", "a"), (8, "+" * 500 + "@" * 500 + "1." * 500, None)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def components_of(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = components_of({v for p in pairs for v in p}, pairs)
    linked = {v for p in pairs if p[0] != p[1] for v in p}
    assert got == {v: c for v, c in want.items() if v in linked}


# 1: vectors


def brute_vectors(rows, least):
    ok = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for k, (i, v, label) in enumerate(ok):
        for j, w, other in ok[:k]:
            if label == other and len(v) == len(w) and i != j and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                links[i].add(j), links[j].add(i)
    return links


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 60)
    monkeypatch.setattr(vectors, "TILE_ROWS", 50)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for k in range(600):
        v = base[k % 60] + rng.normal(size=16) * 0.05 * (k % 5)
        rows.append((k, [float(np.float32(x)) for x in v], k % 3 if k % 50 else None))
    rows += [(1000 + k, rows[7][1], rows[7][2]) for k in range(5)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0, None] + [0.0] * 14, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] * 16, 1), (2005, [], 1), (2006, [1.0, 2.0], 1), (None, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    links = brute_vectors(rows, 0.98)
    want = components_of([r[0] for r in rows if r[0] is not None], [(i, j) for i, js in links.items() for j in js])
    out = vectors.near_vectors(df, reach=0.2).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"]) == (0, None)
        else:
            assert (r["vec_id"], r["n_links"], r["component_id"]) == (r["vec_id"], len(links[r["vec_id"]]), want[r["vec_id"]])
            assert r["kept"] == (r["vec_id"] == r["component_id"])
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_default_reach_finds_every_pair(spark, monkeypatch):
    """Several lists over vectors with a decaying spectrum, pairs just above the limit."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    monkeypatch.setattr(vectors, "TILE_ROWS", 64)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 32)) / np.arange(1, 33)
    away = rng.normal(size=base.shape) / np.arange(1, 33)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9801, 0.985, (500, 1))
    pairs = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * away])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(pairs)]
    links = brute_vectors(rows, 0.98)
    out = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in out} == {k: len(links[k]) for k, _, _ in rows}
    assert {r["vec_id"]: r["component_id"] for r in out} == components_of(range(1000), [(i, j) for i, js in links.items() for j in js])


def test_vector_recall(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table(spark, SF, "embeddings").collect()]
    links = brute_vectors(rows, 0.98)
    out = queries.op1_near_vectors(spark, SF).collect()
    assert sum(r["n_links"] for r in out) >= 0.9 * sum(map(len, links.values()))
    assert all(r["n_links"] <= len(links[r["vec_id"]]) for r in out)


# 2: packing


def fewest(lengths, limit):
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= limit and bins[j] not in bins[:j]:
                bins[j] += lengths[k]
                place(k + 1, bins)
                bins[j] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_bin_completion_is_nearly_always_optimal():
    rng = np.random.default_rng(2)
    more = 0
    for _ in range(150):
        x = np.sort(rng.integers(1, 31, 10))[::-1]
        got = packing.pack(x, 30, width=60)
        assert Counter(v for f in got for v in f) == Counter(x.tolist()) and max(map(sum, got)) <= 30
        assert len(got) >= packing.waste_bound(np.bincount(x, minlength=31), 30)
        more += len(got) - fewest(x.tolist(), 30)
    assert more <= 2


def check_packed(out, given, limit):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary()["path"])
    want = Counter()
    for i, text in given:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            n = (len(ids) - start) % limit or limit
            want[i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start, piece = start + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    filled = defaultdict(list)
    for r in out:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(filled)


def test_packing_covers_every_token(spark, odd, none):
    rows = [(i, t, "a") for i, t in ((20, "a b <|endoftext|> c"), (21, "été \U0001f600 x" * 900), (22, "word " * 3000))]
    given = odd.union(docs(spark, rows))
    out = packing.pack_documents(given, 2048).collect()
    check_packed(out, [(r["doc_id"], r["text"]) for r in given.collect()], 2048)
    assert packing.pack_documents(none).count() == 0


def test_packing_of_documents(spark):
    given = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    out = queries.op2_pack(spark, SF).collect()
    used = check_packed(out, given, 2048)
    assert used <= 1.03 * sum(r["length"] for r in out) / 2048 + 1


def test_sequences_hold_the_ids(spark, odd, none):
    out = packing.pack_documents(odd, 64)
    rows, made = out.collect(), {r["sequence_id"]: r for r in packing.sequences(out).collect()}
    want = Counter(packing.token_ids(r["text"], **packing.vocabulary()).astype("<u4").tobytes() + bytes(4) for r in odd.collect())
    assert set(made) == {r["sequence_id"] for r in rows} and sum(r["n_tokens"] for r in made.values()) == sum(len(k) // 4 * n for k, n in want.items())
    for r in rows:
        whole = made[r["sequence_id"]]
        assert whole["n_tokens"] <= 64 and len(whole["ids"]) == 4 * whole["n_tokens"]
        assert bytes(whole["ids"][4 * r["offset"] :][: 4 * r["length"]]) == bytes(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and whole["doc_ids"][whole["starts"].index(r["offset"])] == r["doc_id"]
    short = [r for r in rows if r["piece"] == 0 and r["doc_id"] in (1, 2, 4)]
    assert all(bytes(r["ids"]) in want for r in short) and len(short) == 3
    assert packing.sequences(packing.pack_documents(none)).count() == 0


# 3: token counts


def test_token_counts(spark, odd, none):
    vocab = packing.vocabulary()
    given = odd.union(docs(spark, [(30, "a <|endoftext|> b", "a")]))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in tokens.document_tokens(given, vocab, 50256).collect())
    want = Counter((r["doc_id"], len(packing.token_ids(r["text"], **vocab, ordinary=True))) for r in given.collect())
    assert got == want
    assert tokens.document_tokens(none, vocab, 50256).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_separators_across_blocks(spark, tmp_path, width):
    rng = random.Random(width)
    want = []
    for k in range(6):
        ids = [rng.choice([9, 9, 1, 2, 3]) if k % 2 else rng.choice([9] + [1] * 40) for _ in range(rng.randrange(0, 400))]
        name = f"f{k}.bin"
        (tmp_path / name).write_bytes(np.array(ids, f"<u{width}").tobytes())
        run, ordinal = 0, 0
        for v in ids:
            if v == 9:
                want.append((name, ordinal, run, True))
                run, ordinal = 0, ordinal + 1
            else:
                run += 1
        if run:
            want.append((name, ordinal, run, False))
    blocks = tokens.flat_blocks(spark, str(tmp_path), width, block_tokens=7)
    for stretch in (1, 3, 1000):
        got = tokens.token_counts(blocks, 9, width, stretch).collect()
        assert sorted((r["file"].rpartition("/")[2], r["ordinal"], r["n_tokens"], r["ended"]) for r in got) == sorted(want)


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    ids = np.random.default_rng(3).integers(0, 50, 40_000).astype("<u2")
    (tmp_path / "a b.bin").write_bytes(ids.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = tokens.flat_blocks(spark, str(tmp_path), block_tokens=100)
    got = blocks.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in got}) > 2
    assert b"".join(bytes(r["ids"]) for r in sorted(got, key=lambda r: r["block"])) == ids.tobytes()
    ends = np.flatnonzero(ids == 7)
    counts = sorted((r["ordinal"], r["n_tokens"]) for r in tokens.token_counts(blocks, 7).where("ended").collect())
    assert counts == list(enumerate((np.diff(np.concatenate([[-1], ends])) - 1).tolist()))


def test_token_counts_of_documents(spark):
    vocab = packing.vocabulary()
    want = {r["doc_id"]: len(packing.token_ids(r["text"], **vocab, ordinary=True)) for r in table(spark, SF, "documents").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op3_token_counts(spark, SF).collect()} == want


# 4: personal data

PLAIN = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= sum(c.isdigit() for c in m) <= 19 and privacy.luhn(re.sub("[^0-9]", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
]


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))


def test_base_spans_match_the_patterns():
    rng = random.Random(8)
    parts = ["a@b.c", "@", ".", "..", "1", "255", "256", "007", "-", "+", " ", "(", ")", "x", "a.b", "4111 1111 1111 1111", "4111111111111111", "+1 (415) 555-0100", "é", "\n", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert privacy.base_spans(text) == plain_spans(text), text
    assert privacy.luhn("4111111111111111") and not privacy.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000 + "x", "1." * 200_000, "a@" * 100_000, "+" * 200_000):
        privacy.find(privacy.Field(np.zeros((privacy.FEATURES, 5)), np.zeros((5, 5)), np.zeros((5, 5))), text)


def exact_beliefs(node, edges):
    n, k = node.shape
    total = np.zeros((n, k))
    for code in range(k**n):
        y = [code // k**i % k for i in range(n)]
        p = np.exp(sum(node[i, y[i]] for i in range(n)) + sum(m[y[a], y[b]] for a, b, m in edges))
        for i in range(n):
            total[i, y[i]] += p
    return total / total.sum(1, keepdims=True)


def test_message_passing_is_exact_on_trees():
    rng = np.random.default_rng(4)
    field = privacy.Field(rng.normal(size=(privacy.FEATURES, 5)) * 0.3, rng.normal(size=(5, 5)), (lambda m: m + m.T)(rng.normal(size=(5, 5))))
    codes = rng.integers(0, 1 << 20, 5)
    chain, skip = np.array([[0, 1], [1, 2], [3, 4]]), np.array([[0, 3]])
    got = field.beliefs(codes, chain, skip, rounds=200)
    want = exact_beliefs(privacy.bits(codes) @ field.weight, [(a, b, field.chain) for a, b in chain] + [(a, b, field.skip) for a, b in skip])
    assert np.allclose(got, want, atol=1e-3)


def test_evidence_travels_over_any_number_of_mentions():
    weight = np.zeros((privacy.FEATURES, 5))
    weight[1] = [-3, 0, 0, 0, 6]
    weight[0] = [0.3, 0, 0, 0, 0]
    skip = np.full((5, 5), -1.0) + 4 * np.eye(5)
    field = privacy.Field(weight, np.zeros((5, 5)), skip)
    for n in (15, 60, 400):
        codes, chain, near = np.array([3] + [1] * (n - 1)), np.zeros((0, 2), int), np.array([[k, k + 1] for k in range(n - 1)])
        # exact on a chain, by passing sums forth and back
        node, pair = np.exp(privacy.bits(codes) @ weight), np.exp(skip)
        forth, back = np.ones((n, 5)), np.ones((n, 5))
        for k in range(1, n):
            forth[k] = (forth[k - 1] * node[k - 1]) @ pair
            forth[k] /= forth[k].sum()
        for k in range(n - 2, -1, -1):
            back[k] = pair @ (back[k + 1] * node[k + 1])
            back[k] /= back[k].sum()
        want = forth * node * back
        want /= want.sum(1, keepdims=True)
        assert np.allclose(field.beliefs(codes, chain, near), want, atol=1e-6)
        assert np.allclose(field.beliefs(codes, chain, near, rounds=1), want, atol=1e-6)


def plain_beliefs(field, codes, chain, skip, rounds):
    """Loopy sum-product, message by message in the order of the operator."""
    node = privacy.bits(codes) @ field.weight
    into = {}
    for number in range(rounds):
        for way, (edges, pair) in enumerate(((chain, field.chain), (skip, field.skip))):
            old = dict(into)
            for forth in (True, False):
                for a, b in edges if forth else edges[::-1]:
                    a, b, m = (a, b, pair) if forth else (b, a, pair.T)
                    x = node[a] + sum((v for (_, c, to), v in into.items() if to == a and (c, _) != (way, b)), np.zeros(5))
                    v = np.log(np.exp(x[:, None] + m - x.max()).sum(0))
                    into[a, way, b] = v - v.max()
            if number >= 10:
                for key in into:
                    if key[1] == way:
                        into[key] = (into[key] + old.get(key, 0)) / 2
    total = node.copy()
    for (_, _, to), v in into.items():
        total[to] += v
    return privacy.softmax(total)


def test_loopy_messages_match_a_plain_loop():
    rng = np.random.default_rng(9)
    field = privacy.Field(rng.normal(size=(privacy.FEATURES, 5)) * 0.3, rng.normal(size=(5, 5)) * 0.5, (lambda m: m + m.T)(rng.normal(size=(5, 5)) * 0.5))
    for n in (2, 7, 30):
        codes = rng.integers(0, 1 << 20, n)
        chain = np.array([(k, k + 1) for k in range(n - 1) if rng.random() < 0.8] or [(0, 1)])
        last, skip = {}, []
        for k, key in enumerate(rng.integers(0, max(2, n // 3), n).tolist()):
            if key in last:
                skip.append((last[key], k))
            last[key] = k
        skip = np.array(skip, np.int64).reshape(-1, 2)
        got = field.beliefs(codes, chain, skip, rounds=200)
        assert np.allclose(got, plain_beliefs(field, codes, chain.tolist(), skip.tolist(), 40), atol=1e-3)
        # documents worked on together don't touch each other
        two = field.beliefs(np.tile(codes, 2), np.concatenate([chain, chain + n]), np.concatenate([skip, skip + n]), np.repeat([0, 1], n), rounds=200)
        assert np.allclose(two[:n], got, atol=1e-9) and np.allclose(two[n:], got, atol=1e-9)


@pytest.fixture(scope="module")
def marked(spark):
    """A field trained on marked numbers, cards, mails and addresses among orders, years and amounts."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        number, order = f"+49{rng.randrange(10**8, 10**9)}", rng.randrange(10**10, 10**11)
        card = next(c for c in iter(lambda: f"4{rng.randrange(10**14, 10**15)}", None) if privacy.luhn(c))
        card = " ".join(card[j : j + 4] for j in range(0, 16, 4))
        text = f"call {number} or {number} today, room {rng.randrange(100)}, order {order} of {rng.randrange(1990, 2030)}, mail {'jo.' * (k % 2)}u{k}@site{k % 7}.org from {'.'.join(str(rng.randrange(256)) for _ in range(4))}, pay {card} or {card}"
        rows.append((k, text, "a"))
    return privacy.train(docs(spark, rows))


TWINS = [
    ("call +49 301 2345678 today. Later 0301 2345678 was busy", "0301 2345678", 3),
    ("call +49301234567 or +49301234567 today and 49301234567 then", " 49301234567", 3),
    ("pay by 4111 1111 1111 1111, noted as 4111_1111_1111_1111 there", "4111_1111_1111_1111", 2),
    ("mail jo.doe77@example.org or jo.doe77@intranet here", "jo.doe77@intranet", 0),
    ("host 192.168.10.44 is 192-168-10-44 inside", "192-168-10-44", 1),
]


def test_bare_twins_are_found_by_skip_edges_alone(marked):
    """A number written without its mark is found where the document marks it elsewhere,
    and neither without skip edges nor without the marked mention."""
    cut = privacy.Field(marked.weight, marked.chain, np.zeros((5, 5)))
    for text, twin, kind in TWINS:
        twin = twin.strip()
        at = text.rindex(twin)
        base, more = privacy.find(marked, text)
        assert base and more == [(at, kind, at + len(twin))], text
        assert privacy.find(cut, text) == (base, []), text
        assert privacy.find(marked, f"only {twin} there") == ([], []), text


def test_other_numbers_stay(marked):
    text = "In 2021 order 20210044871 of 1,250.00 was sent, 12 boxes of 4.5 kg; call +49301234567. Order 20210044871 came in 2021"
    base, more = privacy.find(marked, text)
    assert len(base) == 1 and not more


def test_many_numbers_are_read_in_linear_time(marked):
    rng = random.Random(5)
    for most in (100, 10**4, 10**9):
        text = " ".join(str(rng.randrange(most)) for _ in range(20_000))
        begin = time.perf_counter()
        privacy.find(marked, text + " +49301234567")
        assert time.perf_counter() - begin < 4


def test_groups_of_digits_are_one_variable():
    def words(text):
        return [text[f[2] : f[3]] for f in privacy.tokens(text)]

    assert words("pay 4111 1111 1111 1111, now") == ["4111 1111 1111 1111"]
    assert words("+49 (30) 123-4567 or 030 1234567.") == ["+49 (30) 123-4567", "030 1234567"]
    assert words("12 of 14, 15 16") == ["12", "14", "15", "16"]
    assert words("1234 5678 1234 5678 1234 5678") == ["1234", "5678", "1234", "5678", "1234", "5678"]
    assert words("1234567\n1234567") == ["1234567", "1234567"]


def check_personal(out, given):
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(given)
    for i, text in given:
        r = got[i][0]
        base = plain_spans(text or "")
        want = ",".join(f"{privacy.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in privacy.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_personal_data(spark, odd, none):
    field = privacy.train(odd)
    out = privacy.personal_data(odd, field).collect()
    check_personal([r for r in out if r["doc_id"] != 7], [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 7])
    assert privacy.personal_data(none, privacy.train(none)).count() == 0
    check_personal(queries.op4_pii(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()])
    text = odd.select(privacy.masked(field, F.col("text")).alias("t")).collect()
    assert len(text) == odd.count()
    one = docs(spark, [(1, "mail a.b@c.de or 10.0.0.1!", "a")]).select(privacy.masked(field, F.col("text")).alias("t")).first()["t"]
    assert one == "mail <EMAIL> or <IP>!"


# 5: n-gram Jaccard join


def plain_sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[j:] for j in range(k)]))


def brute_jaccard(rows, k, percent):
    sets = [(i, plain_sets(t, k)) for i, t in rows if i is not None]
    pairs = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return components_of({i for i, _ in sets}, pairs), [(i, len(plain_sets(t, k))) for i, t in rows]


def near_rows(seed, groups=12):
    """Copies, near copies at all distances, a hot near group, shared passages, short texts."""
    rng = random.Random(seed)
    passage, rows = prose(rng, 60).split(), []
    for g in range(groups):
        base = prose(rng, rng.choice([3, 5, 12, 60, 150, 300])).split()
        for _ in range(rng.choice([1, 2, 4, 60 if g == 0 else 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1, 1])] = [rng.choice(WORDS)]
            if rng.random() < 0.3:
                copy += passage
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rng.shuffle(rows)
    return [(3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("seed,k,percent,task", [(1, 4, 85, 4_000_000), (2, 5, 80, 500), (3, 4, 85, 100)])
def test_jaccard_matches_brute_force(spark, monkeypatch, seed, k, percent, task):
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", task)
    rows = near_rows(seed)
    want, sizes = brute_jaccard(rows, k, percent)
    out = jaccard.jaccard_components(docs(spark, [(*r, "a") for r in rows]), k=k, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out} == dict(sizes)
    assert len(set(want.values())) < len(want)


def test_divide_skip_connects_all_links():
    for seed in range(20):
        sets = [jaccard.shingles(t, 4) for _, t in near_rows(seed, 6)]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
        ids = range(len(sets))
        sizes = np.array(list(map(len, sets)))
        for got in (jaccard.divide_skip(sets, sizes, 85, jaccard.Parts(len(sets)), mu=0.01), jaccard.divide_skip(sets, sizes, 85, jaccard.Parts(len(sets)), mu=1.0), jaccard.search_group(sets, 85, [])):
            assert components_of(ids, got) == components_of(ids, pairs)
            assert {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in pairs}


def test_jaccard_edge_cases(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want, _ = brute_jaccard(rows, 4, 85)
    out = jaccard.jaccard_components(odd, k=4, percent=85).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == want | {None: None}
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want, sizes = brute_jaccard(rows, 4, 85)
    out = queries.op5_jaccard(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == {i: (n, want[i]) for i, n in sizes}


# 6: mixing


def check_mix(out, given):
    sizes = defaultdict(int)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s in given:
        sizes[s] += n(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    low, high = Fraction(0), Fraction(10**9)
    goal = Fraction(3, 2) * sum(sizes.values())
    for _ in range(200):  # the level at which all targets sum up to the goal
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < goal else (low, mid)
    taken, most = defaultdict(int), defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, n(t)) for i, t, _ in given)
    source = {i: s for i, _, s in given}
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(float(min(2 * sizes[s], high * weight[s])), rel=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in names:
        assert abs(taken[s] - float(min(2 * sizes[s], high * weight[s]))) <= most[s] / 2 + len(out) * 1e-6 + 1, s


def test_mixing(spark, odd, none):
    rng = random.Random(9)
    given = [(k, prose(rng, rng.randrange(0, 80)), rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"])) for k in range(700)]
    df = docs(spark, given)
    out = mixing.mix(df).collect()
    check_mix(out, given)
    again = mixing.mix(df.repartition(3)).collect()
    assert {r["doc_id"]: r["taken"] for r in out} == {r["doc_id"]: r["taken"] for r in again}
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd).count() == odd.count()
    # one repeated row as a whole source: its rows share what is taken
    same = docs(spark, [(1, "a b c d", "a")] * 50 + [(k, "x y", "b") for k in range(2, 400)])
    check_mix(mixing.mix(same).collect(), [(1, "a b c d", "a")] * 50 + [(k, "x y", "b") for k in range(2, 400)])


def test_mixing_of_documents(spark):
    given = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, SF, "documents").collect()]
    check_mix(queries.op6_mix(spark, SF).collect(), given)


# 7: spans


def brute_spans(rows):
    """Texts after removing what non-first spans cover, by dictionary of span words."""
    first, gone = {}, defaultdict(set)
    cut = {i: spans.sentences(t) for i, t in rows}
    for i, _ in sorted(rows):
        words = [w.split() for _, _, w in cut[i]]
        for a in range(len(words)):
            for b in range(a + spans.SENTENCES, len(words) + 1):
                if sum(map(len, words[a:b])) >= spans.WORDS:
                    key = tuple(w for _, _, w in cut[i][a:b])
                    if first.setdefault(key, (i, a)) != (i, a):
                        gone[i].update(range(a, b))
                    break
    return {i: (len(cut[i]), len(gone[i]), sum(cut[i][k][1] - cut[i][k][0] for k in gone[i])) for i, _ in rows}


def test_spans_match_brute_force(spark, odd, none):
    rng = random.Random(11)
    sentence = lambda: prose(rng, rng.randrange(1, 9)).capitalize() + rng.choice([". ", "! ", ", ", ".\n"])
    shared = ["".join(sentence() for _ in range(12)) for _ in range(5)]
    rows = []
    for k in range(300):
        body = "".join(sentence() for _ in range(rng.randrange(0, 15)))
        if rng.random() < 0.5:
            body += "und " + rng.choice(shared)[rng.randrange(0, 9) :] + sentence()
        rows.append((k, body + body[: rng.choice([0, 0, 200])]))
    rows += [(k, shared[0] * 3) for k in range(300, 320)]
    out = spans.drop_repeats(docs(spark, [(*r, "a") for r in rows])).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["removed_chars"]) for r in out} == brute_spans(rows)
    text = dict(rows)
    assert all(len(text[r["doc_id"]]) - len(r["text"]) == r["removed_chars"] for r in out)
    assert spans.drop_repeats(none).count() == 0
    assert spans.drop_repeats(odd).count() == odd.count()


def test_passages_pasted_inside_clauses(spark):
    """Every repeated run of over 50 words loses its middle, with or without marks."""
    rng = random.Random(21)
    rows = []
    for k in range(120):
        body, n = prose(rng, 500).split(), rng.randrange(51, 79)
        if k % 3:
            body = [w + rng.choice(["", "", "", "", "", "", "", "", "", ",", "."]) if k % 3 == 1 else w for w in body]
        at = rng.randrange(100, 300)
        rows += [(2 * k, " ".join(body)), (2 * k + 1, f"{prose(rng, 90)} {' '.join(body[at : at + n])} {prose(rng, 90)}")]
    out = {r["doc_id"]: r for r in spans.drop_repeats(docs(spark, [(*r, "a") for r in rows])).collect()}
    for k in range(120):
        assert out[2 * k]["text"] == rows[2 * k][1]
        gone = len(rows[2 * k + 1][1].split()) - len(out[2 * k + 1]["text"].split())
        assert spans.WORDS <= gone <= len(rows[2 * k + 1][1].split()) - 180
    assert all(len(w.split()) <= spans.CUT for _, t in rows for _, _, w in spans.sentences(t))
    assert all(b"".join(w.split()) == b"".join(t.encode().split()) for _, t in rows for w in [b" ".join(x for _, _, x in spans.sentences(t))])


def test_spans_of_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    out = queries.op7_span_dedup(spark, SF).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["removed_chars"]) for r in out} == brute_spans(rows)


# 8: quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op8_quality(spark, sf).collect()}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in table(spark, sf, "labels").collect() if out[r["doc_id"]]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) / len(held) > 0.95


def test_trees_fit_and_flatten():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.boost(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # the flat traversal equals a walk row by row
    for row in x[:20]:
        total = forest.prior
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert forest.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))
    assert quality.boost(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (7, 3, 1)], "doc_id long, quality int, toxic int")
    forest = quality.train(odd, labels)
    got = odd.select(quality.scored(forest, F.col("text")).alias("s")).collect()
    assert len(got) == odd.count() and all(0 <= r["s"] <= 1 for r in got)
    assert quality.train(none, labels.limit(0)).score(np.zeros((1, len(quality.STATISTICS)))).tolist() == [0.5]


# 9 and 10: rules, shards


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_hosts_decide_beside_the_base_rules(spark):
    """Failures of the other rules count too: excused on hosts where they are rare, fatal
    on ordinary ones, and a host that mostly fails them loses its clean documents."""
    rng = random.Random(5)
    noisy = lambda: " ".join("#*$" + w for w in prose(rng, 60).split())
    rows, clean, k = [], {}, 0
    for host, share, n in [("trusted", 0.005, 400), *[(f"h{j}", 0.16 + 0.02 * j, 60) for j in range(12)], ("junk", 0.9, 200)]:
        for j in range(n):
            bad = j < share * n
            rows.append((k, noisy() if bad else prose(rng, 80), host))
            clean[k], k = not bad, k + 1
    out = {r["doc_id"]: r for r in rules.host_rules(docs(spark, rows)).collect()}
    for i, _, host in rows:
        assert not out[i]["base_failed"] and out[i]["host_kept"] == (host != "junk")
        assert out[i]["kept"] == (host == "trusted" or (host != "junk" and clean[i])), (i, host)


def test_rules_match_a_plain_count(spark, odd, none):
    rng = random.Random(12)
    rows = [(k, rng.choice([" ", "", "\n\n"]).join([prose(rng, rng.randrange(0, 120)), rng.choice(["a b c ", "x | $ y\n", "été\n", ""]) * rng.randrange(0, 30)]), rng.choice("ab") if k % 9 else None) for k in range(200)]
    rows += [(900 + k, "too short", "bad.example") for k in range(60)] + [(999, prose(rng, 200), "bad.example")]
    df = docs(spark, rows).union(odd)
    given = Counter((r["doc_id"], *plain_counts(r["text"])) for r in df.collect())
    out = rules.host_rules(df).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == given
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    by = {r["doc_id"]: r for r in out}
    assert not by[999]["base_failed"] and not by[999]["kept"]  # its host fails as a whole
    assert any(r["kept"] for r in out)
    assert rules.host_rules(none).count() == 0


def check_shards(out, limit):
    held = defaultdict(int)
    for r in out:
        held[r["depth"], r["prefix"], r["page"]] += r["bytes"]
    single = Counter((r["depth"], r["prefix"], r["page"]) for r in out)
    for r in out:
        at = r["depth"], r["prefix"], r["page"]
        assert held[at] == r["shard_bytes"] and (held[at] <= limit or single[at] == 1)
    # no shard split without need: two halves of one prefix don't fit together
    leaf = defaultdict(int)
    for (d, p, _), n in held.items():
        leaf[d, p] += n
    for (d, p), n in leaf.items():
        if d and (d, p ^ 1) in leaf:
            assert n + leaf[d, p ^ 1] > limit
    ends = sorted(leaf)
    assert all(not (e > d and q >> (e - d) == p) for d, p in ends for e, q in ends)


@pytest.mark.parametrize("limit", [50, 2_000, 10**6])
def test_shards(spark, odd, none, limit):
    rng = random.Random(13)
    rows = [(k, prose(rng, rng.randrange(0, 40)), "a") for k in range(300)] + [(7000, "same row " * rng.randrange(1, 5), "a") for _ in range(150)]
    df = docs(spark, rows).union(odd)
    out = sharding.shards(df, limit).collect()
    assert Counter((r["doc_id"], r["bytes"]) for r in out) == Counter((r["doc_id"], len((r["text"] or "").encode())) for r in df.collect())
    check_shards(out, limit)
    assert sharding.shards(none, limit).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.SQL[name]).df()
    assert sorted(want.columns) == sorted(df.columns)
    by = sorted(df.columns)
    pd.testing.assert_frame_equal(df[by].sort_values(by, ignore_index=True), want[by].sort_values(by, ignore_index=True), check_dtype=False)


def test_pipeline(spark):
    import corpus_pipeline as p

    before = table(spark, SF, "documents")
    seen, made = {}, before
    for name, stage in p.STAGES[:-1]:
        made = stage(spark, made, SF).cache()
        assert made.columns == before.columns
        seen[name] = {r["doc_id"]: r["text"] for r in made.collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    kept = seen["quality"]
    assert len(bad & set(kept)) <= 0.3 * len(bad) and len(good - set(kept)) <= 0.02 * len(good)
    want, _ = brute_jaccard(sorted(kept.items()), 5, 80)
    assert set(seen["near_duplicates"]) == set(want.values())
    assert all(not plain_spans(t) for t in seen["privacy"].values())
    assert all(t == texts[i] for i, t in seen["near_duplicates"].items())
    packed = p.pack_sequences(spark, made, SF)
    total = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert total == Counter(r["doc_id"] for r in made.collect()) and max(total.values()) <= 2


def test_pipeline_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline as p

    for given in (odd, none):
        made = given
        for _, stage in p.STAGES[:-1]:
            made = stage(spark, made, SF).cache()
            assert made.dtypes == given.dtypes
        assert p.pack_sequences(spark, made, SF).where("piece = 0").count() == made.count()
    near = p.one_of_group(spark, odd, SF).collect()
    # one of the long copies, one of the equal words; texts without words and unnamed rows stay
    assert Counter(r["doc_id"] for r in near) == Counter([1, 2, 3, 4, None, 5, 8])
    assert all((r["score"], r["id"], r["size"]) == (0.5, "x", "y") for r in near)
    mixed = p.mix_sources(spark, odd, SF).collect()
    assert all((r["score"], r["id"], r["size"]) == (0.5, "x", "y") for r in mixed) and len(mixed) > 5


def test_heap_merge_equals_stable_sort():
    runs = [np.sort(np.random.default_rng(k).integers(0, 99, 20)) for k in range(6)]
    assert np.sort(np.concatenate(runs), kind="stable").tolist() == list(heapq.merge(*map(list, runs)))


def test_one_of_repeated_rows_with_a_map(spark):
    import corpus_pipeline

    rows = docs(spark, [(1, "one two three", "a"), (1, "one two three", "a"), (2, "four", "a")])
    rows = rows.withColumn("extra", F.create_map(F.lit("k"), "source"))
    out = corpus_pipeline.one_of_group(spark, rows, SF)
    assert out.columns == rows.columns
    assert sorted((r["doc_id"], r["extra"]["k"]) for r in out.collect()) == [(1, "a"), (2, "a")]
