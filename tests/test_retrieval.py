import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.operators import lexical, vectors
from folioscope.operators.confidence import retrieval_confidence
from folioscope.operators.fusion import fuse_hops
from folioscope.operators.prune import elbow, token_pack
from folioscope.operators.query_features import analyze_structure, with_features
from folioscope.operators.rerank import rerank
from folioscope.operators.vectors import knn, vector_topk
from folioscope.operators.verify import verification_report, with_gate
from folioscope.plans.retrieve import retrieve
from folioscope.session import checkpointed

CHUNK_DDL = "chunk_id string, document_name string, page_number int, section_title string, modality string, content string, media_path string, caption string, source_reliability string"


def chunk(i, name, content, modality="text", caption=None, media=None, section="Main", reliability="wiki"):
    return (f"c{i:03d}", name, 1, section, modality, content, media, caption, reliability)


CHUNKS = [
    chunk(1, "stonewatch.md", "Stonewatch garrison is 3,107 soldiers under arms."),
    chunk(2, "oak_haven.md", "Oakhaven has a wooden wall. The last-warden lives in Oakhaven."),
    chunk(3, "misc.txt", "Prestonewatchers sing; the last warden weeps. Grey choirs hum."),
    chunk(4, "plate.png", "Plate of the valve", "image-caption", "Figure: sky-fortress valve", "m/plate.png"),
    chunk(5, "readme.txt", "Stonewatch Stonewatch garrison"),
    chunk(6, "ledger.pdf", "| Fort | Cost |\n|---|---|\n| Stonewatch | 450 |", "table", "Data table of costs"),
    chunk(7, "odd.txt", "what ??! is this about; été au château, grey-choir"),
    chunk(8, "grey choir.txt", "Nothing here", section="Silent Grey Choir"),
    chunk(9, "year.txt", "It was founded in the year 280 with maximum range of fire."),
]
QUESTIONS = [
    "What is the garrison of Stonewatch?", "Compare Stonewatch and Oakhaven", "who is the last-warden", "Tell about the Grey Choir", 'find "??!" now',
    "Show me the sky-fortress valve diagram", "what was founded and when", "compare x and of y?", "total cost of 'Silent Grey Choir'", "Ston and effective range", "été château",
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, CHUNK_DDL)


def word_in(word, text):
    return re.search(r"\b" + re.escape(word) + r"\b", text) is not None


def model_scores(question, entities, fields, target, boost):
    """Brute force over every pair: {chunk_id: (similarity, relevance)}."""
    general = [w for w in re.findall(r"\b[a-zA-Z0-9_\-]{3,}\b", question.lower()) if w not in L.LEXICAL_STOP]
    out = {}
    for cid, name, _, section, modality, content, media, caption, _ in CHUNKS:
        name, section, content, caption = name.lower(), section.lower(), content.lower(), (caption or "").lower()
        whole = " ".join([name, caption, section, content])
        if name.startswith("readme"):
            continue
        points, matched = 0.0, 0
        for e in (x.lower() for x in entities):
            toks = [t for t in re.findall(r"\b[a-zA-Z0-9_\-]{3,}\b", e) if t not in L.LEXICAL_STOP]
            hits = sum(word_in(t, whole) for t in toks)
            full = bool(toks) and hits == len(toks)
            matched += e in whole or full
            points += 8.0 if e in whole else 5.0 if full else 1.5 * hits
        points += 3.0 * sum(any(word_in(a, whole) for a in L.FIELD_ALIASES[f]) for f in fields)
        areas = [(name, 2.0), (caption, 2.0), (section, 1.5), (content, 1.0)]
        points += sum(weight for w in general for area, weight in areas if word_in(w, area))
        if points == 0:
            continue
        if entities and not matched and general:
            points *= 0.15
        sim = min(1.0, points / max(8.0 * len(entities) + 3.0 * len(fields) + 2.0 * len(general), 1.0))
        factor = boost if modality == target else 1.3 if target == "image-caption" and media else 1.0
        out[cid] = (sim, sim * factor)
    return out


@pytest.mark.parametrize("term_bytes", [lexical.TERM_BYTES, 4 << 20])
def test_lexical_matches_brute_force(spark, chunks, term_bytes, monkeypatch):
    monkeypatch.setattr(lexical, "TERM_BYTES", term_bytes)  # the larger value forces several blocks
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    f = checkpointed(with_features(q)).withColumn("step", F.lit(1)).withColumn("k", F.lit(16))
    features = {r.query_id: r for r in f.collect()}
    got = {}
    for r in lexical.lexical_topk(f, chunks, 16).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = (r.raw_similarity, r.relevance_score, r["rank"])
    for i, question in enumerate(QUESTIONS):
        x = features[i]
        want = model_scores(question, x.entities, x.fields, x.target.target_modality, x.target.boost_weight)
        assert set(got.get(i, {})) == set(want), (question, x.entities, got.get(i), want)
        for cid, (sim, rel) in want.items():
            assert got[i][cid][:2] == pytest.approx((sim, rel), abs=6e-5), (question, cid)
        ranks = sorted(got.get(i, {}).items(), key=lambda kv: kv[1][2])
        assert [v[2] for _, v in ranks] == list(range(1, len(ranks) + 1))
        assert [v[1] for _, v in ranks] == sorted((v[1] for _, v in ranks), reverse=True)


def test_knn_scan_and_grid_match_numpy(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(f"i{n:03d}", [float(x) for x in rng.normal(size=8)]) for n in range(60)] + [("zero", [0.0] * 8), ("i000b", None)]
    items[-1] = ("i000b", items[0][1])  # an exact tie
    asked = [(n, [float(x) for x in rng.normal(size=8)]) for n in range(7)]
    q = spark.createDataFrame(asked, "qid int, vector array<double>")
    i = spark.createDataFrame(items, "item_id string, embedding array<float>").repartition(5)
    m = np.array([np.float32(v) for _, v in items], dtype=np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    for limit, cells in ((64 << 20, 1 << 22), (200, 1 << 22), (64 << 20, 70)):
        monkeypatch.setattr(vectors, "TILE_CELLS", cells)
        got = {}
        for r in knn(q, i, 6, limit).collect():
            got.setdefault(r.qid, []).append((-r.similarity, r.item_id))
        for n, v in asked:
            sims = np.round(m @ (np.array(v) / np.linalg.norm(v)), 12)
            want = sorted(((-s, items[j][0]) for j, s in enumerate(sims)))[:6]
            assert [x for _, x in sorted(got[n])] == [x for _, x in want]


def test_vector_topk_boosts_modality(spark):
    index = spark.createDataFrame(
        [("a", "a.txt", "text", None, [1.0, 0.0]), ("b", "b.png", "image-caption", "m/b.png", [0.8, 0.6]), ("r", "README.md", "text", None, [1.0, 0.0])],
        "chunk_id string, document_name string, modality string, media_path string, embedding array<double>",
    )
    q = spark.createDataFrame([(1, 1, [1.0, 0.0], ("image-caption", 1.6), 2)], "query_id int, step int, vector array<double>, target struct<target_modality:string,boost_weight:double>, k int")
    got = [(r.chunk_id, r.raw_similarity, r.relevance_score) for r in vector_topk(q, index, 2).orderBy("rank").collect()]
    assert got == [("b", 0.8, 1.28), ("a", 1.0, 1.0)]


def test_fusion_rounds_every_step(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1, "a", 0.5, 0.7777), (1, 2, 1, "a", 0.5, 0.9), (1, 3, 1, "a", 0.5, 0.9), (1, 2, 2, "b", 0.4, 0.8)],
        "query_id int, step int, rank int, chunk_id string, raw_similarity double, relevance_score double",
    )
    got = [(r.chunk_id, r.relevance_score, r.corroborated, r.first_step) for r in fuse_hops(hits, 5).orderBy("rank").collect()]
    assert got == [("a", 1.2151, True, 1), ("b", 0.8, False, 2)]


def model_elbow(scores, alpha, min_k, max_k):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    top = scores[order[0]]
    if top <= 0:
        return order[:min_k]
    kept = []
    for place, i in enumerate(order):
        if place >= min_k and (place >= max_k or scores[i] < alpha * top):
            break
        kept.append(i)
    return kept


def test_elbow_and_pack_against_models(spark):
    rng = np.random.default_rng(5)
    cases = [[float(x) for x in rng.choice([0, 0.2, 0.5, 0.6, 0.9, 1.0], size=rng.integers(1, 9))] for _ in range(60)]
    rows = [(q, i + 1, f"c{i}", 0.0, s, "w " * int(rng.integers(1, 300)), None) for q, case in enumerate(cases) for i, s in enumerate(case)]
    df = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, raw_similarity double, relevance_score double, content string, caption string")
    for min_k, max_k in ((1, 5), (2, 3)):
        got = {}
        for r in elbow(df, 0.6, min_k, max_k).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(int(r.chunk_id[1:]))
        assert got == {q: model_elbow(case, 0.6, min_k, max_k) for q, case in enumerate(cases)}
    packed = {}
    for r in token_pack(df, 300).orderBy("rank").collect():
        packed.setdefault(r.query_id, []).append(r["rank"])
    for q in range(len(cases)):
        used, want = 0, []
        for _, rank, _, _, _, content, _ in (x for x in rows if x[0] == q):
            estimate = max(int(len(content.split()) * 1.33), 10)
            if want and used + estimate > 300:
                break
            used, want = used + estimate, want + [rank]
        assert packed[q] == want


def candidates(spark, question, rows):
    q = analyze_structure(spark.createDataFrame([(1, question)], "query_id int, question string"))
    ddl = "query_id int, rank int, raw_similarity double, relevance_score double, " + CHUNK_DDL
    return q, q.join(spark.createDataFrame([(1, n, s, r, *c) for n, (s, r, c) in enumerate(rows, 1)], ddl), "query_id")


def test_rerank_prefers_the_entity(spark):
    _, c = candidates(spark, "Vanguard Trebuchet brimstone caliber", [
        (0.5, 0.6, chunk(1, "misc.pdf", "The soldiers loaded regular stones.")), (0.5, 0.55, chunk(2, "codex.pdf", "The Vanguard Trebuchet fires brimstone caliber shells."))])
    out = rerank(c, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["c002", "c001"] and out[0].rerank_score > out[1].rerank_score
    _, one = candidates(spark, "Vanguard", [(0.5, 0.6, chunk(1, "misc.pdf", "x"))])
    alone = rerank(one, 5).first()
    assert alone.relevance_score == 0.6 and alone.rerank_score is None


def test_gate_and_report(spark):
    q, c = candidates(spark, "What is the garrison strength of Stonewatch?", [
        (0.8, 0.8, chunk(1, "a.pdf", "Stonewatch garrison counts 3,107.")), (0.7, 0.7, chunk(2, "b.pdf", "High stone towers.")), (0.3, 0.3, chunk(3, "c.pdf", "| soldiers | 4 |"))])
    gated = with_gate(c)
    assert {r.chunk_id for r in gated.where("kept").collect()} == {"c001", "c003"}  # a table with the field passes
    r = verification_report(q, gated).first()
    assert r.is_sufficient and (r.retained_count, r.pruned_count) == (2, 1) and r.entity_coverage["Stonewatch"].matching_chunks == 1
    assert r.field_coverage["garrison"].found and r.pruned_details[0].chunk_id == "c002"
    q2, c2 = candidates(spark, "secret passphrase of the Shadow Citadel", [(0.2, 0.2, chunk(1, "farm.pdf", "wheat harvest"))])
    assert not verification_report(q2, with_gate(c2)).first().is_sufficient


@pytest.mark.parametrize(("question", "sim", "text", "verdict"), [
    ("What is the garrison strength of Stonewatch?", 0.85, "Stonewatch garrison strength was 3,107", "CORRECT"),
    ("Explain cellular mitosis in biology", 0.15, "granite walls", "OUT_OF_DOMAIN"),
    ("When was the Accord of Mourne ratified?", 0.30, "the accord of mourne", "AMBIGUOUS"),
    ("who are you?", 0.30, "anything", "AMBIGUOUS"),
    ("Stonewatch", 0.45, "granite", "OUT_OF_DOMAIN"),
])
def test_confidence(spark, question, sim, text, verdict):
    q, c = candidates(spark, question, [(sim, sim, chunk(1, "doc.pdf", text))])
    assert retrieval_confidence(q, c).first().verdict == verdict
    nothing = retrieval_confidence(q, c.limit(0)).first()
    assert nothing.verdict == "OUT_OF_DOMAIN" and not nothing.is_in_domain


def test_retrieve_end_to_end(spark, chunks):
    q = spark.createDataFrame([(1, "What is the garrison of Stonewatch?"), (2, "Compare Stonewatch and Oakhaven"), (3, "hello"), (4, "")], "query_id int, question string")
    rows = retrieve(q, chunks).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in rows} == {1, 2}
    assert rows[0].chunk_id == "c001" and "readme.txt" not in {r.document_name for r in rows}
    assert {"c001", "c002"} <= {r.chunk_id for r in rows if r.query_id == 2}


def test_odd_vectors_are_left_out(spark, monkeypatch):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [None, 1.0]), ("e", [0.0, 0.0]), ("f", [0.0, 2.0])], "item_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [1.0, None])], "qid int, vector array<double>")
    for limit, tasks in ((1 << 20, 256), (1, 256), (1 << 20, 1)):
        monkeypatch.setattr(vectors, "TASKS_PER_LANE", tasks)
        got = sorted((r.qid, r.item_id) for r in knn(queries, items.repartition(3), 5, limit).collect())
        assert got == [(1, "a"), (1, "e"), (1, "f")]


def test_k_above_the_hint_is_honoured(spark):
    chunks = spark.createDataFrame([chunk(i, f"d{i}.txt", f"garrison number {i}") for i in range(40)], CHUNK_DDL)
    asked = with_features(spark.createDataFrame([(1, "garrison number")], "query_id int, question string"))
    asked = asked.withColumn("step", F.lit(1)).withColumn("k", F.lit(30))
    assert lexical.lexical_topk(asked, chunks, 16).count() == 30


def test_a_long_word_takes_linear_space(spark):
    letters = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(60_000))
    chunks = spark.createDataFrame([chunk(1, "d.txt", letters)], CHUNK_DDL)
    size = lexical._postings(chunks).agg(F.sum(F.length("token"))).first()[0]
    assert size < 3 * len(letters)


def test_exploded_words_carry_no_texts(spark, tmp_path):
    from folioscope.operators import postings

    held = [
        "the blue-green dome and the blue-red gate", "blue green dome", "x-blue-green dome", "blue-greenish dome", "a birth year of 1873",
        "birth in that year", "dome-blue-green", "Birth year and blue-red, blue-green", "the year of birth: blue-green blue",
    ]
    chunks = spark.createDataFrame([chunk(i, f"{'blue-green' if i % 3 == 0 else 'd'}{i}.txt", t) for i, t in enumerate(held)], CHUNK_DDL)
    assert not {"name", "cap", "sec", "body", "whole"} & set(lexical._postings(chunks).columns)
    questions = ["blue-green or blue-red dome", 'the "blue-green" dome', "the birth year of blue-green", 'Compare "blue-red" and "blue-green gate" by birth year']
    asked = with_features(spark.createDataFrame(list(enumerate(questions)), "query_id int, question string"))
    asked = checkpointed(asked.withColumn("step", F.lit(1)).withColumn("k", F.lit(9)))
    index = postings.build_postings(chunks, str(tmp_path / "index"))
    found = lexical.lexical_topk(asked, chunks).collect()
    assert len(found) > 20 and sorted(found) == sorted(postings.postings_topk(asked, index).select(*found[0].asDict()).collect())


def test_only_asked_words_are_exploded(spark, monkeypatch):
    chunks = spark.createDataFrame([chunk(i, f"garrison{i}.txt", f"garrison number {i} and other words of the text") for i in range(9)], CHUNK_DDL)
    asked = with_features(spark.createDataFrame([(1, 'garrison of "number 3"'), (2, "other words")], "query_id int, question string"))
    asked = checkpointed(asked.withColumn("step", F.lit(1)).withColumn("k", F.lit(5)))
    exploded, make = [], lexical._postings
    monkeypatch.setattr(lexical, "_postings", lambda *a: exploded.append(make(*a)) or exploded[-1])
    found = [sorted(lexical.lexical_topk(asked, chunks).collect())]
    monkeypatch.setattr(lexical, "LISTED_TOKENS", 0)
    found.append(sorted(lexical.lexical_topk(asked, chunks).collect()))
    of_content = [set(r["token"] for r in p.where("pos < to_body").collect()) for p in exploded]
    assert found[0] == found[1] and len(found[0]) == 10
    assert of_content[0] <= {"garrison", "number", "other", "words", "3"} and {"of", "the", "text"} < of_content[1]


def test_hits_of_a_chunk_are_added_up_where_they_are_found(spark):
    chunks = spark.createDataFrame([chunk(i, f"d{i}.txt", f"garrison number {i}") for i in range(40)], CHUNK_DDL)
    asked = with_features(spark.createDataFrame([(1, "garrison number")], "query_id int, question string"))
    found = lexical.lexical_topk(asked.withColumn("step", F.lit(1)).withColumn("k", F.lit(4)), chunks)
    assert "hashpartitioning(chunk_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r["chunk_id"] for r in found.orderBy("rank").collect()] == sorted(r["chunk_id"] for r in chunks.collect())[:4]


def test_sums_do_not_depend_on_batches(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from folioscope.operators import scoring

    terms = pd.DataFrame({
        "query_id": [1, 1, 2, 2, 2], "step": 1, "ent": [-1, 0, -1, -1, -1], "n_tok": [0, 1, 0, 0, 0], "token": ["a", "b", "a", "c", "d"],
        "kind": [0, 2, 0, 1, 1], "weight": [2, 1, 1, 4, 4], "pattern": None, "phrase": None,
    })
    totals = pd.DataFrame({"query_id": [1, 2], "step": 1, "n_entities": [1, 0], "n_fields": [0, 1], "n_words": [2, 1], "target_code": 0, "boost": 1.0, "k": 3})
    different, shares = scoring.numbered_terms(terms, totals, ["query_id", "step"], {"word": 0, "field": 1, "token": 2})
    number = dict(zip(different["token"], different["term"]))
    hits = [(no, f"c{no % 17:02}", 0, number[t], 1.0 + (no % 5 == 0)) for no in range(60) for t in "abcd" if (no * 7 + ord(t)) % 3]
    rows = pa.Table.from_pylist([dict(zip(("no", "chunk_id", "traits", "term", "points"), h)) for h in hits])

    def best(size):
        return pa.Table.from_batches(scoring.best_sums(iter(rows.to_batches(max_chunksize=size)), shares, 3, 2)).to_pandas()

    def top(sums):  # (chunk_id, words, field_bits, entity_points, entities_matched)
        return sorted((-(r[1] + 3.0 * bin(r[2]).count("1") + r[3]), r[0]) for r in set(sums.drop(columns=["q", "traits"]).itertuples(index=False, name=None)))[:3]

    whole = best(1000)
    monkeypatch.setattr(scoring, "TOGETHER", 5)
    monkeypatch.setattr(scoring, "WAITING", 1)
    parts = best(2)
    for q in (0, 1):
        assert top(whole[whole["q"] == q]) == top(parts[parts["q"] == q]) and (whole["q"] == q).sum() >= 3
    got = whole[whole["q"] == 1]
    assert (got["field_bits"] <= 4).all()  # two aliases of one family are one hit
