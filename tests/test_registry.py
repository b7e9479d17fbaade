"""Every registered query against its reference SQL on the smallest tables."""

import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


# Composed of steps that have SQL of their own; tested below on their parts.
COMPOSED = {"vector_retrieve_e2e", "answer_e2e", "benchmark_e2e"}


def own_queries():
    """Queries of the registry; those of folioscope.llm have tests of their own."""
    return {name for module in entry.MODULES for name in module.QUERIES if module.__name__.startswith("registry")}


def test_every_query_has_sql():
    assert own_queries() - set(entry.oracle_sql()) == COMPOSED
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_composed_queries(spark):
    q = entry.queries()
    answers = {r["query_id"]: r for r in q["answer_e2e"](spark, SF).collect()}
    results = {r["query_id"]: r for r in q["benchmark_e2e"](spark, SF).collect()}
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert len(answers) == len(results) == asked
    for i, r in results.items():
        whole = answers[i]["answer"]
        assert r["question"] == answers[i]["question"]
        assert r["generated_answer"] == (whole if len(whole) <= 250 else whole[:250] + "...")
        assert r["retrieved_chunks_count"] == max(0, answers[i]["n_chunks"] or 0)
    assert any("**" in a["answer"] for a in answers.values())
    found = q["vector_retrieve_e2e"](spark, SF).collect()
    plain = {(r["query_id"], r["chunk_id"]) for r in q["retrieve_e2e"](spark, SF).collect() if r["query_id"] % 3 == 0}
    assert {(r["query_id"], r["chunk_id"]) for r in found if r["query_id"] % 3 == 0} == plain
    assert {r["query_id"] for r in found if r["query_id"] % 3}


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", sorted(own_queries() - COMPOSED))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sum(got.values()) > 0
    assert got == want
