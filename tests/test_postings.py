"""The stored index against the scan of all chunks."""

from collections import Counter

from pyspark.sql import functions as F

from folioscope.operators import lexical, postings
from folioscope.operators.query_features import with_features
from folioscope.session import checkpointed
from tests.test_retrieval import CHUNK_DDL, CHUNKS, QUESTIONS, chunk


def asked(spark, questions):
    rows = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string")
    return checkpointed(with_features(rows).withColumn("step", F.lit(1)).withColumn("k", F.col("candidate_k")))


def rows(df):
    return Counter((r["query_id"], r["chunk_id"], r["raw_similarity"], r["relevance_score"], r["rank"]) for r in df.collect())


def test_same_rows_as_the_scan(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, CHUNK_DDL)
    index = postings.build_postings(chunks, str(tmp_path / "index"), parts=3)
    for questions in (QUESTIONS, ['the "ou" and "wood" of the last-warden', "x", "", "garrison " * 30, "find 'of fire' near 'Silent Grey'"]):
        q = asked(spark, questions)
        want = rows(lexical.lexical_topk(q, chunks))
        assert rows(postings.postings_topk(q, index)) == want and want


def test_bounds_leave_most_pairs_out(spark, tmp_path, monkeypatch):
    """Common words only, rare words in few chunks, ties at the border, several blocks."""
    monkeypatch.setattr(postings, "BLOCK_BITS", 4)
    monkeypatch.setattr(postings, "SHELF_BITS", 6)
    many = [chunk(k, f"file{k}.txt", f"granite meadow lantern {'sword of stone' if k % 40 == 0 else 'plain'} word{k % 100} {'rare' + str(k) if k % 7 == 0 else ''}") for k in range(1000)]
    chunks = spark.createDataFrame(many, CHUNK_DDL)
    index = postings.build_postings(chunks, str(tmp_path / "index"))
    q = asked(spark, ["granite meadow lantern word17 word18 rare119", "granite meadow lantern", "granite meadow sunk lantern", 'granite near "sword of stone" lantern', "nothing known here"])
    assert rows(postings.postings_topk(q, index)) == rows(lexical.lexical_topk(q, chunks))
    terms = checkpointed(postings.lookups(index, lexical.search_terms(q)))
    pairs = postings.candidate_pairs(index, terms, lexical.query_totals(q), 16).groupBy("query_id").count().collect()
    counts = {r["query_id"]: r["count"] for r in pairs}
    assert counts[0] < 60 and counts[3] < 60  # of 1,000 chunks that all share words with the question


def test_search_reads_no_text(spark, tmp_path):
    index = postings.build_postings(spark.createDataFrame(CHUNKS, CHUNK_DDL), str(tmp_path / "index"))
    terms = postings.lookups(index, lexical.search_terms(asked(spark, ["garrison of Stonewatch"])))
    plan = postings.found_by(index, terms)._jdf.queryExecution().executedPlan().toString()
    assert "/lists" in plan and "/texts" not in plan and "body" not in plan


def test_empty_index_and_no_questions(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, CHUNK_DDL)
    index = postings.build_postings(chunks, str(tmp_path / "index"))
    assert postings.postings_topk(asked(spark, ["garrison"]).limit(0), index).count() == 0


def test_part_of_words_is_one_list(spark, tmp_path):
    many = [chunk(k, f"file{k}.txt", f"stonewatch{chr(97 + k)} held the gate") for k in range(20)]
    index = postings.build_postings(spark.createDataFrame(many, CHUNK_DDL), str(tmp_path / "index"))
    terms = lexical.search_terms(asked(spark, ["garrison of Stonewatch"]))
    found = postings.lookups(index, terms)
    part = found.where(found.kind == lexical.ENTITY_PART).collect()
    assert [r["df"] for r in part] == [20]
    again = postings.lookups(index, terms)
    assert index.parts.selectExpr("sum(size(entries))").first()[0] == 20 and again.count() == found.count()


def test_lists_stay_where_they_are_read(spark, tmp_path):
    index = postings.build_postings(spark.createDataFrame(CHUNKS, CHUNK_DDL), str(tmp_path / "index"))
    terms = checkpointed(postings.lookups(index, lexical.search_terms(asked(spark, ["garrison of Stonewatch"]))))
    pairs = postings.found_by(index, terms).select("query_id", "step", "no").distinct()
    hits = postings.hits_of(pairs, index, terms)
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    by_name = {(r["no"], r["token"]) for r in hits.collect()}
    every = {(r["no"], r["token"]) for r in index.listed.selectExpr("token", "inline(entries)").join(terms, "token").collect()}
    assert by_name == every
