"""Bucket deltas and incremental ingestion against full rewrites."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from folioscope.schema import CHUNK
from folioscope.sources import corpus, deltas, documents
from folioscope.sources.corpus import chunk_files, read_corpus
from folioscope.sources.deltas import BucketTable, ingest_stream, with_free_ids

ROWS = StructType().add("chunk_id", StringType()).add("version", IntegerType()).add("text", StringType())


def rows(spark, given):
    return spark.createDataFrame(given, ROWS)


def held(table):
    return sorted((r["chunk_id"] or "", r["version"], r["text"]) for r in table.read().collect())


def files_of(folder):
    return {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=32)
    assert held(table) == []
    table.upsert(rows(spark, [(f"c{k}", 1, "old") for k in range(300)]))
    before, folders = files_of(tmp_path / "t" / "data"), table.manifest()[1]
    fresh = [("c7", 2, "new"), ("c7", 3, "newest"), ("c7", 3, "newer"), ("c999", 1, "added"), (None, 1, "no id"), (None, 2, "no id")]
    table.upsert(rows(spark, fresh))
    want = {f"c{k}": (1, "old") for k in range(300)} | {"c7": (3, "newest"), "c999": (1, "added"), "": (2, "no id")}
    assert held(table) == sorted((k, *v) for k, v in want.items())
    after = files_of(tmp_path / "t" / "data")
    assert all(after[f] == before[f] for f in before)  # old files are never changed
    moved = {b for b, v in table.manifest()[1].items() if folders.get(b) != v}
    assert 1 <= len(moved) <= 3 and len(after) - len(before) == len(moved)
    # an explicit order among fresh rows of one id
    table.upsert(rows(spark, [("c7", 9, "a"), ("c7", 8, "b")]).withColumn("at", -F.col("version")), order=["at"])
    assert ("c7", 8, "b") in held(table)


def test_unfinished_write_is_not_seen(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=4)
    table.upsert(rows(spark, [("a", 1, "x")]), batch=0)
    table.upsert(rows(spark, [("a", 2, "y")]), batch=1)
    table.upsert(rows(spark, [("a", 7, "again")]), batch=1)  # a repeated batch
    assert held(table) == [("a", 2, "y")]
    os.remove(tmp_path / "t" / "manifest" / "number=1" / "_SUCCESS")
    assert held(table) == [("a", 1, "x")]
    with pytest.raises(Exception, match="(?i)exists"):
        table.upsert(rows(spark, [("a", 3, "z")]))  # another writer has the number
    table.upsert(rows(spark, []).limit(0), batch=0)
    assert held(table) == [("a", 1, "x")]


def test_taken_ids_get_the_next_number(spark):
    one = lambda ids: spark.createDataFrame([(i, i) for i in ids], "chunk_id string, was string")
    stored = one(["a", "a_dup1", "b", "c_dup4"]).select("chunk_id")
    out = {r["was"]: r["chunk_id"] for r in with_free_ids(one(["a", "a_dup1", "b", "c_dup4", "d"]), stored).collect()}
    assert out == {"a": "a_dup2", "a_dup1": "a_dup3", "b": "b_dup1", "c_dup4": "c_dup5", "d": "d"}


def test_folder_fed_in_three_batches_is_one_read(spark, tmp_path):
    root, table = tmp_path / "in", BucketTable(spark, str(tmp_path / "t"), CHUNK, buckets=8)
    for k, (folder, name, text) in enumerate([("a", "one.md", "# T\nfirst\n## U\nsecond"), ("a", "two.txt", "plain text"), ("b", "one.md", "# T\nother\n## U\nthings"), ("c", "skip.xyz", "no"), ("c", "Three.TXT", "SHOUTED\n" + "words " * 900)]):
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_text(text, encoding="utf-8")
        if k in (1, 2, 4):
            ingest_stream(spark, str(root), table, str(tmp_path / "check"))
    whole = sorted(map(str, read_corpus(spark, str(root)).collect()))
    assert sorted(map(str, table.read().select(CHUNK.fieldNames()).collect())) == whole and len(whole) >= 6
    number = table.manifest()[0]
    ingest_stream(spark, str(root), table, str(tmp_path / "check"))
    assert table.manifest()[0] == number and table.read().count() == len(whole)


def test_new_rows_are_not_written_with_every_batch(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=1)
    for k in range(17):
        table.upsert(rows(spark, [(f"c{k}", 1, "x")]), batch=k, new=True)
    assert held(table) == sorted((f"c{k}", 1, "x") for k in range(17))
    written = spark.read.schema(ROWS).parquet(str(tmp_path / "t" / "data")).count()
    assert written == 17 + 2 * 7  # 153, were all rows of the bucket written each time
    assert [tier for _, tier in table.manifest()[1][0]] == [1, 1, 0]
    table.upsert(rows(spark, [("c3", 2, "y")]), batch=17)
    assert ("c3", 2, "y") in held(table) and len(held(table)) == 17


def test_a_batch_lists_its_files_in_few_tasks(spark, tmp_path, monkeypatch):
    """Spark's own limit is a task a file, up to 10,000."""
    key, seen, chunked = "spark.sql.sources.parallelPartitionDiscovery.parallelism", [], corpus.chunk_files
    monkeypatch.setattr(corpus, "chunk_files", lambda *a, **b: seen.append(int(spark.conf.get(key))) or chunked(*a, **b))
    (tmp_path / "in").mkdir()
    for k in range(40):
        (tmp_path / "in" / f"f{k}.txt").write_text(f"text {k}", encoding="utf-8")
    table = BucketTable(spark, str(tmp_path / "t"), CHUNK, buckets=4)
    ingest_stream(spark, str(tmp_path / "in"), table, str(tmp_path / "check"), files_per_batch=20)
    assert seen == [4 * spark.sparkContext.defaultParallelism] * 2
    assert spark.conf.get(key, "10000") == "10000"  # as before
    assert table.read().count() == 40


def test_files_of_one_format_and_of_all(spark, tmp_path):
    """Formats that a batch lacks are left out; those it has are read as ever."""
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (200).to_bytes(4, "big") * 2
    given = [("in/a.md", b"# A\none"), ("in/b.txt", b"two"), ("in/c.png", png), ("in/d.docx", b"broken"), ("in/e.xyz", b"no")]
    ids = lambda rows: sorted(r[0] for r in chunk_files(spark.createDataFrame(rows, "path string, content binary")).select("chunk_id").collect())
    assert ids(given) == ["a_p1_c01", "b_p1_c01", "fig_c"]
    assert [ids([row]) for row in given] == [["a_p1_c01"], ["b_p1_c01"], ["fig_c"], [], []]
    plan = chunk_files(spark.createDataFrame(given[1:2], "path string, content binary"))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan.partition("== Optimized")[2]  # no id is there twice


def test_large_expressions_are_built_once(spark):
    assert corpus._pieces(800, 150) is corpus._pieces(800, 150) and corpus._pieces(800, 150) is not corpus._pieces(120, 30)
    assert documents._sections() is documents._sections()


def test_new_rows_move_once(spark, tmp_path, monkeypatch):
    """They are dealt to their buckets and made one a key there; nothing is stored in between."""
    table, stored = BucketTable(spark, str(tmp_path / "t"), ROWS, buckets=4), []
    monkeypatch.setattr(deltas, "checkpointed", lambda df: stored.append(df) or df)
    for k in range(9):  # two of one id; parts of buckets without new rows are merged when they are due
        table.upsert(rows(spark, [(f"c{k}", 1, "x"), (f"c{k}", 2, "y")] if k else [(f"b{j}", 1, "x") for j in range(20)]), batch=k, new=True)
    table.upsert(rows(spark, []).limit(0), batch=9, new=True)
    assert held(table) == sorted([(f"b{j}", 1, "x") for j in range(20)] + [(f"c{k}", 2, "y") for k in range(1, 9)])
    assert stored == [] and table.manifest()[2] == 9


def test_empty_write_to_an_empty_table(spark, tmp_path):
    for new in (False, True):
        table = BucketTable(spark, str(tmp_path / f"t{new}"), ROWS, buckets=4)
        table.upsert(rows(spark, []).limit(0), batch=3, new=new)
        assert (table.manifest(), held(table)) == ((0, {}, 3), [])
