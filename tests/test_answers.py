from pyspark.sql import functions as F

from folioscope.operators.answer import fix_media, normalize_citations
from folioscope.operators.evaluate import citation_accuracy, evaluation_summary, hallucination, modality_success, retrieval_precision
from folioscope.operators.media import resolve_media
from folioscope.plans.answer import generate_answers
from folioscope.plans.retrieve import retrieve

CTX = "array<struct<rank:int,document_name:string,page_number:int,section_title:string,modality:string,content:string,media_path:string,caption:string,resolved_media:string>>"
CHUNKS = [
    (1, "annals.pdf", 4, "Accord", "text", "The Accord was signed in 342 AS by Halvard Grey after 3,107 losses.", None, None, None),
    (2, "plate.png", 1, "Plate", "image-caption", "Official plate of Stonewatch.", "m/plate.png", "Figure Plate: Stonewatch", "data/m/plate.png"),
]


def answers(spark, texts, context=CHUNKS):
    return spark.createDataFrame([(i, t, context) for i, t in enumerate(texts)], f"query_id int, answer string, context {CTX}")


def test_citations_are_normalised(spark):
    texts = ["391 AS. [Chunk 1]", "no source", "x [chunk 9]", "【Chunk 2, Page 7】", "[Document: annals.pdf, Page 3] 5 km", ""]
    got = [r[0] for r in answers(spark, texts).orderBy("query_id").select(normalize_citations(F.col("answer"), F.col("context"))).collect()]
    assert got == [
        "391 AS. [annals.pdf, Page 4]", "no source\n\nSource: [annals.pdf, Page 4]", "x [chunk 9]\n\nSource: [annals.pdf, Page 4]",
        "[plate.png, Page 7]", "[annals.pdf, Page 3] 5 km", "",
    ]


def test_media_paths(spark):
    catalog = spark.createDataFrame([("data/m/plate.png",), ("data/extracted_media/tables/t.png",)], "path string")
    paths = spark.createDataFrame([("m/plate.png",), ("'x/t.png'",), ("gone.png",), ("",), (None,)], "media_path string")
    assert {r.media_path: r.resolved for r in resolve_media(paths, catalog).collect()} == {"m/plate.png": "data/m/plate.png", "'x/t.png'": "data/extracted_media/tables/t.png", "gone.png": None}
    texts = ["a ![x](m/plate.png) b", "a ![](far/plate.png)", "a ![x](gone.png)", "plain", "cut ![x](m/pl"]
    got = [r.answer for r in fix_media(answers(spark, texts), catalog).orderBy("query_id").collect()]
    added = "\n\n![Figure Plate: Stonewatch](data/m/plate.png)\n*Figure: Figure Plate: Stonewatch — [plate.png, Page 1]*"
    assert got == ["a ![x](data/m/plate.png) b", "a ![Figure Plate: Stonewatch](data/m/plate.png)", "a ![x](gone.png)", "plain" + added, "cut" + added]


def test_metrics(spark):
    texts = ["as in [annals.pdf, Page 3].", "none", "does not specify", "In 1873 it fell", "It cost 9,999 coins", "3,107 of them", "Anna Bell met Carl Dove and Eva Finch there", "| a | b |\n|---|---|\n| 1 | 2 |"]
    a, c = F.col("answer"), F.col("context")
    rows = answers(spark, texts).select(
        "query_id", citation_accuracy(a, c).alias("cite"), citation_accuracy(a, c, strict=True).alias("strict"), hallucination(a, c).alias("bad"),
        modality_success(a, c, F.lit("table"), F.lit(False)).alias("grid"), modality_success(a, c, F.lit("image-caption"), F.lit(False)).alias("figure"),
        retrieval_precision(F.lit("What did Halvard do?"), c, F.lit("image-caption")).alias("found"),
    ).orderBy("query_id").collect()
    assert [r.cite for r in rows] == [True, False, True] + [False] * 5
    assert not rows[0].strict
    assert [r.bad for r in rows] == [False, False, False, True, True, False, True, False]
    assert [r.grid for r in rows] == [False] * 7 + [True]
    assert all(r.figure and r.found for r in rows)
    empty = answers(spark, ["some long claim without any context at all"], []).select(hallucination(a, c), retrieval_precision(F.lit("x yz abc"), c, F.lit("text"))).first()
    assert tuple(empty) == (True, False)


def test_summary(spark):
    rows = [("1a_1", "text", True, True, False, False, 1.0), ("1b_1", "text", True, False, True, True, 2.0), ("1b_2", "table", False, True, False, True, 4.0)]
    s = evaluation_summary(spark.createDataFrame(rows, "qid string, target_modality string, retrieval_precision boolean, citation_accuracy boolean, hallucination boolean, modality_success boolean, latency_sec double")).first()
    assert (s.total_questions, s.retrieval_precision_pct, s.hallucination_pct, s.modality_total, s.modality_pass) == (3, 66.7, 33.3, 2, 1)
    assert (s.average_latency_seconds, s.median_p50_latency_seconds, s.p95_latency_seconds) == (2.33, 2.0, 3.8)


def test_generated_answers(spark):
    chunks = spark.createDataFrame(
        [
            ("t1", "ledger.pdf", 5, "Units", "table", "| Unit | Cost |\n|---|---|\n| Alpha | 1000 |\n| Beta | 600 |", None, "Table of units", "wiki"),
            ("t2", "annals.pdf", 18, "Siege", "text", "The Vanguard Trebuchet has an effective range of 450 cubits and fires brimstone projectiles over walls.", None, None, "official_codex"),
        ],
        "chunk_id string, document_name string, page_number int, section_title string, modality string, content string, media_path string, caption string, source_reliability string",
    )
    qs = ["What is the total cost of Alpha and Beta?", "What is the effective range of the Vanguard Trebuchet?", "Write a python script", "Explain cellular mitosis in biology", ""]
    q = spark.createDataFrame(list(enumerate(qs)), "query_id int, question string")
    packed = retrieve(q, chunks)
    catalog = spark.createDataFrame([], "path string")
    got = {r.query_id: r.answer for r in generate_answers(q, packed, catalog).collect()}
    assert "1600.0" in got[0] and "[ledger.pdf, Page 5]" in got[0]
    assert "450 cubits" in got[1] and "[annals.pdf, Page 18]" in got[1]
    assert all("outside the scope" in got[i] for i in (2, 3)) and got[4].startswith("Please ask")

    def drafts(prompts):
        return prompts.select("query_id", F.when(F.col("query_id") == 1, F.concat(F.lit("Range per [Chunk 1]: "), F.length("prompt").cast("string"))).alias("draft"))

    drafted = {r.query_id: r.answer for r in generate_answers(q, packed, catalog, drafts).collect()}
    assert drafted[1].startswith("Range per [annals.pdf, Page 18]: ") and drafted[0] == got[0]


def test_benchmark_moves_the_latency_of_its_questions_only(spark, monkeypatch):
    from folioscope.plans import benchmark

    passed, evaluate = [], benchmark.evaluate_answers
    monkeypatch.setattr(benchmark, "evaluate_answers", lambda a, m, latency, lex: passed.append(latency) or evaluate(a, m, latency, lex))
    chunks = spark.createDataFrame(
        [(f"c{i}", f"wiki_{i}.txt", 1, "S", "text", f"The garrison of Stonewatch had {i} men.", None, None, "wiki") for i in range(3)],
        "chunk_id string, document_name string, page_number int, section_title string, modality string, content string, media_path string, caption string, source_reliability string",
    )
    questions = spark.createDataFrame([(7, "1a_7", "1A: x", "garrison of Stonewatch"), (8, "1b_8", "1A: x", "hello")], "query_id long, qid string, track string, question string")
    latency = spark.range(1000).select(F.col("id").alias("query_id"), (F.col("id") / 10).alias("latency_sec"))
    results, summary = benchmark.run_benchmark(questions, chunks, spark.createDataFrame([], "path string"), latency)
    assert {r["query_id"]: r["latency_sec"] for r in results.collect()} == {7: 0.7, 8: 0.8} and summary.first()["total_questions"] == 2
    assert {r["query_id"] for r in passed[0].collect()} == {7, 8}
