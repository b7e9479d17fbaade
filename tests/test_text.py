import re

from pyspark.sql import functions as F

from folioscope.functions.chunking import chunk_texts
from folioscope.functions.paths import document_type, source_reliability
from folioscope.functions.tables import format_markdown_table, numeric_value, parse_markdown_table
from folioscope.functions.text import slug, title_case
from folioscope.operators.tables import column_stats, table_aggregates, table_summary
from folioscope.sources.documents import markdown_sections, text_title


def column(spark, values, ddl, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {ddl}").select(expr(F.col("x"))).collect()]


def test_slug_and_title_case(spark):
    assert column(spark, ["Codex: Vol 1 (Final!)", "", "__a__b", "é"], "string", slug) == ["codex_vol_1_final", "chunk", "a_b", "chunk"]
    assert column(spark, ["x" * 80], "string", slug) == ["x" * 60]
    assert column(spark, ["last-warden o'neil 3rd"], "string", title_case) == ["Last-Warden O'Neil 3Rd"]


def test_paths(spark):
    paths = ["d/codex/v.pdf", "d/wiki/m.md", "d/chronicles/b.docx", "d/ephemera/court_martial_1.pdf", "d/ephemera/ballad_c.docx", "d/ephemera/auction_catalogue.txt", "d/x.txt"]
    assert column(spark, paths, "string", source_reliability) == ["official_codex", "wiki", "novel", "ephemera_trial", "ephemera_tavern", "ephemera_catalogue", "unknown"]
    assert column(spark, ["a.scan.pdf", "a.pdf", "a.DOCX", "a.md", "a.txt", "scandal.md", "a.odt"], "string", document_type) == ["scan", "pdf", "docx", "md", "txt", "scan", "txt"]


def model_chunks(text, size, overlap):
    """Plain model of the packing rules, used as the expected value."""
    text = text.strip()
    if len(text) <= size + 100:
        return [text] if text else []
    done, pieces, used = [], [], 0

    def close(joiner, always):
        nonlocal pieces, used
        if not pieces:
            return
        body = joiner.join(pieces)
        done.append(body)
        seed = body[-overlap:] if always or len(body) > overlap else ""
        pieces, used = ([seed] if seed else []), len(seed)

    for para in filter(None, (p.strip() for p in text.split("\n\n"))):
        oversized = len(para) > size
        if used + len(para) > size:
            close("\n\n", False)
        if not oversized:
            pieces.append(para)
            used += len(para) + 2
            continue
        for sentence in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", para))):
            if used + len(sentence) > size:
                close(" ", True)
            pieces.append(sentence)
            used += len(sentence) + 1
    rest = "\n\n".join(pieces).strip()
    return done + ([rest] if rest and (not done or rest != done[-1]) else [])


def test_chunks_match_model(spark):
    sentence = "Ash fell on the %s tower. "
    texts = [
        "", "  \n ", "short", "a" * 900, "a" * 901, "\n\n".join("p%d " % i * 40 for i in range(30)),
        "".join(sentence % i for i in range(200)), "intro\n\n" + "".join(sentence % i for i in range(90)) + "\n\n" + "tail " * 60,
        "x" * 2500, "one. " * 300 + "\n\n" + "two! " * 20, "é" * 500 + "\n\n" + "ü" * 500,
    ]
    assert column(spark, texts, "string", chunk_texts) == [model_chunks(t, 800, 150) for t in texts]
    small = column(spark, texts, "string", lambda c: chunk_texts(c, 120, 30))
    assert small == [model_chunks(t, 120, 30) for t in texts]


def test_markdown_sections(spark):
    text = "lead\n# A\none\n### C\ntwo\n## B\n\n## B2\nthree\n# Z\nend"
    rows = markdown_sections(spark.createDataFrame([("my_file", text), ("only", "# H1\n## H2"), ("none", "")], "stem string, text string")).collect()
    got = [(r.stem, r.section_no, r.section_title, r.section_text) for r in rows]
    assert got == [
        ("my_file", 1, "My File", "lead"), ("my_file", 2, "A", "one"), ("my_file", 3, "A > C", "two"),
        ("my_file", 4, "A > B2", "three"), ("my_file", 5, "Z", "end"), ("only", 1, "H1 > H2", "# H1\n## H2"),
    ]


def test_text_title(spark):
    rows = spark.createDataFrame([("a_b", "intro\nITEM 42\nX"), ("c", "lower\n" * 6 + "LATE TITLE")], "s string, t string")
    assert [r[0] for r in rows.select(text_title(F.col("s"), F.col("t"))).collect()] == ["A B > ITEM 42", "C"]


def test_markdown_tables(spark):
    grids = [[["Item", "Cost"], ["A|b", "27\n v"], [None, None], ["x"]], [["k", "v"]], [["a", "b", "c"]], [[None, None]], []]
    out = column(spark, grids, "array<array<string>>", format_markdown_table)
    assert out == [
        "| Item | Cost |\n| --- | --- |\n| A\\|b | 27 v |\n| x |  |", "| Property | Record |\n| --- | --- |\n| k | v |",
        "| Col 1 | Col 2 | Col 3 |\n| --- | --- | --- |\n| a | b | c |", "", "",
    ]
    texts = ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n| 4 | 5 |", "a | b | c\n--|--|--\n1 | 2 | 3", "| a |\n|---|", "| a | a |\n|-|-|\n| 1 | 2 |"]
    assert column(spark, texts, "string", parse_markdown_table) == [[{"a": "1", "b": "2"}, {"a": "4", "b": "5"}], [{"b": "2"}], [], [{"a": "2"}]]
    assert column(spark, ["3 of 10", "12-15", "3107.", "", "x", "1,200"], "string", numeric_value) == [310.0, None, 3107.0, None, None, 1200.0]


def test_table_aggregates(spark):
    md = "| Unit | Cost |\n|---|---|\n| Alpha | 1000 |\n| Beta | 600 |"
    q = spark.createDataFrame([(1, "total cost?"), (2, "describe"), (3, "total?")], "query_id int, question string")
    c = spark.createDataFrame([(1, 1, "table", md, "a.pdf", 5), (1, 2, "text", "no grid", "b.pdf", 1), (2, 1, "table", md, "a.pdf", 5)], "query_id int, rank int, modality string, content string, document_name string, page_number int")
    got = [(r.query_id, r.column, r.n_values, r.sum_value, r.avg_value, r.min_value, r.max_value) for r in table_aggregates(q, c).collect()]
    assert got == [(1, "Cost", 2, 1600.0, 800.0, 600.0, 1000.0)]
    s = {r.query_id: r for r in table_summary(q, c).collect()}
    assert s[1].tables_found == 1 and s[1].total_rows == 2 and s[1].matrix_markdown == f"**Source: [a.pdf, Page 5]**\n{md}"
    assert not s[3].has_tables and s[3].matrix_markdown == ""
    none = column_stats(spark.createDataFrame([("k", "n/a")], "k string, cell string"), ["k"]).first()
    assert (none.n_values, none.sum_value, none.max_value) == (0, 0.0, 0.0)


def test_tables_are_parsed_once(spark):
    from registry import table_queries

    plan = table_queries.aggregates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter " in line and "size(transform(" in line]
