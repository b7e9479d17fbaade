"""Recursive corpus scan and its conversion to chunks, format by format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.chunking import chunk_texts
from folioscope.functions.paths import document_type, file_name, source_category, source_reliability, stem, suffix
from folioscope.functions.text import LINE_BREAK, built_once, slug, strip, word_count
from folioscope.operators.media import Plate, describe_figure, match_plate
from folioscope.operators.pdf_extras import embedded_figures, table_chunks
from folioscope.operators.validate import unique_ids, validate_table
from folioscope.schema import CHUNK, METADATA
from folioscope.session import checkpointed
from folioscope.sources import binary
from folioscope.sources.documents import markdown_sections, stem_title, text_title

IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg"]
MARKDOWN_SUFFIXES = [".md", ".markdown"]
DOCUMENT_SUFFIXES = [*MARKDOWN_SUFFIXES, ".txt", ".docx", *IMAGE_SUFFIXES]


def suffix_glob(suffixes: list[str]) -> str:
    """A file-name pattern for ``suffixes`` in any case."""
    letters = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*{" + ",".join(letters) + "}"


def _named(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """``files(path, content)`` with document_name, stem and suffix, other files left out."""
    named = files.select("path", "content", file_name(F.col("path")).alias("document_name"))
    return named.withColumn("suffix", suffix(F.col("document_name"))).where(F.col("suffix").isin(suffixes)).withColumn("stem", stem(F.col("document_name")))


def scan_files(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(path, document_name, stem, suffix, content) of files below ``root``; other
    files are left out by name, before anything is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _named(reader.option("pathGlobFilter", suffix_glob(suffixes)).load(root), suffixes)


def _text(files: DataFrame) -> DataFrame:
    """Decode as UTF-8, bad bytes replaced."""
    return files.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def markdown_parts(files: DataFrame) -> DataFrame:
    rows = markdown_sections(_text(files.where(F.col("suffix").isin(MARKDOWN_SUFFIXES))))
    return _parts(rows, F.lit("md"), F.lit("wiki"))


def text_parts(files: DataFrame) -> DataFrame:
    rows = _text(files.where(F.col("suffix") == ".txt"))
    rows = rows.select("*", *_text_section())
    return _parts(rows, F.lit("txt"), F.lit("ephemera"))


@built_once
def _text_section() -> list[Column]:
    title = text_title(F.col("stem"), F.col("text"))
    return [title.alias("section_title"), F.col("text").alias("section_text"), F.lit(1).alias("section_no")]


def docx_parts(files: DataFrame) -> DataFrame:
    """Sections and page estimates from the paragraphs of DOCX files."""
    rows = files.where(F.col("suffix") == ".docx").select("path", "document_name", "stem", "content")
    parsed = rows.mapInPandas(binary.docx_sections, binary.DOCX_SCHEMA)
    titled = parsed.withColumn(
        "section_title", F.concat_ws(" > ", stem_title(F.col("stem")), F.when(F.col("heading") != "", F.col("heading")))
    )
    return _parts(titled, F.lit("docx"), source_category(F.col("path")), F.col("page_number"))


def is_scanned_page(text: Column, n_images: Column, min_chars: int = 40) -> Column:
    length = F.length(strip(F.coalesce(text, F.lit(""))))
    return (length < min_chars) & ((n_images > 0) | (length == 0))


def pdf_parts(pages: DataFrame) -> DataFrame:
    """One part per page of ``pages(path, page_number, text, is_ocr)``; a heading-like
    first line titles it and the pages after."""
    named = pages.withColumn("document_name", file_name(F.col("path"))).withColumn("stem", stem(F.col("document_name")))
    filled = named.where(strip(F.col("text")) != "")
    first = strip(F.element_at(F.split(strip(F.col("text")), LINE_BREAK), 1))
    heading = F.when((F.length(first) > 3) & (F.length(first) < 80) & ~F.endswith(first, F.lit(".")), first)
    carried = F.last(heading, ignorenulls=True).over(Window.partitionBy("path").orderBy("page_number"))
    rows = filled.withColumn("section_title", F.concat_ws(" > ", stem_title(F.col("stem")), carried))
    rows = rows.withColumn("section_text", F.col("text")).withColumn("section_no", F.col("page_number"))
    return _parts(rows, document_type(F.col("path")), source_category(F.col("path")), F.col("page_number"), F.col("is_ocr"))


@built_once
def _reliability() -> Column:
    return source_reliability(F.col("path"))


def _parts(rows: DataFrame, kind: Column, category: Column, page: Column | None = None, is_ocr: Column | None = None) -> DataFrame:
    return rows.select(
        "path",
        "document_name",
        "stem",
        "section_no",
        "section_title",
        "section_text",
        kind.alias("document_type"),
        (page if page is not None else F.lit(1)).cast("int").alias("page_number"),
        category.alias("source_category"),
        _reliability().alias("source_reliability"),
        (is_ocr if is_ocr is not None else F.lit(None)).cast("boolean").alias("is_ocr"),
    )


def _metadata(**values: Column) -> Column:
    fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA]
    return F.struct(*fields).alias("metadata")


def chunk_parts(parts: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """Text chunks of the contract, with ``path`` and ``ordinal`` for ordering."""
    # what is the same for all chunks of a part is made before there are several of it
    pieces = parts.withColumn("_slug", slug(F.col("stem"))).select("*", _pieces(size, overlap))
    return pieces.withColumn("_body", strip(F.col("_piece"))).where("_body != ''").select(*_chunk_columns())


@built_once
def _pieces(size: int, overlap: int) -> Column:
    return F.posexplode(chunk_texts(F.col("section_text"), size, overlap)).alias("_pos", "_piece")


@built_once
def _chunk_columns() -> list[Column]:
    body, number = F.col("_body"), (F.col("_pos") + 1).cast("string")
    title = F.when(F.col("section_title") != "", F.col("section_title")).otherwise(stem_title(F.col("stem")))
    return [
        F.col("path"),
        (F.col("section_no") * 1_000_000 + F.col("_pos")).cast("long").alias("ordinal"),
        F.concat(
            "_slug", F.lit("_p"), F.col("page_number").cast("string"), F.lit("_c"),
            F.lpad(number, F.greatest(F.lit(2), F.length(number)), F.lit("0")),
        ).alias("chunk_id"),
        F.col("document_name"),
        F.col("document_type"),
        F.col("page_number"),
        title.alias("section_title"),
        F.lit("text").alias("modality"),
        body.alias("content"),
        F.lit(None).cast("string").alias("media_path"),
        F.lit(None).cast("string").alias("caption"),
        _metadata(
            source_reliability=F.col("source_reliability"), source_category=F.col("source_category"), file_path=F.col("document_name"),
            word_count=word_count(body), char_count=F.length(body), is_ocr=F.col("is_ocr"),
        ),
    ]


def figure_chunks(files: DataFrame, plates: list[Plate] = (), media_root: str = "data/extracted_media/figures") -> DataFrame:
    """Chunks of standalone images: first file per stem, at least 100 x 100 pixels."""
    sized = files.where(F.col("suffix").isin(IMAGE_SUFFIXES)).select("path", "document_name", "stem", "suffix", "content")
    sized = sized.mapInPandas(binary.image_sizes, binary.IMAGE_SCHEMA)
    first = sized.groupBy("stem").agg(F.min_by(F.struct("document_name", "suffix", "width", "height"), "path").alias("f"), F.min("path").alias("path"))
    rows = first.select("stem", "path", "f.*").where((F.col("width") >= 100) & (F.col("height") >= 100))
    rows = rows.withColumn("figure", F.coalesce(match_plate(F.col("stem"), plates), describe_figure(F.col("stem"))))
    return rows.select(
        "path",
        F.lit(0).cast("long").alias("ordinal"),
        F.concat(F.lit("fig_"), slug(F.col("stem"))).alias("chunk_id"),
        "document_name",
        F.when(F.col("suffix") == ".png", "png").otherwise("jpg").alias("document_type"),
        F.lit(1).alias("page_number"),
        F.col("figure.title").alias("section_title"),
        F.lit("image-caption").alias("modality"),
        F.col("figure.content").alias("content"),
        F.concat(F.lit(f"{media_root}/"), slug(F.col("stem")), F.col("suffix")).alias("media_path"),
        F.col("figure.caption").alias("caption"),
        _metadata(
            source_reliability=source_reliability(F.col("path")),
            source_category=F.when(F.contains("stem", F.lit("plate_")), "codex").otherwise("wiki"),
            file_path=F.col("document_name"), dimensions=F.array("width", "height"), related_entities=F.col("figure.entities"),
        ),
    )


def _extras(chunks: DataFrame, kind: int) -> DataFrame:
    """Chunks of PDF extras in the shape of ``chunk_parts``."""
    rest = {c: F.col(c) for c in ("dimensions", "table_dimensions", "related_entities") if c in chunks.columns}
    path = F.col("document_name")
    return chunks.select(
        path.alias("path"), F.lit(kind).cast("long").alias("ordinal"),
        *[F.col(f.name) for f in CHUNK if f.name != "metadata"],
        _metadata(source_reliability=source_reliability(path), source_category=source_category(path), file_path=path, **rest),
    )


def read_corpus(
    spark: SparkSession,
    root: str,
    plates: list[Plate] = (),
    pages: DataFrame | None = None,
    images: DataFrame | None = None,
    grids: DataFrame | None = None,
) -> DataFrame:
    """All chunks below ``root``: figures first, then documents by path, ids made unique.

    What a caller's PDF reader found joins as rows: ``pages(path, page_number, text,
    is_ocr)``, and the ``images`` and ``grids`` of ``pdf_extras``.  Every file is read
    once; the union is stored before ids are compared."""
    parts = markdown_parts(scan_files(spark, root, MARKDOWN_SUFFIXES))
    parts = parts.unionByName(text_parts(scan_files(spark, root, [".txt"])))
    parts = parts.unionByName(docx_parts(scan_files(spark, root, [".docx"])))
    if pages is not None:
        parts = parts.unionByName(pdf_parts(pages))
    found = figure_chunks(scan_files(spark, root, IMAGE_SUFFIXES), plates).withColumn("kind", F.lit(0))
    found = found.unionByName(chunk_parts(parts).withColumn("kind", F.lit(1)))
    if images is not None:
        found = found.unionByName(_extras(embedded_figures(images, plates), 0).withColumn("kind", F.lit(2)))
    if grids is not None:
        found = found.unionByName(_extras(table_chunks(grids), 0).withColumn("kind", F.lit(3)))
    return _identified(found)


def _identified(found: DataFrame) -> DataFrame:
    """Chunks with unique ids, by kind, path and ordinal."""
    # rows of one file that share an id are told apart by title and content
    rows = checkpointed(found.withColumn("digest", F.xxhash64("section_title", "content", "caption")))
    row = Window.partitionBy("chunk_id", "kind", "path", "ordinal", "digest").orderBy("document_name")
    rows = rows.withColumn("copy", F.row_number().over(row))
    return unique_ids(rows, ["kind", "path", "ordinal", "digest", "copy"]).drop("kind", "path", "ordinal", "digest", "copy")


def chunk_files(files: DataFrame, plates: list[Plate] = ()) -> DataFrame:
    """The chunks that ``read_corpus`` makes of ``files(path, content)``."""
    # a scan plans small files as large ones, so thousands of them are thousands of tasks in each step;
    # its first tasks have the largest files, which are dealt out
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = 2 * cores
    rows = checkpointed(_named(files.coalesce(4 * cores), DOCUMENT_SUFFIXES).repartition(tasks, "path"))
    # to plan a format and start its Python workers takes as long for no file as for some
    suffixes = {r[0] for r in rows.select("suffix").distinct().collect()}
    readers = [(MARKDOWN_SUFFIXES, markdown_parts), ([".txt"], text_parts), ([".docx"], docx_parts)]
    parts = [read(rows) for own, read in readers if suffixes & {*own}] or [text_parts(rows)]
    # above a coalesce, the chunks of all formats are one expression, evaluated by one set of tasks
    found = chunk_parts(reduce(DataFrame.unionByName, parts).coalesce(tasks)).withColumn("kind", F.lit(1))
    if suffixes & {*IMAGE_SUFFIXES}:
        found = figure_chunks(rows, plates).withColumn("kind", F.lit(0)).unionByName(found)
    return _identified(found)


def ingest(spark: SparkSession, root: str, catalog: DataFrame | None = None, **given) -> tuple[DataFrame, DataFrame]:
    """(chunks, violations) of ``read_corpus`` on ``root``, the chunks stored once."""
    chunks = checkpointed(read_corpus(spark, root, **given))
    return chunks, validate_table(chunks, catalog)


def unreadable_files(spark: SparkSession, root: str, pages: DataFrame | None = None) -> DataFrame:
    """(path, error) of files that no reader could open, and of PDFs without ``pages``."""
    broken = scan_files(spark, root, [".docx"]).select("path", "document_name", "stem", "content")
    docx = broken.mapInPandas(binary.docx_errors, "path string, error string")
    pdf = scan_files(spark, root, [".pdf"]).select("path")
    if pages is not None:
        pdf = pdf.join(pages.select("path").distinct(), "path", "left_anti")
    return docx.unionByName(pdf.withColumn("error", F.lit("pdf: no pages given")))
