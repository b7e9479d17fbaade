"""Tables and figures found inside PDFs, from extracted grids and image lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.paths import stem
from folioscope.functions.tables import format_markdown_table
from folioscope.functions.text import LINE_BREAK, slug, strip
from folioscope.operators.media import Plate, match_plate
from folioscope.sources.documents import stem_title


def is_scan_name(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit(".scan.")) | F.contains(F.lower(name), F.lit("_scan"))


def _page_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_BREAK), strip), lambda l: l != "")


def _two(n: Column) -> Column:
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(2), F.length(s)), F.lit("0"))


def table_chunks(grids: DataFrame) -> DataFrame:
    """Table chunks of ``grids(document_name, page_number, table_no, page_text, grid)``."""
    readable = stem_title(stem(F.col("document_name")))
    heading = F.try_element_at(
        F.filter(
            F.slice(_page_lines(F.col("page_text")), 1, 3),
            lambda l: (F.length(l) > 3) & ~F.startswith(l, F.lit("Plate")) & ~F.endswith(l, F.lit(".")),
        ),
        F.lit(1),
    )
    header = F.filter(F.transform(F.get("grid", F.lit(0)), strip), lambda c: (c != "") & (F.length(c) < 40))
    rows = grids.where(~is_scan_name(F.col("document_name"))).withColumn("content", format_markdown_table(F.col("grid")))
    rows = rows.where(strip(F.col("content")) != "").withColumn("section_title", F.concat_ws(" > ", readable, heading))
    return rows.select(
        F.concat(slug(stem(F.col("document_name"))), F.lit("_p"), _two(F.col("page_number")), F.lit("_tab"), _two(F.col("table_no"))).alias("chunk_id"),
        "document_name",
        F.lit("pdf").alias("document_type"),
        "page_number",
        "section_title",
        F.lit("table").alias("modality"),
        "content",
        F.lit(None).cast("string").alias("media_path"),
        F.concat(
            F.lit("Data Table: "), F.col("section_title"), F.lit(" (Page "), F.col("page_number").cast("string"),
            F.lit(", Table "), F.col("table_no").cast("string"), F.lit(")"),
        ).alias("caption"),
        F.array(F.size("grid"), F.array_max(F.transform("grid", F.size))).alias("table_dimensions"),
        # Sorted, so that the five kept names do not depend on chance.
        F.slice(F.array_sort(F.array_distinct(F.concat(F.array(readable), F.coalesce(header, F.array())))), 1, 5).alias("related_entities"),
    )


def embedded_figures(images: DataFrame, plates: list[Plate] = ()) -> DataFrame:
    """Figure chunks of ``images(document_name, page_number, image_no, page_text, width,
    height, n_bytes, ext)``; icons are dropped before the figures are numbered."""
    lines = _page_lines(F.col("page_text"))
    label = F.element_at(
        F.concat(F.array(F.lit("")), F.filter(lines, lambda l: F.startswith(l, F.lit("Plate -")) | F.startswith(l, F.lit("Plate:")))), -1
    )
    big = images.where(
        ~is_scan_name(F.col("document_name")) & (F.col("width") >= 100) & (F.col("height") >= 100) & (F.col("n_bytes") >= 1024)
    )
    on_page = Window.partitionBy("document_name", "page_number").orderBy("image_no")
    rows = big.withColumn("fig", F.row_number().over(on_page)).withColumn("label", label)
    # The title is the last plain line before the first plate label.
    before = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("seen"), stem_title(stem(F.col("document_name"))).alias("title")),
        lambda a, l: F.struct(
            (a["seen"] | F.startswith(l, F.lit("Plate -")) | F.startswith(l, F.lit("Plate:"))).alias("seen"),
            F.when(
                ~a["seen"] & ~F.startswith(l, F.lit("Plate -")) & ~F.startswith(l, F.lit("Plate:")) & (F.length(l) > 3) & ~F.endswith(l, F.lit(".")), l
            ).otherwise(a["title"]).alias("title"),
        ),
        lambda a: a["title"],
    )
    rows = rows.withColumn("title", before)
    rows = rows.withColumn("plate", F.coalesce(match_plate(F.col("label"), plates), match_plate(F.col("title"), plates)))
    name = F.concat(slug(stem(F.col("document_name"))), F.lit("_p"), _two(F.col("page_number")), F.lit("_fig"), _two(F.col("fig")))
    caption = F.when(F.col("label") != "", F.col("label")).otherwise(
        F.concat(F.lit("Figure Plate "), F.col("fig").cast("string"), F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")"))
    )
    plain = F.concat(
        F.lit("Figure from "), F.col("document_name"), F.lit(" on page "), F.col("page_number").cast("string"), F.lit(".\n"), caption,
        F.lit("\nContext: "), F.array_join(F.slice(lines, 1, 4), " "),
    )
    return rows.select(
        name.alias("chunk_id"),
        "document_name",
        F.lit("pdf").alias("document_type"),
        "page_number",
        F.coalesce("plate.title", "title").alias("section_title"),
        F.lit("image-caption").alias("modality"),
        F.coalesce("plate.content", plain).alias("content"),
        F.concat(F.lit("data/extracted_media/figures/"), name, F.lit("."), F.col("ext")).alias("media_path"),
        F.coalesce("plate.caption", caption).alias("caption"),
        F.array("width", "height").alias("dimensions"),
        F.coalesce("plate.entities", F.array("title")).alias("related_entities"),
    )
