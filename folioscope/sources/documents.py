"""Sections of Markdown and plain-text files, as expressions over their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import LINE_BREAK, built_once, let, strip, title_case

HEADER = r"^(#{1,6})(?U)\s+(.+)$"


def stem_title(stem: Column) -> Column:
    return title_case(F.replace(stem, F.lit("_"), F.lit(" ")))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Explode ``files(stem, text, ...)`` into section_no, section_title, section_text.

    A header line closes the section before it; titles are breadcrumbs of the
    open headers.  A file of headers only becomes one section of its whole text.
    """
    return files.select(*files.columns, F.posexplode(_sections()).alias("_pos", "_part")).select(
        *files.columns, (F.col("_pos") + 1).alias("section_no"), "_part.section_title", "_part.section_text"
    )


@built_once
def _sections() -> Column:
    """The sections of a file, by its columns stem and text."""
    # Every shared part is bound by ``let``: a plain column used once inside a
    # lambda would be inlined there and evaluated for every element.

    def headers(lines: Column) -> Column:
        marks = F.transform(lines, lambda l, i: F.when(F.startswith(l, F.lit("#")) & l.rlike(HEADER), i + 1))
        return F.transform(
            F.array_compact(marks),
            lambda at: let(
                F.get(lines, at - 1),
                lambda l: F.struct(
                    at.alias("at"),
                    F.length(F.regexp_extract(l, HEADER, 1)).alias("level"),
                    strip(F.regexp_extract(l, HEADER, 2)).alias("title"),
                ),
            ),
        )

    def breadcrumbs(heads: Column) -> Column:
        """The path of open headers after every header."""
        start = F.struct(
            F.filter(heads, lambda _: F.lit(False)).alias("open"), F.array().cast("array<string>").alias("crumbs")
        )

        def step(acc: Column, h: Column) -> Column:
            still = F.concat(F.filter(acc["open"], lambda x: x["level"] < h["level"]), F.array(h))
            return let(
                still,
                lambda open_: F.struct(
                    open_.alias("open"),
                    F.concat(
                        acc["crumbs"], F.array(F.array_join(F.transform(open_, lambda x: x["title"]), " > "))
                    ).alias("crumbs"),
                ),
            )

        return F.aggregate(heads, start, step, lambda a: a["crumbs"])

    def sections(lines: Column, heads: Column, crumbs: Column) -> Column:
        def part(title: Column, first: Column, next_head: Column) -> Column:
            last = F.coalesce(F.get(heads, next_head)["at"] - 1, F.size(lines))
            body = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
            return F.struct(title.alias("section_title"), strip(body).alias("section_text"))

        title = stem_title(F.col("stem"))
        found = F.concat(
            F.array(part(title, F.lit(1), F.lit(0))),
            F.transform(heads, lambda h, i: part(F.get(crumbs, i), h["at"] + 1, i + 1)),
        )
        last_title = F.coalesce(F.try_element_at(crumbs, F.lit(-1)), title)
        whole = F.array(F.struct(last_title.alias("section_title"), strip(F.col("text")).alias("section_text")))

        def filled(parts: Column) -> Column:
            return F.filter(parts, lambda x: x["section_text"] != "")

        return let(filled(found), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(filled(whole)))

    return let(
        F.split("text", LINE_BREAK),
        lambda lines: let(
            headers(lines), lambda heads: let(breadcrumbs(heads), lambda crumbs: sections(lines, heads, crumbs))
        ),
    )


# Tags that don't end a paragraph, and characters written as entities ("&amp;" last).
INLINE_TAGS = "a|b|br|i|em|strong|span|u"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def page_text(html: Column) -> Column:
    """Headings (h1, as "# ...") and paragraphs (p) of a web page, one a line.

    An element reaches to the next tag that isn't an inline one, closed or not. Comments,
    scripts and styles are left out, inline tags dropped, a line break becomes a space.
    Of the entities, those of ENTITIES are decoded."""
    shown = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    found = F.regexp_extract_all(shown, F.lit(rf"(?is)<(?:h1|p)(?:\s[^>]*)?>[^<]*+(?:</?(?:{INLINE_TAGS})\b[^>]*>[^<]*+)*+"), F.lit(0))

    def line(element: Column) -> Column:
        spaced = F.regexp_replace(element, r"(?i)<br\b[^>]*>|[\n\r]", " ")
        text = F.regexp_replace(spaced, r"<[^>]*>", "")
        for entity, char in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(char))
        return F.concat(F.when(element.rlike("(?i)^<h1"), "# ").otherwise(""), text)

    return F.array_join(F.transform(found, line), "\n")


def text_title(stem: Column, text: Column) -> Column:
    """Readable stem, plus the first shouted line among the first five."""
    first = F.transform(F.slice(F.split(text, LINE_BREAK, 6), 1, 5), strip)
    shouted = F.try_element_at(
        F.filter(
            first,
            lambda l: (F.upper(l) == l) & (F.lower(l) != l) & (F.length(l) > 3) & (F.length(l) < 70),
        ),
        F.lit(1),
    )
    return F.concat(stem_title(stem), F.when(shouted.isNotNull(), F.concat(F.lit(" > "), shouted)).otherwise(""))
