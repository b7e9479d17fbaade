"""Prompts, grounded answers, citation and image clean-up.

Works on one row per question whose ``context`` is the array of its packed
chunks in rank order: a handful of structs, so everything is row-local.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.functions.paths import file_name
from folioscope.functions.text import let, strip, title_case
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.media import IMAGE_TAG, resolve_media
from folioscope.operators.query_features import scope_guard

CHUNK_TAG = r"(?i)(?:\[|【)\s*Chunk\s*(\d+)\s*(?:,\s*Page\s*(\d+))?\s*(?:\]|】)"
DOCUMENT_TAG = r"(?i)\[Document:\s*([^,\]]+),\s*Page\s*(\d+)\]"
BROKEN_IMAGE = r"!\[[^\]]*\]\([^)]*$"
CONTEXT_COLUMNS = [
    "rank", "chunk_id", "document_name", "page_number", "section_title", "modality", "content", "media_path",
    "caption", "source_reliability", "raw_similarity", "resolved_media",
]


def with_context(queries: DataFrame, packed: DataFrame) -> DataFrame:
    """Attach the packed chunks (at most the budget per query) as ``context``."""
    rows = packed if "resolved_media" in packed.columns else packed.withColumn("resolved_media", F.lit(None).cast("string"))
    per_query = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*CONTEXT_COLUMNS))).alias("context"))
    return queries.join(per_query, "query_id", "left")


def _filled(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))) > 0


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def cite(chunk: Column) -> Column:
    """``[document, Page n]``."""
    return F.concat(
        F.lit("["), F.coalesce(chunk["document_name"], F.lit("Archive Record")), F.lit(", Page "),
        F.coalesce(chunk["page_number"], F.lit(1)).cast("string"), F.lit("]"),
    )


def context_prompt(question: Column, context: Column, aggregates: Column | None = None) -> Column:
    """Numbered context blocks, contents cut at 450 characters, then aggregates."""
    # The headings and separators of the prompt below.

    def block(c: Column, i: Column) -> Column:
        head = F.concat(
            F.lit("\n--- [Chunk "), (i + 1).cast("string"), F.lit("] Source: "), F.coalesce(c["document_name"], F.lit("Unknown")),
            F.lit(" (Page "), F.coalesce(c["page_number"], F.lit(1)).cast("string"), F.lit(") | Modality: "),
            F.coalesce(c["modality"], F.lit("text")), F.lit(" | Reliability: "),
            F.when(_filled(c["source_reliability"]), c["source_reliability"]).otherwise("archive_record"),
            F.when(_filled(c["section_title"]), F.concat(F.lit(" | Section: "), c["section_title"])).otherwise(""),
        )
        body = strip(_text(c["content"]))
        cut = F.when(F.length(body) > 450, F.concat(F.substring(body, 1, 450), F.lit("... [trimmed]"))).otherwise(body)
        return F.concat_ws(
            "\n",
            head,
            F.when(_filled(c["media_path"]), F.concat(F.lit("Media Path: "), F.replace(c["media_path"], F.lit("\\"), F.lit("/")))),
            F.when(_filled(c["caption"]), F.concat(F.lit("Caption: "), c["caption"])),
            F.concat(F.lit("Content:\n"), cut),
        )

    def metric(a: Column) -> Column:
        return F.concat(
            F.lit("- Metric '"), a["column"], F.lit("': Total Sum = "), a["sum_value"].cast("string"),
            F.lit(", Average = "), a["avg_value"].cast("string"), F.lit(", Count = "), a["n_values"].cast("string"),
        )

    asked = F.concat(F.lit("User Query: "), question)
    tail = F.lit(None).cast("string")
    if aggregates is not None:
        tail = F.when(
            F.size(aggregates) > 0,
            F.concat(F.lit("\n--- [Computed Quantitative Aggregates] ---\n"), F.array_join(F.transform(aggregates, metric), "\n")),
        )
    full = F.concat_ws(
        "\n", F.concat(asked, F.lit("\n\nRetrieved Archive Context Chunks:")), F.array_join(F.transform(context, block), "\n"), tail
    )
    return F.when(F.coalesce(F.size(context), F.lit(0)) > 0, full).otherwise(
        F.concat(asked, F.lit("\n\nNo relevant context chunks retrieved from the archive."))
    )


def no_information(question: Column) -> Column:
    return F.concat(F.lit(L.NO_INFORMATION), question, F.lit("'."))


def with_grounded_answer(rows: DataFrame, name: str = "answer") -> DataFrame:
    """Add a deterministic answer: a figure, else a table, else text passages.

    ``rows(question, context, aggregates)``; parts shared by several phrases are
    columns of their own, so the expressions stay small.
    """
    context, figure, grid = F.col("context"), F.col("_figure"), F.col("_grid")
    main, second, title = F.col("_main"), F.col("_second"), F.col("_title")
    top = F.get(context, F.lit(0))["raw_similarity"]
    similarity = F.coalesce(F.when(top != 0, top), F.lit(1.0))
    long_ones = F.filter(context, lambda c: F.length(strip(_text(c["content"]))) > 60)
    shown = strip(F.regexp_replace(title, r"(?i)^(figure plate|figure|plate):\s*", ""))
    visual = F.concat_ws(
        "\n",
        F.concat(F.lit("### Figure record\nAs documented in "), F.col("_figure_cite"), F.lit(":\n")),
        _text(figure["content"]),
        F.when(
            figure["resolved_media"].isNotNull(),
            F.concat(
                F.lit("\n\n!["), title, F.lit("]("), figure["resolved_media"], F.lit(")\n\n*Figure: "), shown,
                F.lit(" — Source: "), F.col("_figure_cite"), F.lit("*"),
            ),
        ),
    )
    tabular = F.concat(F.lit("### Table record\nAs documented in "), cite(grid), F.lit(":\n\n"), _text(grid["content"]))
    more, said = F.col("_more"), strip(_text(main["content"]))
    prose = F.concat_ws(
        "\n",
        F.concat(F.lit("### Findings\nAs documented in "), cite(main), F.lit(":\n")),
        said,
        F.when(
            (more != "") & (more != said),
            F.concat(
                F.lit("\n\n### Further evidence\nAlso recorded in "), cite(second), F.lit(":\n"),
                F.element_at(F.split(more, "\n\n"), 1),
            ),
        ),
    )
    conflicts = F.when(
        F.size("_doubtful") > 0,
        F.concat(
            F.lit("\n\n**Conflicting sources:**\n"),
            F.array_join(
                F.transform(
                    "_doubtful",
                    lambda c: F.concat(
                        F.lit("- *Less reliable account* "), cite(c), F.lit(': "'),
                        F.substring(_text(c["content"]), 1, 120), F.lit('..."'),
                    ),
                ),
                "\n",
            ),
        ),
    )

    def total(a: Column) -> Column:
        return F.concat(
            F.lit("- **"), title_case(a["column"]), F.lit(" Total**: Sum = `"), a["sum_value"].cast("string"),
            F.lit("`, Average = `"), a["avg_value"].cast("string"), F.lit("` (across "),
            a["n_values"].cast("string"), F.lit(" records)"),
        )

    totals = F.when(
        F.size("aggregates") > 0,
        F.concat(F.lit("\n\n**Table totals:**\n"), F.array_join(F.transform("aggregates", total), "\n")),
    )
    found = F.coalesce(F.size(context), F.lit(0)) > 0
    body = F.when(figure.isNotNull(), visual).when(grid.isNotNull(), tabular).otherwise(prose)
    staged = {
        "_figure": F.try_element_at(
            F.filter(context, lambda c: (c["modality"] == "image-caption") | _filled(c["media_path"])), F.lit(1)
        ),
        "_grid": F.try_element_at(F.filter(context, lambda c: c["modality"] == "table"), F.lit(1)),
        "_long": long_ones,
        "_doubtful": F.filter(F.slice(context, 2, 2), lambda c: c["source_reliability"].isin(L.CONFLICTING_RELIABILITY)),
    }
    passages = F.when(F.size("_long") > 0, F.col("_long")).otherwise(context)
    caption, content = figure["caption"], figure["content"]
    read = {
        "_main": F.get(passages, F.lit(0)),
        "_second": F.get(passages, F.lit(1)),
        "_more": strip(_text(F.get(passages, F.lit(1))["content"])),
        "_figure_cite": cite(figure),
        "_title": F.when(_filled(caption), caption).when(_filled(content), content).otherwise(F.lit("Archive figure")),
    }
    return (
        rows.withColumns(staged)
        .withColumns(read)
        .withColumn(
            name,
            F.when(found & (similarity >= 0.25), F.concat_ws("\n", body, conflicts, totals)).otherwise(
                no_information(F.col("question"))
            ),
        )
        .drop(*staged, *read)
    )


def weave(text: Column, pattern: str, tag: Callable[[Column], Column]) -> Column:
    """Replace the i-th match of ``pattern`` by ``tag(i)``."""
    return let(
        F.split(text, pattern, -1),
        lambda parts: F.array_join(
            F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, tag(i))).otherwise(p)), ""
        ),
    )


def normalize_citations(text: Column, context: Column) -> Column:
    """``[Chunk N]`` and ``[Document: d, Page n]`` to ``[d, Page n]``; cite chunk 1 if nothing is cited."""
    numbers, pages, tags = [F.regexp_extract_all(text, F.lit(CHUNK_TAG), F.lit(i)) for i in (1, 2, 0)]

    def reference(t: Column, i: Column) -> Column:
        chunk = F.get(context, F.get(t["numbers"], i).try_cast("int") - 1)
        stated = F.get(t["pages"], i)
        page = F.when(stated != "", stated).otherwise(F.coalesce(chunk["page_number"], F.lit(1)).cast("string"))
        name = F.coalesce(chunk["document_name"], F.lit("Archive Record"))
        return F.when(chunk.isNull(), F.get(t["tags"], i)).otherwise(F.concat(F.lit("["), name, F.lit(", Page "), page, F.lit("]")))

    # The tags are listed once, outside the loop over the text's parts.
    listed = F.struct(numbers.alias("numbers"), pages.alias("pages"), tags.alias("tags"))
    woven = let(listed, lambda t: weave(text, CHUNK_TAG, lambda i: reference(t, i)))
    plain = F.translate(F.regexp_replace(woven, DOCUMENT_TAG, r"[$1, Page $2]"), "\u202f\u00a0", "  ")

    def sourced(done: Column) -> Column:
        cited = F.exists(
            context,
            lambda c: _filled(c["document_name"])
            & F.contains(done, F.concat(F.lit("["), c["document_name"], F.lit(", Page"))),
        )
        added = F.concat(F.regexp_replace(done, r"(?U)\s+$", ""), F.lit("\n\nSource: "), cite(F.get(context, F.lit(0))))
        return F.when(cited, done).otherwise(added)

    usable = _filled(text) & (F.coalesce(F.size(context), F.lit(0)) > 0)
    return F.when(usable, let(plain, sourced)).otherwise(text)


def fix_media(answers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Repair image tags of ``answers(query_id, answer, context)``; add a figure if none is left.

    Paths resolve through the catalog; failing that, a context chunk with the
    same file name lends its file.
    """
    paths = F.regexp_extract_all("answer", F.lit(IMAGE_TAG), F.lit(2))
    resolved = resolve_media(
        answers.select(F.explode(paths).alias("media_path")), catalog
    )
    known = (
        answers.select("query_id", F.posexplode(paths).alias("i", "media_path"))
        .join(resolved, "media_path")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("i", "resolved"))).alias("_known"))
    )
    alts, raw, tags = [F.regexp_extract_all("answer", F.lit(IMAGE_TAG), F.lit(i)) for i in (1, 2, 0)]

    def tag(i: Column) -> Column:
        own = F.try_element_at(F.filter("_known", lambda k: k["i"] == i), F.lit(1))["resolved"]
        twin = F.try_element_at(
            F.filter(
                "context",
                lambda c: c["resolved_media"].isNotNull() & (file_name(c["media_path"]) == file_name(F.get(raw, i))),
            ),
            F.lit(1),
        )
        alt = F.when(F.get(alts, i) != "", F.get(alts, i)).otherwise(F.coalesce(twin["caption"], F.lit("Figure")))
        return (
            F.when(own.isNotNull(), F.concat(F.lit("!["), F.get(alts, i), F.lit("]("), own, F.lit(")")))
            .when(twin.isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), twin["resolved_media"], F.lit(")")))
            .otherwise(F.get(tags, i))
        )

    figure = F.try_element_at(F.filter("context", lambda c: c["resolved_media"].isNotNull()), F.lit(1))
    title = (
        F.when(_filled(figure["caption"]), figure["caption"])
        .when(_filled(figure["section_title"]), figure["section_title"])
        .otherwise(F.lit("Archive figure"))
    )
    added = F.concat(
        F.lit("\n\n!["), title, F.lit("]("), figure["resolved_media"], F.lit(")\n*Figure: "), title, F.lit(" — "), cite(figure), F.lit("*")
    )
    return (
        answers.join(known, "query_id", "left")
        .withColumn("answer", strip(F.regexp_replace(weave(F.col("answer"), IMAGE_TAG, tag), BROKEN_IMAGE, "")))
        .withColumn(
            "answer",
            F.when(~F.rlike("answer", F.lit(IMAGE_TAG)) & figure.isNotNull(), F.concat("answer", added)).otherwise(F.col("answer")),
        )
        .drop("_known")
    )


def answer_gate(question: Column, context: Column, is_in_domain: Column, is_sufficient: Column, lex: Lexicon = DEFAULT) -> Column:
    """Reply that ends the request early, or null when an answer is due.

    Order: blank, scope, nothing retrieved, out of domain, insufficient evidence.
    """
    guard = scope_guard(question, lex)
    return (
        F.when(guard["is_handled"], guard["message"])
        .when(F.coalesce(F.size(context), F.lit(0)) <= 0, L.NOT_IN_ARCHIVE)
        .when(~F.coalesce(is_in_domain, F.lit(False)), L.NOT_IN_ARCHIVE)
        .when(~F.coalesce(is_sufficient, F.lit(False)), no_information(question))
    )
