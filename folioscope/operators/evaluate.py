"""Answer-quality metrics, one row per question, and their summary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope import lexicon as L
from folioscope.functions.text import LINE_BREAK, contains_any, in_list, let, lower_text, strip
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.media import IMAGE_TAG
from folioscope.session import checkpointed

# What counts as a citation, a year, a grouped number, a name, a table.
CITATION = r"\[([A-Za-z0-9_\-.\s]+?)(?:,\s*(?:Page|page|P\.|p\.)?\s*(\d+))?\]"
YEAR = r"(?U)\b(1\d{3}|20\d{2})\b"
GROUPED_NUMBER = r"(?U)\b\d{1,3}(?:,\d{3})+\b"
PROPER_NOUN = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"
TABLE_DIVIDER = r"\|(?:\s*[-:]+[-| :]*)\|"


def _found(context: Column) -> Column:
    return F.coalesce(F.size(context), F.lit(0)) > 0


def retrieval_precision(question: Column, context: Column, target: Column, lex: Lexicon = DEFAULT) -> Column:
    """Some chunk contains some content word; figures also need a figure chunk."""
    asked = F.filter(
        F.transform(F.regexp_extract_all(question, F.lit(r"(?U)\b[A-Za-z]{3,}\b"), F.lit(0)), F.lower),
        lambda w: ~in_list(w, lex.evaluation_stop),
    )
    hit = let(
        asked,
        lambda ws: F.exists(
            context,
            lambda c: let(
                lower_text(c["content"], c["document_name"], c["caption"]),
                lambda t: F.exists(ws, lambda w: F.contains(t, w)),
            ),
        ),
    )
    figure = F.exists(
        context, lambda c: (c["modality"] == "image-caption") | (F.length(F.coalesce(c["media_path"], F.lit(""))) > 0)
    )
    return F.coalesce(_found(context) & hit & ((target != "image-caption") | figure), F.lit(False))


def citation_accuracy(answer: Column, context: Column, strict: bool = False) -> Column:
    """A cited name contains or is contained in a retrieved document's name.

    ``strict`` also demands that a stated page is the retrieved one.
    """
    cited = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    pages = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(2))

    def supports(c: Column, name: Column, page: Column) -> Column:
        document = F.lower(F.coalesce(c["document_name"], F.lit("")))
        related = (document != "") & (F.contains(document, name) | F.contains(name, document))
        if strict:
            related = related & ((page == "") | (page == c["page_number"].cast("string")))
        return related

    pairs = F.arrays_zip(cited.alias("name"), pages.alias("page"))
    good = F.exists(
        pairs,
        lambda p: F.exists(
            F.coalesce(context, F.array()),
            lambda c: supports(c, F.lower(strip(p["name"])), p["page"]),
        ),
    )
    return F.when(F.size(cited) == 0, F.contains(F.lower(answer), F.lit("not specify"))).otherwise(F.coalesce(good, F.lit(False)))


def hallucination(answer: Column, context: Column) -> Column:
    """True if a year, a grouped number or too many names lack support."""
    facts = lower_text(
        F.array_join(
            F.transform(context, lambda c: F.concat_ws(" ", *[F.coalesce(c[k], F.lit("")) for k in ("document_name", "caption", "section_title", "content")])),
            " ",
        )
    )
    refused = contains_any(F.lower(answer), L.REFUSAL_MARKERS)
    years = F.regexp_extract_all(answer, F.lit(YEAR), F.lit(1))
    numbers = F.regexp_extract_all(answer, F.lit(GROUPED_NUMBER), F.lit(0))
    bad_year = let(facts, lambda f: F.exists(years, lambda y: ~F.contains(f, y)))
    bad_number = let(
        facts,
        lambda f: let(
            F.replace(f, F.lit(","), F.lit("")),
            lambda bare: F.exists(
                numbers, lambda n: ~F.contains(f, n) & ~F.contains(bare, F.replace(n, F.lit(","), F.lit("")))
            ),
        ),
    )
    openers = F.array(*[F.lit(o) for o in L.EVALUATION_SKIPPED_OPENERS])
    prose = F.array_join(
        F.filter(
            F.split(answer, LINE_BREAK),
            lambda l: ~F.exists(openers, lambda o: F.startswith(strip(l), o)),
        ),
        " ",
    )
    names = F.filter(
        F.regexp_extract_all(prose, F.lit(PROPER_NOUN), F.lit(0)), lambda n: ~in_list(n, L.EVALUATION_STOP_ENTITIES)
    )

    def mostly_unsupported(ns: Column, f: Column) -> Column:
        unsupported = F.filter(
            ns,
            lambda n: ~F.exists(F.split(n, r"(?U)\s+"), lambda t: (F.length(t) > 3) & F.contains(f, F.lower(t))),
        )
        return (F.size(ns) >= 3) & (F.size(unsupported) / F.greatest(F.size(ns), F.lit(1)) > 0.35)

    bad_names = let(facts, lambda f: let(names, lambda ns: mostly_unsupported(ns, f)))
    return (
        F.when(refused, False)
        .when(~_found(context) & (F.length(strip(answer)) > 30), True)
        .otherwise(F.coalesce(bad_year | bad_number | bad_names, F.lit(False)))
    )


def modality_success(answer: Column, context: Column, target: Column, resolved_images: Column) -> Column:
    """Figures: a resolvable image in answer or context; tables: a real grid; text passes.

    ``resolved_images`` says whether some image tag of the answer resolves.
    """
    figure = resolved_images | F.exists(
        context, lambda c: (c["modality"] == "image-caption") & c["resolved_media"].isNotNull()
    )
    pipes = F.length(answer) - F.length(F.replace(answer, F.lit("|"), F.lit("")))
    grid = (answer.rlike(TABLE_DIVIDER) & (pipes >= 6)) | F.exists(
        context, lambda c: (c["modality"] == "table") & F.contains(F.coalesce(c["content"], F.lit("")), F.lit("|"))
    )
    return F.coalesce(F.when(target == "image-caption", figure).when(target == "table", grid).otherwise(True), F.lit(False))


def has_image_tag(answer: Column) -> Column:
    return answer.rlike(IMAGE_TAG)


def counts_for_modality(qid: Column, target: Column) -> Column:
    return target.isin("image-caption", "table") | F.startswith(qid, F.lit("1a_"))


def _percent(hits: Column, total: Column, when_none: float) -> Column:
    return F.when(total > 0, rounded(hits / total * 100, 1)).otherwise(F.lit(when_none))


def exact_percentiles(values: DataFrame, shares: list[float], rows_per_task: int = 1 << 20) -> list[float | None]:
    """Linear percentiles of the one column of ``values`` (nulls left out).

    Rows are range partitioned and counted by partition, which places every wanted
    rank; only the two rows around each rank leave the tasks."""
    name = values.columns[0]
    known = values.where(F.col(name).isNotNull()).select(F.col(name).cast("double").alias("v"))
    total = known.count()
    if not total:
        return [None] * len(shares)
    placed = checkpointed(known.repartitionByRange(-(-total // rows_per_task), "v").withColumn("part", F.spark_partition_id()))
    ranked = placed.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("v")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    spots = [(total - 1) * p for p in shares]
    wanted = sorted({int(f(s)) for s in spots for f in (math.floor, math.ceil)})
    rank = F.col("start") + F.col("at") - 1
    found = {r["rank"]: r["v"] for r in ranked.join(F.broadcast(starts), "part").where(rank.isin(wanted)).select(rank.alias("rank"), "v").collect()}
    return [found[math.floor(s)] + (found[math.ceil(s)] - found[math.floor(s)]) * (s - math.floor(s)) for s in spots]


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row of pass counts, percentages and latency statistics.

    ``results(qid, target_modality, retrieval_precision, citation_accuracy,
    hallucination, modality_success, latency_sec)``.
    """
    counted = counts_for_modality(F.col("qid"), F.col("target_modality"))
    raw = results.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if("retrieval_precision").alias("retrieval_pass"),
        F.count_if("citation_accuracy").alias("citation_pass"),
        F.count_if("hallucination").alias("hallucination_count"),
        F.count_if(counted).alias("modality_total"),
        F.count_if(counted & F.col("modality_success")).alias("modality_pass"),
        F.avg("latency_sec").alias("_avg"),
    )
    middle, late = exact_percentiles(results.select("latency_sec"), [0.5, 0.95])
    total = F.col("total_questions")
    return raw.select(
        "total_questions",
        "retrieval_pass",
        "citation_pass",
        "hallucination_count",
        "modality_total",
        "modality_pass",
        _percent(F.col("retrieval_pass"), total, 0.0).alias("retrieval_precision_pct"),
        _percent(F.col("citation_pass"), total, 0.0).alias("citation_accuracy_pct"),
        _percent(F.col("hallucination_count"), total, 0.0).alias("hallucination_pct"),
        _percent(F.col("modality_pass"), F.col("modality_total"), 100.0).alias("modality_success_pct"),
        F.coalesce(rounded(F.col("_avg"), 2), F.lit(0.0)).alias("average_latency_seconds"),
        rounded(F.lit(middle or 0.0), 2).alias("median_p50_latency_seconds"),
        rounded(F.lit(late or 0.0), 2).alias("p95_latency_seconds"),
    )


def report_rows(results: DataFrame) -> DataFrame:
    """Markdown line of every result: (qid, line), questions cut to 48 characters."""
    question = F.replace("question", F.lit("|"), F.lit("\\|"))
    short = F.when(F.length(question) > 48, F.concat(F.substring(question, 1, 45), F.lit("..."))).otherwise(question)

    def status(c: str) -> Column:
        return F.when(F.col(c), F.lit("✅ Pass")).otherwise(F.lit("❌ Fail"))

    # The cells of a report line and their order.
    cells = [
        F.concat(F.lit("**"), F.col("qid"), F.lit("**")),
        F.element_at(F.split("track", ":"), 1),
        short,
        status("retrieval_precision"),
        status("citation_accuracy"),
        status("modality_success"),
        F.concat(F.col("latency_sec").cast("string"), F.lit("s")),
    ]
    return results.select("qid", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
