"""File-path cues: name, stem, suffix, document type, reliability, category."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.lexicon import RELIABILITY_CUES


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def source_reliability(path: Column) -> Column:
    whole = F.lower(path)
    short = F.lower(stem(file_name(path)))
    tier = F.when(F.lit(False), F.lit(""))
    for scope, needle, value in RELIABILITY_CUES:
        tier = tier.when(F.contains(whole if scope == "path" else short, F.lit(needle)), F.lit(value))
    return tier.otherwise("unknown")


def document_type(path: Column) -> Column:
    name = F.lower(file_name(path))
    ext = suffix(name)
    return (
        F.when(F.contains(name, F.lit("scan")), "scan")
        .when(ext == ".pdf", "pdf")
        .when(ext == ".docx", "docx")
        .when(ext.isin(".md", ".markdown"), "md")
        .otherwise("txt")
    )


def source_category(path: Column) -> Column:
    """Category of paged documents, read from the folder names."""
    p = F.lower(path)
    return (
        F.when(F.contains(p, F.lit("chronicles")), "chronicles")
        .when(F.contains(p, F.lit("codex")), "codex")
        .otherwise("ephemera")
    )
