"""Does a chunk mention an entity or a requested field?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import bounded, let, lower_text, mentions_word, query_tokens, strip
from folioscope.lexicon import DEFAULT, Lexicon


def full_text() -> Column:
    return lower_text(*[F.col(c) for c in ("document_name", "caption", "section_title", "content")])


def evidence_text() -> Column:
    return lower_text(*[F.col(c) for c in ("content", "caption", "document_name", "section_title")])


def field_text() -> Column:
    return lower_text(*[F.col(c) for c in ("content", "caption", "section_title")])


def singular(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("s")) & (F.length(c) > 3), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def entity_matches(text: Column, entity: Column) -> Column:
    """Phrase or its singular anywhere; else every token as a word, plural or not."""
    e = strip(F.lower(entity))

    def every(tokens: Column) -> Column:
        return (F.size(tokens) > 0) & F.forall(
            tokens, lambda t: mentions_word(text, singular(t)) | mentions_word(text, t)
        )

    return (entity == "") | F.contains(text, singular(e)) | let(query_tokens(e), every)


def matched_fields(text: Column, fields: Column, lex: Lexicon = DEFAULT) -> Column:
    """The requested fields one of whose aliases occurs in ``text`` as words."""
    hits = [
        F.when(F.array_contains(fields, f) & text.rlike(bounded(a)), F.lit(f)) for f, a in lex.field_aliases.items()
    ]
    return F.array_compact(F.array(*hits))
