"""String helpers shared by all operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as one trim set and as character classes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# A word is a maximal run of letters, digits and underscores in any script.
WORD_RUN = r"[\p{L}\p{N}_]+"
# Query tokens: three or more ASCII word characters or hyphens, word-bounded.
QUERY_TOKEN = r"(?U)\b[a-zA-Z0-9_\-]{3,}\b"
# Unicode word classes, and "." stopping only at a line feed.
FLAGS = "(?Ud)"


def built_once(build: Callable) -> Callable:
    """``build``, which makes columns, called once for each arguments in a driver: a large
    expression takes thousands of calls to the JVM, and a stream asks for it with every batch."""
    held = functools.cache(lambda _, *given: build(*given))
    return functools.wraps(build)(lambda *given: held(SparkContext._gateway, *given))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def word_count(c: Column) -> Column:
    body = strip(c)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_RUN)))


def token_estimate(content: Column, caption: Column) -> Column:
    """Estimated prompt tokens of a chunk: 1.33 per word, at least 10."""
    words = word_count(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.coalesce(caption, F.lit(""))))
    return F.greatest((words * F.lit(1.33)).cast("int"), F.lit(10))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", "_")
    s = F.btrim(F.regexp_replace(s, "_+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("chunk")).otherwise(F.substring(s, 1, 60))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, whatever separates the runs."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""
    )


def words(c: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(WORD_RUN), F.lit(0)))


def query_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(QUERY_TOKEN), F.lit(0))


def quoted_sql(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Iterable[str]) -> Column:
    return F.expr("array(" + ",".join(quoted_sql(v) for v in values) + ")").cast("array<string>")


def in_list(c: Column, values: Iterable[str]) -> Column:
    """Membership in a fixed word list (one constant, however long the list)."""
    return F.array_contains(string_array(values), c)


def without(tokens: Column, stop: Iterable[str]) -> Column:
    """Tokens outside a stop list, duplicates and order kept."""
    stop = string_array(sorted(set(stop)))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def bounded(alternatives: Iterable[str]) -> str:
    """One word-bounded alternation for plain-text alternatives."""
    return FLAGS + r"\b(?:" + "|".join(alternatives) + r")\b"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def matches_any(c: Column, patterns: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(c, p)
    return hit


def contains_any(c: Column, needles: Iterable[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(c, F.lit(n))
    return hit


def has_word(text: Column, text_words: Column, word: Column) -> Column:
    """Word-bounded occurrence of ``word``; set lookup unless it is hyphenated."""
    pattern = F.concat(F.lit(r"(?U)\b"), word, F.lit(r"\b"))
    return F.when(F.contains(word, F.lit("-")), F.rlike(text, pattern)).otherwise(F.array_contains(text_words, word))


def mentions_word(text: Column, word: Column) -> Column:
    """Word-bounded occurrence for a few words: a plain search, then the boundaries."""
    pattern = F.concat(F.lit(r"(?U)\b"), word, F.lit(r"\b"))
    return F.contains(text, word) & F.rlike(text, pattern)


def lower_text(*cols: Column) -> Column:
    """Lower-cased space-joined text; null parts count as empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]))
