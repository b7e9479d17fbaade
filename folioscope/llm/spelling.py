"""Spelling variants: words one edit apart, found through a reduced alphabet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import column, stored
from folioscope.llm.dedup import LOWER, UPPER

# Letters of a word: a-z (after lower-casing) and the range from U+00C0 to U+00FF.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
RUN = "[a-zÀ-ÿ]+"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): how often each maximal run of letters occurs in all texts, A-Z
    lower-cased. ``change`` may rewrite a run, given the document's id and the run.
    Null texts have no word; counts combine before they shuffle."""
    low = F.translate(column(docs, text), UPPER, LOWER)
    runs = docs.select(column(docs, doc_id).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    word = change(F.col("id"), F.col("run")) if change else F.col("run")
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def reduced(word: Column, symbols: int) -> Column:
    """``word`` over an alphabet of ``symbols`` letters: code points modulo their number,
    letters outside LETTERS all counting as "a"."""
    return F.translate(F.regexp_replace(word, "[^a-zÀ-ÿ]", "a"), LETTERS, "".join(chr(97 + ord(c) % symbols) for c in LETTERS))


def neighbourhood(r: str, symbols: int) -> Column:
    """64-bit hashes of the reduced word in column ``r`` and of all that come from it by
    deleting, replacing or inserting one symbol; each once."""
    alphabet = "array(" + ", ".join(f"'{chr(97 + k)}'" for k in range(symbols)) + ")"
    places = f"sequence(1, length({r}))"
    deleted = f"transform({places}, i -> xxhash64(concat(left({r}, i - 1), substr({r}, i + 1))))"
    replaced = f"flatten(transform({places}, i -> transform({alphabet}, s -> xxhash64(concat(left({r}, i - 1), s, substr({r}, i + 1))))))"
    inserted = f"flatten(transform(sequence(1, length({r}) + 1), i -> transform({alphabet}, s -> xxhash64(concat(left({r}, i - 1), s, substr({r}, i))))))"
    return F.expr(f"array_distinct(concat({deleted}, {replaced}, {inserted}))")


def near_words(words: DataFrame, symbols: int = 6) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of ``words`` (word, n) that differ by
    exactly one inserted, deleted or replaced code point.

    Such words have reduced words that are equal or one edit apart. The neighbourhoods of
    the distinct reduced words meet the reduced vocabulary by equal hash, before any
    word is touched; the words of the reduced pairs left are compared as they are. More
    ``symbols`` mean more neighbours and fewer words to compare. (A reduced word is in its
    own neighbourhood: its symbols are also replaced by themselves.)"""
    keyed = words.where("word <> ''").select("word", "n", reduced(F.col("word"), symbols).alias("r"))
    small = stored(keyed.select("r").distinct())
    asked = small.select(F.xxhash64("r").alias("a"), F.explode(neighbourhood("r", symbols)).alias("b"))
    pairs = stored(asked.join(small.select(F.xxhash64("r").alias("b")), "b"))
    held = stored(keyed.select("word", "n", F.xxhash64("r").alias("a")))
    one = pairs.join(held, "a").select("word", "n", "b")
    other = held.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("a").alias("b"))
    return one.join(other, "b").where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of ``forms`` (word, form) that follow each word. Every round
    doubles the steps taken; forms must not run in a circle."""
    up = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(up.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def variants(words: DataFrame, ratio: int = 2, symbols: int = 6) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n), whose
    words must be distinct.

    A word's form is its near word of largest n (ties: the smallest in code-point order)
    if that is at least ``ratio`` (over 1) times the word's own n. An empty table gives
    no row; null and empty words are near none."""
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best)
    whole = words.join(near, "word", "left").withColumn("strong", -F.col("best.less") >= ratio * F.col("n"))
    named = stored(whole.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("strong"), F.col("best.other")).alias("form"), F.when(F.col("strong"), -F.col("best.less")).alias("form_n"),
    ))
    return named.join(roots(named.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
