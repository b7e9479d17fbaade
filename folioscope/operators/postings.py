"""A stored inverted index of chunks, and top-k search that stops at score bounds.

Build once, search often.  The index has lists of (token, block of chunk numbers), a
dictionary with the length of each token's lists and the segments it was ever seen in,
the three-letter runs of the dictionary's words, and the lower-cased texts.  A search
reads lists, not texts: the rarest terms of a question give seed chunks whose scores set a
threshold (raised once more by the best candidates); frequent terms that together can't lift a chunk to it are only looked up for
chunks found by the other terms, and of those only where the bound still reaches it.
Texts are read for the chunks left whose terms need a pattern or a phrase checked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions.numbers import rounded
from folioscope.functions.text import WORD_RUN, words
from folioscope.lexicon import DEFAULT, Lexicon
from folioscope.operators.lexical import (
    ENTITY_PART, ENTITY_PHRASE, ENTITY_TOKEN, FIELD, LETTERS, MODALITY_CODES, QUERY_KEYS, TERM_BYTES, WORD, query_totals, rank_scored, search_terms, searchable, sum_points, traits_of,
)
from folioscope.session import checkpointed, spread
from folioscope.sizing import block_of, blocks_needed, small_side

# Chunk numbers of a list: 2 ** BLOCK_BITS; of a shelf of texts: 2 ** SHELF_BITS.
BLOCK_BITS, SHELF_BITS = 12, 16
BLOCK_SIZE = 1 << BLOCK_BITS
# Postings that a question's seed terms read at least, by asked chunk.
SEED_POSTINGS = 8
# Candidates, by asked chunk, that are scored before the others are judged again.
SECOND_LOOK = 3
SEGMENTS = [("body", 1, 1.0), ("name", 2, 2.0), ("cap", 4, 2.0), ("sec", 8, 1.5)]
SLACK = 1e-9


def segment_points(bits: Column) -> Column:
    """Points of a word by the segments (bits) that hold it."""
    return sum((F.when(bits.bitwiseAND(F.lit(bit)) != 0, points).otherwise(0.0) for _, bit, points in SEGMENTS), F.lit(0.0))


@dataclass(frozen=True)
class PostingIndex:
    """The tables of an index below ``path``."""

    spark: SparkSession
    path: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def texts(self) -> DataFrame:
        return self._read("texts")

    @property
    def lists(self) -> DataFrame:
        return self._read("lists")

    @property
    def parts(self) -> DataFrame:
        """Lists, as those of words, of the word parts that searches asked for so far."""
        return self._read("parts")

    @property
    def listed(self) -> DataFrame:
        return self.lists.drop("part").unionByName(self.parts)

    @property
    def dictionary(self) -> DataFrame:
        return self._read("dictionary")

    @property
    def grams(self) -> DataFrame:
        return self._read("grams")


def build_postings(chunks: DataFrame, path: str, parts: int = 16) -> PostingIndex:
    """Write the index of ``chunks`` to ``path``; lists and dictionary are laid out in
    ``parts`` folders by hash of the token. One shuffle of (token, number) rows; a list
    holds at most 2 ** BLOCK_BITS chunks, so a word of every chunk is many rows."""
    spark = chunks.sparkSession
    index = PostingIndex(spark, path)
    name, cap, sec, body = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("document_name", "caption", "section_title", "content")]
    rows = spread(searchable(chunks)).select("chunk_id", traits_of().alias("traits"), name.alias("name"), cap.alias("cap"), sec.alias("sec"), body.alias("body"))
    numbered = rows.withColumn("no", F.monotonically_increasing_id()).withColumn("shelf", F.shiftright("no", SHELF_BITS))
    numbered.write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/texts")

    listed = spread(index.texts).select("no", *[words(F.col(s)).alias(s) for s, _, _ in SEGMENTS])
    header = F.array_except(F.array_distinct(F.concat("name", "cap", "sec")), F.col("body"))

    def entry(word: Column, known: int) -> Column:
        bits = sum((F.when(F.array_contains(s, word), bit).otherwise(0) for s, bit, _ in SEGMENTS[1:]), F.lit(known))
        return F.struct(word.alias("token"), bits.alias("bits"))

    held = [F.transform("body", lambda w: entry(w, 1)), F.transform(header, lambda w: entry(w, 0))]
    # the empty word leads phrases without a usable word to every chunk
    every = F.array(F.struct(F.lit("").alias("token"), F.lit(0).alias("bits")))
    found = listed.select("no", F.explode(F.concat(every, *held)).alias("t")).select("no", "t.token", "t.bits")
    block, part = F.shiftright("no", BLOCK_BITS), F.pmod(F.xxhash64("token"), F.lit(parts)).cast("int")
    # one shuffle makes and lays out the lists; blocks of a frequent token may be written by several tasks
    dealt = found.withColumn("block", block).withColumn("part", part).withColumn("turn", F.pmod("block", F.lit(8))).repartition("part", "turn")
    lists = dealt.groupBy("part", "turn", "token", "block").agg(F.collect_list(F.struct("no", "bits")).alias("entries"))
    lists.drop("turn").sortWithinPartitions("part", "token", "block").write.mode("overwrite").partitionBy("part").parquet(f"{path}/lists")
    index.lists.drop("part").limit(0).write.mode("overwrite").parquet(f"{path}/parts")
    seen = F.aggregate("entries", F.lit(0), lambda s, e: s.bitwiseOR(e["bits"]))
    held = index.lists.select("part", "token", F.size("entries").alias("n"), seen.alias("bits"))
    known = held.groupBy("part", "token").agg(F.sum("n").alias("df"), F.bit_or("bits").alias("seen"))
    known.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/dictionary")
    gram = F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(LETTERS), F.lit(1))))
    index.dictionary.select("token", gram.alias("gram")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return index


def by_rarest_word(index: PostingIndex, terms: DataFrame) -> DataFrame:
    """``terms`` with phrases led by the rarest of the words that lie whole in them;
    phrases with such a word that no chunk has are gone."""
    led = (F.col("kind") == ENTITY_PHRASE) & F.col("phrase").isNotNull() & (F.col("token") != "")
    runs = F.regexp_extract_all("phrase", F.lit(WORD_RUN), F.lit(0))
    first = F.when(F.rlike("phrase", F.lit(r"^[^\p{L}\p{N}_]")), 1).otherwise(2)
    last = F.size(runs) - F.when(F.rlike("phrase", F.lit(r"[^\p{L}\p{N}_]$")), 0).otherwise(1)
    inner = F.array_distinct(F.slice(runs, first, F.greatest(last - first + 1, F.lit(0))))
    asked = checkpointed(terms.where(led).withColumn("word", F.explode(inner)))
    # the words that are known come back, not the dictionary
    known = index.dictionary.select(F.col("token").alias("word"), "df").join(small_side(asked.select("word").distinct(), TERM_BYTES), "word", "left_semi")
    each = asked.join(known, "word", "left")
    rarest = each.groupBy(*QUERY_KEYS, "ent").agg(F.min_by("word", "df").alias("word"), F.count_if(F.col("df").isNull()).alias("unknown")).where("unknown = 0")
    moved = terms.where(led).join(rarest.drop("unknown"), [*QUERY_KEYS, "ent"]).withColumn("token", F.col("word"))
    return terms.where(~led).unionByName(moved.select(terms.columns))


def part_key() -> Column:
    """What lists of a part-of-word term go by: no word, as it starts with a control character."""
    return F.concat_ws("\x01", F.lit(""), "pattern", "phrase")


def keep_parts(index: PostingIndex, parts: DataFrame) -> None:
    """Add the lists of ``parts`` that the index lacks: chunks with a word that holds the
    part. Words are as many as the corpus has, parts as few as the questions, so later
    steps meet one short list a part and block. Matching words go to the lists by
    broadcast, in several passes beyond its bound."""
    wanted = parts.select("gram", "pattern", "phrase", part_key().alias("key")).distinct()
    fresh = checkpointed(wanted.join(F.broadcast(index.parts.select(F.col("token").alias("key")).distinct()), "key", "left_anti"))
    if fresh.isEmpty():
        return
    # the first word of a longer phrase ends a word of the chunk, its last one begins one
    part, first, last = F.col("pattern"), F.startswith("phrase", F.col("pattern")), F.endswith("phrase", F.col("pattern"))
    within = F.when(F.col("phrase").isNull() | ~(first | last), F.contains("token", part)).otherwise((first & F.endswith("token", part)) | (last & F.startswith("token", part)))
    inside = checkpointed(index.grams.join(small_side(fresh, TERM_BYTES), "gram").where(within).select("key", "token"))
    passes = blocks_needed(inside, TERM_BYTES)
    held = [
        block_of(index.lists, ["token"], turn, passes).join(F.broadcast(block_of(inside, ["token"], turn, passes)), "token").select("key", "block", F.inline("entries"))
        for turn in range(passes)
    ]
    lists = reduce(DataFrame.unionByName, held).groupBy(F.col("key").alias("token"), "block", "no").agg(F.bit_or("bits").alias("bits"))
    lists = lists.groupBy("token", "block").agg(F.collect_list(F.struct("no", "bits")).alias("entries"))
    lists.write.mode("append").parquet(f"{index.path}/parts")


def lookups(index: PostingIndex, terms: DataFrame) -> DataFrame:
    """``terms`` by the dictionary: (..., token, df, unit, most). Part-of-word terms are
    found by the part's own lists, phrases by their rarest word, and terms that
    no chunk has are gone. ``most`` is the most
    that the ``unit`` of a term can add to a score; an entity is
    matched only in chunks that hold one of its ``gate`` terms."""
    parts = checkpointed(terms.where(F.col("kind") == ENTITY_PART).withColumnRenamed("token", "gram"))
    keep_parts(index, parts)
    inside = parts.withColumn("token", part_key()).withColumn("pattern", F.lit(None).cast("string")).select(terms.columns)
    wanted = checkpointed(by_rarest_word(index, terms.where(F.col("kind") != ENTITY_PART)).unionByName(inside))
    known = index.dictionary.drop("part").unionByName(index.parts.groupBy("token").agg(F.sum(F.size("entries")).alias("df"), F.lit(0).alias("seen")))
    whole = known.join(small_side(wanted, TERM_BYTES), "token")
    kind = F.col("kind")
    most = (
        F.when(kind == WORD, F.col("weight") * segment_points(F.col("seen")))
        .when(kind == FIELD, 3.0)
        # complete entities have five points, others one and a half a word
        .when(kind == ENTITY_TOKEN, F.col("weight") * F.greatest(F.lit(1.5), 5.0 / F.col("n_tok")))
        .otherwise(8.0)
    )
    unit = F.when(kind == FIELD, F.xxhash64(kind, "weight")).when(kind >= ENTITY_PHRASE, F.xxhash64(kind, "ent")).otherwise(F.xxhash64(kind, "ent", "token"))
    named = whole.select(*QUERY_KEYS, "ent", "n_tok", "token", "kind", "weight", "pattern", "phrase", "df", unit.alias("unit"), most.alias("most"))
    # an entity is complete only where its rarest word is, if chunks have all its words
    same = Window.partitionBy(*QUERY_KEYS, "ent", "kind")
    rarest = (F.row_number().over(same.orderBy("df", "unit")) == 1) & (F.sum("weight").over(same) == F.col("n_tok"))
    return named.withColumn("gate", F.when(F.col("kind") == ENTITY_TOKEN, rarest).otherwise(F.col("kind") >= ENTITY_PHRASE))


def block_bits(pairs: DataFrame) -> DataFrame:
    """(query_id, step, block, held) of ``pairs`` (query_id, step, no): ``held`` has a bit
    for every chunk number of the block, 64 in each of its longs."""
    place = F.col("no").bitwiseAND(F.lit(BLOCK_SIZE - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    named = pairs.select(*QUERY_KEYS, F.shiftright("no", BLOCK_BITS).alias("block"), F.shiftright(place, 6).cast("int").alias("at"), bit.alias("bit"))
    longs = named.groupBy(*QUERY_KEYS, "block", "at").agg(F.bit_or("bit").alias("bits"))
    by_place = longs.groupBy(*QUERY_KEYS, "block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("by_place"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_SIZE // 64 - 1)), lambda i: F.coalesce(F.element_at("by_place", i), F.lit(0).cast("long")))
    return by_place.select(*QUERY_KEYS, "block", filled.alias("held"))


def hits_of(pairs: DataFrame, index: PostingIndex, asked: DataFrame) -> DataFrame:
    """Terms of ``asked`` that the chunks of ``pairs`` (query_id, step, no) hold, with the
    segments as ``bits``. Lists stay where they are read: they meet the chunks asked for as
    bits of their blocks, in several passes if those are beyond the broadcast bound, and
    only entries of these chunks leave their list."""
    wanted = checkpointed(block_bits(pairs))
    passes = blocks_needed(wanted, BLOCK_SIZE // 8 + TERM_BYTES)

    def one(turn: int) -> DataFrame:
        part = block_of(wanted, ["block"], turn, passes)
        opened = block_of(index.listed, ["block"], turn, passes).join(small_side(asked, TERM_BYTES), "token")
        met = opened.join(F.broadcast(part), [*QUERY_KEYS, "block"])
        place = lambda e: e["no"].bitwiseAND(F.lit(BLOCK_SIZE - 1))
        at = lambda e: F.element_at("held", (F.shiftright(place(e), 6) + 1).cast("int"))
        inside = F.filter("entries", lambda e: F.getbit(at(e), place(e).bitwiseAND(F.lit(63)).cast("int")) == 1)
        return met.withColumn("entries", inside).select(*asked.columns, F.inline("entries"))

    return reduce(DataFrame.unionByName, [one(turn) for turn in range(passes)])


def with_checks(hits: DataFrame, index: PostingIndex) -> DataFrame:
    """``hits`` whose pattern and phrase hold in the chunk's text; ``bits`` keeps the
    segments where a word's pattern holds. Only shelves with such chunks are read: their
    numbers, one for 2 ** SHELF_BITS chunks, are collected."""
    needed = F.col("pattern").isNotNull() | F.col("phrase").isNotNull()
    hits = checkpointed(hits)
    doubtful = hits.where(needed)
    shelves = [r[0] for r in doubtful.select(F.shiftright("no", SHELF_BITS)).distinct().collect()]
    texts = index.texts.where(F.col("shelf").isin(shelves)) if shelves else index.texts.limit(0)
    # few hits are doubtful: they go to the texts, unless they are too many
    read = texts.select("no", "name", "cap", "sec", "body").join(small_side(doubtful, 3 * TERM_BYTES), "no").withColumn("whole", F.concat_ws(" ", "name", "cap", "sec", "body"))
    bits = F.lit(0)
    for segment, bit, _ in SEGMENTS:
        bits = bits.bitwiseOR(F.when(F.rlike(segment, F.col("pattern")), F.col("bits").bitwiseAND(F.lit(bit))).otherwise(0))
    by_word = (F.col("kind") == WORD) & F.col("pattern").isNotNull()
    holds = F.when(F.col("kind") == WORD, F.lit(True)).otherwise(F.coalesce(F.rlike("whole", F.col("pattern")), F.lit(True)))
    proven = read.where(holds & (F.col("phrase").isNull() | F.contains("whole", F.col("phrase")))).withColumn("bits", F.when(by_word, bits).otherwise(F.col("bits")))
    return hits.where(~needed).unionByName(proven.select(hits.columns))


def scored_pairs(hits: DataFrame, index: PostingIndex, totals: DataFrame) -> DataFrame:
    kind = F.col("kind")
    shares = hits.select(
        *QUERY_KEYS, F.col("no"), "ent", "n_tok",
        F.when(kind == WORD, F.col("weight") * segment_points(F.col("bits"))).otherwise(0.0).alias("words"),
        F.when(kind == FIELD, F.col("weight")).otherwise(0).alias("field_bits"),
        F.when(kind == ENTITY_TOKEN, F.col("weight")).otherwise(0).alias("token_hits"),
        F.when(kind >= ENTITY_PHRASE, 1).otherwise(0).alias("phrase_hit"),
    )
    per_entity = shares.groupBy(*QUERY_KEYS, "no", "ent", "n_tok").agg(
        F.sum("words").alias("words"), F.bit_or("field_bits").alias("field_bits"), F.sum("token_hits").alias("token_hits"), F.max("phrase_hit").alias("phrase_hit")
    )
    return sum_points(per_entity, "no").join(index.texts.select("no", "chunk_id", "traits"), "no").join(totals, QUERY_KEYS)


def _bound(points: Column, entity: Column) -> Column:
    """The highest relevance that ``points`` can give; ``entity``: one may be matched."""
    lifted = F.when(F.col("target_code") == MODALITY_CODES["image-caption"], 1.3).otherwise(1.0)
    missed = ~entity & (F.col("n_entities") > 0) & (F.col("n_words") > 0)
    ceiling = F.greatest(F.col("n_entities") * 8.0 + F.col("n_fields") * 3.0 + F.col("n_words") * 2.0, F.lit(1.0))
    top = F.least(F.lit(1.0), F.when(missed, points * 0.15).otherwise(points) / ceiling + SLACK)
    return rounded(top * F.greatest(F.col("boost"), lifted), 4) + SLACK


def by_block(lists: DataFrame, index: PostingIndex) -> DataFrame:
    """``lists`` with all rows of a block in one task; tasks grow in number with the index."""
    session = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(max(session, 4 * index.lists.rdd.getNumPartitions()), "block")


def found_by(index: PostingIndex, asked: DataFrame) -> DataFrame:
    """(block, query_id, step, no, unit, points, gate) of every chunk in the lists of ``asked``,
    ``points`` being the most that the unit adds there."""
    known = small_side(asked, TERM_BYTES)
    # lists of asked words move once, by block and as lists: what the block's chunks hold is then summed up in place
    opened = index.listed.join(small_side(asked.select("token").distinct(), TERM_BYTES), "token", "left_semi")
    entries = by_block(opened, index).join(known, "token").select(*QUERY_KEYS, "block", "kind", "unit", "weight", "most", "gate", F.inline("entries"))
    points = F.when(F.col("kind") == WORD, F.col("weight") * segment_points(F.col("bits"))).otherwise(F.col("most"))
    return entries.groupBy("block", *QUERY_KEYS, "no", "unit").agg(F.max(points).alias("points"), F.max("gate").alias("gate"))


def candidate_pairs(index: PostingIndex, asked: DataFrame, totals: DataFrame, max_k: int) -> DataFrame:
    """(query_id, step, no) of all chunks that may be among a question's best ``k``."""
    units = asked.groupBy(*QUERY_KEYS, "unit", "kind").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.max("gate").alias("gate"))
    rare = Window.partitionBy(*QUERY_KEYS).orderBy("df", "kind", "unit")
    frequent = Window.partitionBy(*QUERY_KEYS).orderBy(F.desc("df"), F.desc("kind"), F.desc("unit"))
    units = checkpointed(
        units.withColumn("read", F.sum("df").over(rare) - F.col("df"))
        .withColumn("sum_most", F.sum("most").over(frequent))
        .withColumn("entity", F.max("gate").over(frequent))
    )
    def threshold(pairs: DataFrame) -> DataFrame:
        """``totals`` with the k-th best score of ``pairs``, without doubtful terms: no
        chunk below it can be among the best k."""
        sure = hits_of(checkpointed(pairs), index, asked).where("pattern is null and phrase is null")
        seen = rank_scored(scored_pairs(sure, index, totals), max_k)
        kth = seen.join(totals.select(*QUERY_KEYS, "k"), QUERY_KEYS).where("rank = k").select(*QUERY_KEYS, F.col("relevance_score").alias("threshold"))
        return checkpointed(totals.join(kth, QUERY_KEYS, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))))

    # seeds: chunks of the rarest terms
    first = units.where(F.col("read") < SEED_POSTINGS * max_k)
    seeds = found_by(index, asked.join(first.select(*QUERY_KEYS, "unit"), [*QUERY_KEYS, "unit"], "left_semi"))
    known = threshold(seeds.select(*QUERY_KEYS, "no").distinct())
    # the frequent terms that can't reach the threshold together
    idle = _bound(F.col("sum_most"), F.col("entity")) < F.col("threshold")
    judged = units.join(known, QUERY_KEYS).withColumn("idle", idle)
    leading = judged.where(~F.col("idle")).select(*QUERY_KEYS, "unit")
    rest = judged.groupBy(*QUERY_KEYS).agg(F.sum(F.when(F.col("idle"), F.col("most")).otherwise(0.0)).alias("rest"), F.max(F.col("idle") & F.col("gate")).alias("rest_entity"))
    met = found_by(index, asked.join(leading, [*QUERY_KEYS, "unit"], "left_semi"))
    sums = met.groupBy("block", *QUERY_KEYS, "no").agg(F.sum("points").alias("points"), F.max("gate").alias("entity"))
    able = _bound(F.col("points") + F.col("rest"), F.col("entity") | F.col("rest_entity")) >= F.col("threshold")
    open_ = checkpointed(sums.join(small_side(rest, TERM_BYTES), QUERY_KEYS).join(small_side(known, TERM_BYTES), QUERY_KEYS).where(able).select(*QUERY_KEYS, "no", "points", "entity", "rest", "rest_entity"))
    # the most promising of them raise the threshold once more
    best = Window.partitionBy(*QUERY_KEYS).orderBy(F.desc("points"), "no")
    promising = open_.withColumn("place", F.row_number().over(best)).where(F.col("place") <= SECOND_LOOK * max_k)
    raised = threshold(promising.select(*QUERY_KEYS, "no"))
    return open_.join(raised, QUERY_KEYS).where(able).select(*QUERY_KEYS, "no")


def postings_topk(queries: DataFrame, index: PostingIndex, max_k: int = 0, lex: Lexicon = DEFAULT) -> DataFrame:
    """Best ``k`` chunks per question, as ``lexical.lexical_topk`` gives them, from a
    stored index. Questions may be many: all joins are equi-joins of narrow rows, which
    broadcast only what Spark finds small."""
    max_k = max(max_k, queries.agg(F.max("k")).first()[0] or 0)
    asked = checkpointed(lookups(index, search_terms(queries, lex)))
    totals = checkpointed(query_totals(queries, lex))
    pairs = checkpointed(candidate_pairs(index, asked, totals, max_k))
    hits = with_checks(hits_of(pairs, index, asked), index)
    return rank_scored(scored_pairs(hits, index, totals), max_k)
