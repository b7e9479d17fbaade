"""Paths, slugs, chunking, sections, ids, validation, index projection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope import lexicon as L
from folioscope.functions.chunking import chunk_texts
from folioscope.functions.paths import document_type, source_category, source_reliability
from folioscope.functions.text import slug, token_estimate, word_count
from folioscope.operators.dictionary import with_keys
from folioscope.operators.index import corpus_stats, index_ids, index_records, modality_counts, upsert
from folioscope.operators.media import Plate, describe_figure, match_plate, resolve_media
from folioscope.operators.validate import chunk_errors, duplicate_ids, unique_ids, validate_chunks
from folioscope.schema import CHUNK
from folioscope.session import checkpointed, shared_folder
from folioscope.sources.deltas import BucketTable, ingest_stream
from folioscope.sources.documents import markdown_sections, page_text, text_title
from folioscope.sources.stored import write_media
from folioscope.session import spread
from registry import inputs as I
from registry.sql import CHUNKS, PATHS, lst, s

SLUG_SQL = """CASE WHEN trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') = '' THEN 'chunk'
 ELSE substring(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_'), 1, 60) END"""


def slug_sql(x: str) -> str:
    return SLUG_SQL.format(x=x)


def slug_ids(spark, sf):
    d = I.table(spark, sf, "documents")
    return d.select("doc_id", slug(F.concat("source", F.lit(" / "), "text")).alias("slug"))


def reliability(spark, sf):
    p = I.paths(spark, sf)
    return p.select("doc_id", source_reliability(F.col("path")).alias("reliability"), source_category(F.col("path")).alias("category"))


def doc_type(spark, sf):
    return I.paths(spark, sf).select("doc_id", document_type(F.col("path")).alias("document_type"))


def tokens(spark, sf):
    c = I.chunks(spark, sf)
    return c.select("chunk_id", word_count(F.col("content")).alias("n_words"), token_estimate(F.col("content"), F.col("caption")).alias("est_tokens"))


def hier_chunk(spark, sf):
    d = I.table(spark, sf, "documents")
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return (
        spread(d).select("doc_id", "source", F.posexplode(chunk_texts(body)).alias("pos", "content"))
        .select(
            F.concat(slug(F.concat("source", F.lit("_"), "doc_id")), F.lit("_p1_c"), F.lpad((F.col("pos") + 1).cast("string"), F.greatest(F.lit(2), F.length((F.col("pos") + 1).cast("string"))), F.lit("0"))).alias("chunk_id"),
            F.md5(F.btrim("content")).alias("content_md5"),
            word_count(F.col("content")).alias("word_count"),
            F.length("content").alias("char_count"),
        )
    )


HIER_SQL = r"""
WITH parts AS (
  SELECT doc_id, source, trim(replace(text, chr(10), chr(10) || chr(10)), ' ' || chr(10)) AS body FROM documents
), steps AS (
  SELECT doc_id, source, body,
    flatten(list_transform(list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> ''),
      lambda p: CASE WHEN length(p) <= 800 THEN [{'kind': 'P', 's': p, 'op': []::VARCHAR[], 'n': 0, 'done': []::VARCHAR[]}]
        ELSE list_concat([{'kind': 'B', 's': '', 'op': []::VARCHAR[], 'n': 0, 'done': []::VARCHAR[]}],
          list_transform(list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''),
            lambda x: {'kind': 'S', 's': trim(x), 'op': []::VARCHAR[], 'n': 0, 'done': []::VARCHAR[]})) END)) AS ops
  FROM parts
), folded AS (
  SELECT doc_id, source, body, list_reduce(ops, lambda a, x:
    CASE WHEN x.kind <> 'B' AND a.n + length(x.s) <= 800
      THEN {'kind': '', 's': '', 'op': list_append(a.op, x.s), 'n': a.n + length(x.s) + CASE x.kind WHEN 'S' THEN 1 ELSE 2 END, 'done': a.done}
    WHEN len(a.op) = 0
      THEN {'kind': '', 's': '', 'op': CASE x.kind WHEN 'B' THEN [] ELSE [x.s] END,
            'n': CASE x.kind WHEN 'B' THEN a.n WHEN 'S' THEN a.n + length(x.s) + 1 ELSE a.n + length(x.s) + 2 END, 'done': a.done}
    WHEN x.kind = 'S'
      THEN {'kind': '', 's': '', 'op': [right(array_to_string(a.op, ' '), 150), x.s],
            'n': least(150, length(array_to_string(a.op, ' '))) + length(x.s) + 1, 'done': list_append(a.done, array_to_string(a.op, ' '))}
    WHEN length(array_to_string(a.op, chr(10) || chr(10))) > 150
      THEN {'kind': '', 's': '', 'op': list_concat([right(array_to_string(a.op, chr(10) || chr(10)), 150)], CASE x.kind WHEN 'B' THEN [] ELSE [x.s] END),
            'n': 150 + CASE x.kind WHEN 'B' THEN 0 ELSE length(x.s) + 2 END, 'done': list_append(a.done, array_to_string(a.op, chr(10) || chr(10)))}
    ELSE {'kind': '', 's': '', 'op': CASE x.kind WHEN 'B' THEN [] ELSE [x.s] END,
          'n': CASE x.kind WHEN 'B' THEN 0 ELSE length(x.s) + 2 END, 'done': list_append(a.done, array_to_string(a.op, chr(10) || chr(10)))}
    END, {'kind': '', 's': '', 'op': []::VARCHAR[], 'n': 0, 'done': []::VARCHAR[]}) AS f
  FROM steps WHERE length(body) > 900
), bodies AS (
  SELECT doc_id, source, CASE WHEN trim(array_to_string(f.op, chr(10) || chr(10)), ' ' || chr(10)) NOT IN ('', coalesce(f.done[-1], ''))
    THEN list_append(f.done, trim(array_to_string(f.op, chr(10) || chr(10)), ' ' || chr(10))) ELSE f.done END AS texts FROM folded
  UNION ALL SELECT doc_id, source, [body] FROM parts WHERE length(body) <= 900 AND body <> ''
), numbered AS (
  SELECT doc_id, source, unnest(texts) AS content, generate_subscripts(texts, 1) AS pos FROM bodies
)
SELECT """ + slug_sql("source || '_' || doc_id") + r""" || '_p1_c' || CASE WHEN pos < 10 THEN '0' ELSE '' END || pos AS chunk_id,
  md5(trim(content)) AS content_md5, len(regexp_extract_all(content, '\S+')) AS word_count, length(content) AS char_count FROM numbered
"""


def _headed(spark, sf):
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(i % 3 == 1, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" "), l)).otherwise(l),
    )
    return I.table(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit("_"), "doc_id").alias("stem"), F.array_join(lines, "\n").alias("text")
    )


def md_sections(spark, sf):
    return (
        markdown_sections(spread(_headed(spark, sf)))
        .select("doc_id", "section_no", F.md5("section_title").alias("title_md5"), F.md5("section_text").alias("text_md5"))
    )


MD_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), marked AS (
  SELECT doc_id, source, i, (i % 4 + 1) AS lvl, (i % 3 = 1 AND trim(l) <> '') AS is_head, trim(l) AS title,
    CASE WHEN i % 3 = 1 THEN repeat('#', (i % 4 + 1)::INT) || ' ' || l ELSE l END AS line FROM lines
), numbered AS (
  SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM marked
), heads AS (SELECT doc_id, sec, lvl, title FROM numbered WHERE is_head
), crumbs AS (
  SELECT h.doc_id, h.sec, string_agg(j.title, ' > ' ORDER BY j.lvl) AS crumb
  FROM heads h JOIN heads j ON j.doc_id = h.doc_id AND j.sec <= h.sec
  WHERE NOT EXISTS (SELECT 1 FROM heads k WHERE k.doc_id = h.doc_id AND k.sec > j.sec AND k.sec <= h.sec AND k.lvl <= j.lvl)
  GROUP BY ALL
), secs AS (
  SELECT doc_id, source, sec, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS body
  FROM numbered WHERE NOT is_head GROUP BY ALL HAVING body <> ''
)
SELECT s.doc_id, (row_number() OVER (PARTITION BY s.doc_id ORDER BY s.sec))::INT AS section_no,
  md5(coalesce(c.crumb, 'Src' || substring(source, 4) || ' ' || s.doc_id)) AS title_md5, md5(body) AS text_md5
FROM secs s LEFT JOIN crumbs c USING (doc_id, sec)
"""


def page_sections(spark, sf):
    """Headings and paragraphs of web pages as Markdown sections."""
    pages = I.table(spark, sf, "pages").select("page_id", F.concat(F.lit("page_"), "page_id").alias("stem"), page_text(F.col("html")).alias("text"))
    return markdown_sections(spread(pages)).select("page_id", "section_no", F.md5("section_title").alias("title_md5"), F.md5("section_text").alias("text_md5"))


PAGE_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
PAGE_SQL = r"""
WITH pieces AS (
  SELECT page_id, unnest(string_split(html, '<')) AS p, generate_subscripts(string_split(html, '<'), 1) AS i FROM pages
), named AS (
  SELECT page_id, i, lower(regexp_extract(p, '^(/?[A-Za-z0-9!]+)', 1)) AS tag, CASE WHEN starts_with(p, '!--') THEN split_part(p, '-->', 2) WHEN contains(p, '>') THEN p[strpos(p, '>') + 1:] ELSE '' END AS t FROM pieces WHERE i > 1
), spoken AS (
  SELECT *, sum(CASE tag WHEN 'script' THEN 1 WHEN 'style' THEN 1 WHEN '/script' THEN -1 WHEN '/style' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS mute FROM named
), blocks AS (
  SELECT page_id, i, tag, CASE tag WHEN 'br' THEN ' ' || t ELSE t END AS t,
    sum((ltrim(tag, '/') NOT IN ('a', 'b', 'br', 'i', 'em', 'strong', 'span', 'u', '!'))::INT) OVER (PARTITION BY page_id ORDER BY i) AS e FROM spoken WHERE mute = 0 AND tag NOT IN ('/script', '/style')
), elements AS (SELECT page_id, e, min_by(tag, i) AS tag, replace(replace(string_agg(t, '' ORDER BY i), chr(13), ' '), chr(10), ' ') AS raw FROM blocks GROUP BY ALL
), found AS (SELECT page_id, e AS i, tag, ENTITIES AS t FROM elements WHERE tag IN ('h1', 'p')
), marked AS (SELECT page_id, i, tag = 'h1' AND trim(t) <> '' AS is_head, CASE tag WHEN 'h1' THEN '# ' || t ELSE t END AS line, trim(t) AS title FROM found
), numbered AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY page_id ORDER BY i) AS sec FROM marked
), heads AS (SELECT page_id, sec, title FROM numbered WHERE is_head
), secs AS (SELECT page_id, sec, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)) AS body FROM numbered WHERE NOT is_head GROUP BY ALL HAVING body <> '')
SELECT s.page_id, (row_number() OVER (PARTITION BY s.page_id ORDER BY s.sec))::INT AS section_no, md5(coalesce(h.title, 'Page ' || s.page_id)) AS title_md5, md5(body) AS text_md5
FROM secs s LEFT JOIN heads h USING (page_id, sec)
UNION ALL SELECT page_id, 1, md5(max_by(title, i)), md5(trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10)))
FROM numbered WHERE page_id NOT IN (SELECT page_id FROM secs) GROUP BY page_id HAVING bool_or(is_head)
"""
_raw = "raw"
for _entity, _char in PAGE_ENTITIES:
    _raw = f"replace({_raw}, {s(_entity)}, {s(_char)})"
PAGE_SQL = PAGE_SQL.replace("ENTITIES", _raw)


def txt_titles(spark, sf):
    d = I.table(spark, sf, "documents")
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i == F.col("doc_id") % 7, F.upper(F.replace(l, F.lit("ß"), F.lit("ss")))).otherwise(l))
    rows = d.select("doc_id", F.concat("source", F.lit("_"), "doc_id").alias("stem"), F.array_join(lines, "\n").alias("text"))
    return rows.select("doc_id", text_title(F.col("stem"), F.col("text")).alias("section_title"))


TXT_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), shout AS (
  SELECT doc_id, min_by(t, i) AS t FROM (
    SELECT doc_id, i, trim(CASE WHEN i = doc_id % 7 THEN upper(replace(l, 'ß', 'ss')) ELSE l END) AS t FROM lines WHERE i < 5)
  WHERE length(t) > 3 AND length(t) < 70 AND upper(t) = t AND lower(t) <> t GROUP BY doc_id
)
SELECT doc_id, 'Src' || substring(source, 4) || ' ' || doc_id || CASE WHEN t IS NULL THEN '' ELSE ' > ' || t END AS section_title
FROM documents LEFT JOIN shout USING (doc_id)
"""


def dup_ids(spark, sf):
    """Sources as ids, some of which already look like numbered ones."""
    i, name = F.col("doc_id"), slug(F.col("source"))
    given = F.when(i % 9 == 4, F.concat(name, F.lit("_dup"), (i % 6 + 1).cast("string"))).otherwise(name)
    return unique_ids(I.table(spark, sf, "documents").select("doc_id", given.alias("chunk_id")), ["doc_id"])


def index_projection(spark, sf):
    c = I.chunks(spark, sf)
    i = F.regexp_extract("chunk_id", r"\d+", 0).cast("int")
    return index_records(
        c.withColumn("content", F.when(i % 7 == 0, F.lit("  ")).otherwise(F.col("content")))
        .withColumn("document_type", F.when(i % 3 != 0, F.col("document_type")))
        .withColumn("page_number", F.when(i % 4 != 0, F.col("page_number")))
    ).select("chunk_id", "document_name", "document_type", "page_number", "section_title", "modality", "media_path", "caption", "source_reliability", F.md5("document").alias("document_md5"))


def index_unique(spark, sf):
    d = I.table(spark, sf, "documents")
    rows = d.select("doc_id", F.col("doc_id").alias("position"), "source", F.when(F.col("lang") != "es", F.col("source")).alias("chunk_id"), F.concat("source", F.lit("_"), "lang", F.lit(".txt")).alias("document_name"))
    return index_ids(rows, ["position"]).select("doc_id", "chunk_id")


def _flawed(spark, sf):
    i = F.regexp_extract("chunk_id", r"\d+", 0).cast("int")
    return I.chunks(spark, sf).select(
        F.when(i % 13 != 0, F.col("chunk_id")).otherwise(F.col("document_name")).alias("chunk_id"),
        "document_name",
        F.when(i % 11 == 0, F.lit("html")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(i % 17 != 0, F.col("page_number")).alias("page_number"),
        "section_title",
        F.when(i % 19 == 0, F.lit("video")).otherwise(F.col("modality")).alias("modality"),
        F.when(i % 23 == 0, F.lit(" \n")).otherwise(F.col("content")).alias("content"),
        "media_path",
        "caption",
    )


def _catalog(spark, sf):
    """Media files that exist: those of documents with a label."""
    return I.table(spark, sf, "labels").select(F.concat(F.lit("data/media/fig_"), "doc_id", F.lit(".png")).alias("path"))


def validate(spark, sf):
    exists = _catalog(spark, sf).withColumn("path", F.replace("path", F.lit("data/"), F.lit("")))
    return validate_chunks(_flawed(spark, sf), exists)


VALID_SQL = f"""
WITH {CHUNKS}, f AS (
  SELECT CASE WHEN doc_id % 13 <> 0 THEN chunk_id ELSE document_name END AS chunk_id,
    CASE WHEN doc_id % 11 = 0 THEN 'html' ELSE document_type END AS document_type,
    CASE WHEN doc_id % 17 <> 0 THEN page_number END AS page_number,
    CASE WHEN doc_id % 19 = 0 THEN 'video' ELSE modality END AS modality,
    CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE content END AS content, media_path, doc_id FROM ch
)
SELECT chunk_id, 'missing:page_number' AS error FROM f WHERE page_number IS NULL
UNION ALL SELECT chunk_id, 'invalid:modality=video' FROM f WHERE modality = 'video'
UNION ALL SELECT chunk_id, 'invalid:document_type=html' FROM f WHERE document_type = 'html'
UNION ALL SELECT chunk_id, 'no_media:' || media_path FROM f WHERE modality IN ('image-caption', 'table') AND media_path IS NOT NULL
  AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT chunk_id, 'empty:content' FROM f WHERE trim(content) = ''
"""


def duplicates(spark, sf):
    d = I.table(spark, sf, "documents").select(F.concat("source", F.lit("_"), "lang").alias("chunk_id"))
    return duplicate_ids(d)


def stats(spark, sf):
    return corpus_stats(I.chunks(spark, sf))


def by_modality(spark, sf):
    return modality_counts(I.chunks(spark, sf))


def chunk_upsert(spark, sf):
    """Chunks of labelled documents replace their older rows."""
    old = I.chunks(spark, sf).select("chunk_id", "document_name", F.lit(1).alias("version"))
    fresh = I.table(spark, sf, "labels").select(
        F.concat(F.lit("doc_"), "doc_id", F.lit("_p1_c01")).alias("chunk_id"), F.lit("relabelled").alias("document_name"), F.lit(2).alias("version")
    )
    return upsert(old, fresh)


def upsert_deltas(spark, sf):
    """One document in a hundred changes (some twice) and others are new: only the buckets
    of their ids are written again."""
    rows = I.chunks(spark, sf).select("chunk_id", "document_name", F.lit(1).alias("version"))
    number = F.regexp_extract("chunk_id", r"\d+", 0).cast("long")
    table = BucketTable(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", rows.schema)
    table.upsert(rows)
    changed = rows.where(number % 100 == 7)
    twice = changed.where(number % 200 == 7).withColumn("version", F.lit(3))
    added = rows.where(number % 100 == 8).withColumn("chunk_id", F.concat(F.lit("new_"), "chunk_id"))
    table.upsert(changed.withColumn("version", F.lit(2)).unionByName(twice).unionByName(added), order=["version"])
    return table.read()


def ingest_increments(spark, sf):
    """Documents as files that arrive in three batches, taken in by a stream."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table = BucketTable(spark, f"{folder}/table", CHUNK, buckets=64)
    files = I.table(spark, sf, "documents").select(
        "doc_id", F.concat("source", F.lit("_"), "doc_id", F.lit(".txt")).alias("target"), F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content")
    )
    for k in range(3):
        write_media(files.where(F.col("doc_id") % 3 == k), f"{folder}/in")
        ingest_stream(spark, f"{folder}/in", table, f"{folder}/checkpoint", files_per_batch=5_000)
    return table.read().select("chunk_id", F.md5("content").alias("content_md5"), F.col("metadata.word_count").alias("word_count"), F.col("metadata.char_count").alias("char_count"))


def dictionary_match(spark, sf):
    """All words of eight letters or more from the conversations, looked for in every
    document: how many occur, and the first of them by place."""
    found = F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("at", "key")
    words = I.table(spark, sf, "conversations").select("conv_id", "turn", found)
    place = F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("at")
    keys = checkpointed(words.groupBy("key").agg(F.min(place).alias("place")))
    met = with_keys(spread(I.table(spark, sf, "documents").select("doc_id", "text")), F.lower("text"), keys)
    first = met.select("doc_id", F.size("places").alias("n_keys"), F.get("places", F.lit(0)).alias("place"))
    return first.join(keys, "place", "left").select("doc_id", "n_keys", "key")


DICTIONARY_SQL = """
WITH words AS (
  SELECT conv_id, turn, unnest(w) AS key, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{8,}') AS w FROM conversations)
), keys AS (SELECT key, min(conv_id * 1000000 + turn * 10000 + pos) AS place FROM words GROUP BY key
), met AS (SELECT doc_id, count(*) AS n, min_by(key, place) AS key FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN keys ON contains(low, key) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_keys, key FROM documents LEFT JOIN met USING (doc_id)
"""


def media_resolve(spark, sf):
    i = F.col("doc_id")
    d = I.table(spark, sf, "documents")
    path = F.element_at(F.array(F.concat(F.lit("media/fig_"), i, F.lit(".png")), F.concat(F.lit(" 'data\\media\\fig_"), i, F.lit(".png'")), F.concat(F.lit("other/fig_"), i, F.lit(".png"))), (i % 3 + 1).cast("int"))
    return resolve_media(d.select(path.alias("media_path")), _catalog(spark, sf))


MEDIA_SQL = """
SELECT p AS media_path, CASE WHEN k < 2 AND doc_id IN (SELECT doc_id FROM labels) THEN 'data/media/fig_' || doc_id || '.png' END AS resolved
FROM (SELECT doc_id, doc_id % 3 AS k, ['media/fig_' || doc_id || '.png', ' ''data\\media\\fig_' || doc_id || '.png''', 'other/fig_' || doc_id || '.png'][doc_id % 3 + 1] AS p FROM documents)
"""
FAMILIES = ["atmo_heraldry_faction_", "atmo_portrait_character_", "atmo_relic_artifact_", "atmo_creature_creature_", "atmo_landscape_", "atmo_battle_painting_conflict_", "misc_"]


def figure_captions(spark, sf):
    d = I.table(spark, sf, "documents")
    stem = F.concat(I.pick(FAMILIES, F.col("doc_id")), F.lit("lady_"), "source", F.lit("_"), "lang")
    fig = describe_figure(stem)
    return d.select("doc_id", fig["title"].alias("title"), fig["caption"].alias("caption"), fig["content"].alias("content"), F.array_join(fig["entities"], ",").alias("entities"))


FIG_SQL = f"""
SELECT doc_id,
  {lst(['Heraldry Banner — ', 'Portrait — ', 'Relic Illustration — ', 'Bestiary Illustration — ', 'Landscape View — ', 'Historical Battle Painting — ', ''])}[k + 1] || n AS title,
  {lst(['Heraldic Banner of ', 'Portrait of ', 'Relic Plate: ', 'Bestiary Plate: ', 'Landscape Painting of ', 'Battle Painting: ', 'Visual Plate: '])}[k + 1] || n AS caption,
  {lst(['A standard that bears the arms of ', 'The sitter of this picture is ', 'An object of the collection: ', 'An animal study: ', 'The view takes in ', 'The fighting as a painter saw it: ', 'Picture file about '])}[k + 1] || n || '.' AS content,
  n || {lst([',Heraldry,Banner', ',Character Portrait', ',Artifact,Relic', ',Bestiary,Creature', ',Location,Landscape', ',Conflict,Battle Painting', ''])}[k + 1] AS entities
FROM (SELECT doc_id, doc_id % 7 AS k, CASE WHEN doc_id % 7 = 6 THEN 'Misc ' ELSE '' END || 'Lady Src' || substring(source, 4) || ' ' || upper(lang[1]) || lang[2:] AS n FROM documents)
"""
PLATES = [
    Plate("src1_", "First plate", "Caption one", "Content one", ("one",)),
    Plate("src1", "Teen plate", "Caption teen", "Content teen", ("teen", "ten")),
    Plate("7_de", "German plate", "Caption de", "Content de", ()),
]


def plate_match(spark, sf):
    d = I.table(spark, sf, "documents")
    hit = match_plate(F.concat("source", F.lit("_"), "lang"), PLATES)
    return d.select("doc_id", hit["title"].alias("title"), F.size(hit["entities"]).alias("n_entities")).where("title is not null")


PLATE_SQL = """
SELECT doc_id, CASE WHEN contains(k, 'src1_') THEN 'First plate' WHEN contains(k, 'src1') THEN 'Teen plate' ELSE 'German plate' END AS title,
  CASE WHEN contains(k, 'src1_') THEN 1 WHEN contains(k, 'src1') THEN 2 ELSE 0 END AS n_entities
FROM (SELECT doc_id, source || '_' || lang AS k FROM documents) WHERE contains(k, 'src1') OR contains(k, '7_de')
"""

QUERIES = {
    "slug_ids": slug_ids, "source_reliability": reliability, "document_type": doc_type, "token_estimate": tokens,
    "hier_chunk": hier_chunk, "md_sections": md_sections, "txt_titles": txt_titles, "page_sections": page_sections, "dup_ids": dup_ids,
    "index_projection": index_projection, "index_ids": index_unique, "validate_chunks": validate,
    "validate_duplicates": duplicates, "corpus_stats": stats, "modality_counts": by_modality, "chunk_upsert": chunk_upsert,
    "dictionary_match": dictionary_match, "upsert_deltas": upsert_deltas, "ingest_increments": ingest_increments,
    "media_resolve": media_resolve, "figure_captions": figure_captions, "plate_match": plate_match,
}
SQL = {
    "slug_ids": f"SELECT doc_id, {slug_sql(chr(40) + 'source || ' + s(' / ') + ' || text)')} AS slug FROM documents",
    # the rules again, read off the path; documents of one kind of path follow from it only
    "source_reliability": f"""WITH {PATHS}, p AS (SELECT doc_id, lower(path) AS whole, regexp_replace(lower(split_part(path, '/', -1)), '(.)[.][^.]+$', '\\1') AS short FROM paths)
      SELECT doc_id, CASE {' '.join(f"WHEN contains({'whole' if scope == 'path' else 'short'}, {s(needle)}) THEN {s(tier)}" for scope, needle, tier in L.RELIABILITY_CUES)} ELSE 'unknown' END AS reliability,
      CASE WHEN contains(whole, 'chronicles') THEN 'chronicles' WHEN contains(whole, 'codex') THEN 'codex' ELSE 'ephemera' END AS category FROM p""",
    "document_type": f"""WITH {PATHS}, p AS (SELECT doc_id, lower(split_part(path, '/', -1)) AS name FROM paths)
      SELECT doc_id, CASE WHEN contains(name, 'scan') THEN 'scan' WHEN name LIKE '%.pdf' THEN 'pdf' WHEN name LIKE '%.docx' THEN 'docx' WHEN name LIKE '%.md' OR name LIKE '%.markdown' THEN 'md' ELSE 'txt' END AS document_type FROM p""",
    "token_estimate": f"""WITH {CHUNKS} SELECT chunk_id, len(regexp_extract_all(content, '\\S+')) AS n_words,
      greatest(trunc(len(regexp_extract_all(concat_ws(' ', content, caption), '\\S+')) * 1.33::DOUBLE)::INT, 10) AS est_tokens FROM ch""",
    "hier_chunk": HIER_SQL, "md_sections": MD_SQL, "txt_titles": TXT_SQL, "page_sections": PAGE_SQL,
    "dup_ids": """WITH d AS (SELECT doc_id, source || CASE WHEN doc_id % 9 = 4 THEN '_dup' || (doc_id % 6 + 1) ELSE '' END AS id FROM documents),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1 AS k FROM d),
      free AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY n) AS k
        FROM (SELECT id, unnest(range(1, (SELECT count(*) FROM documents))) AS n FROM (SELECT DISTINCT id FROM d)) WHERE id || '_dup' || n NOT IN (SELECT id FROM d))
      SELECT doc_id, CASE WHEN k = 0 THEN id ELSE id || '_dup' || n END AS chunk_id FROM r LEFT JOIN free USING (id, k)""",
    "index_projection": f"""WITH {CHUNKS} SELECT chunk_id, document_name, 'txt' AS document_type, 1 AS page_number, section_title, modality,
      coalesce(media_path, '') AS media_path, coalesce(caption, '') AS caption, source_reliability,
      md5(CASE WHEN doc_id % 7 <> 0 AND trim(content, ' ' || chr(10)) <> '' THEN trim(content, ' ' || chr(10))
        WHEN caption IS NOT NULL THEN 'Visual plate caption: ' || caption ELSE 'Document passage from ' || document_name END) AS document_md5 FROM ch""",
    "index_ids": """WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang = 'es' ORDER BY doc_id) AS n FROM documents)
      SELECT doc_id, CASE WHEN lang <> 'es' AND n = 1 THEN source ELSE 'chunk_' || CASE WHEN doc_id < 100000 THEN right('0000' || doc_id, 5) ELSE doc_id::VARCHAR END
        || '_' || left(source || '_' || lang || '.txt', 10) END AS chunk_id FROM r""",
    "validate_chunks": VALID_SQL,
    "validate_duplicates": "SELECT source || '_' || lang AS chunk_id, 'duplicate' AS error FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) > 1",
    "corpus_stats": "SELECT count(*) AS total_chunks, count(*) FILTER (doc_id % 5 = 0) AS figures_count, count(*) FILTER (doc_id % 5 = 1) AS tables_count, count(DISTINCT source || '_' || doc_id) AS documents FROM documents",
    "modality_counts": f"WITH {CHUNKS} SELECT modality, count(*) AS n_chunks FROM ch GROUP BY modality",
    "chunk_upsert": f"""WITH {CHUNKS} SELECT chunk_id, document_name, 1 AS version FROM ch WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'doc_' || doc_id || '_p1_c01', 'relabelled', 2 FROM labels""",
    "dictionary_match": DICTIONARY_SQL,
    "upsert_deltas": f"""WITH {CHUNKS} SELECT chunk_id, document_name, CASE WHEN doc_id % 200 = 7 THEN 3 WHEN doc_id % 100 = 7 THEN 2 ELSE 1 END AS version FROM ch
      UNION ALL SELECT 'new_' || chunk_id, document_name, 1 FROM ch WHERE doc_id % 100 = 8""",
    # stored chunks are stripped, and so are their counts
    "ingest_increments": HIER_SQL.replace("length(content) AS char_count", "length(trim(content)) AS char_count").replace("trim(content)", "trim(content, ' ' || chr(10))"),
    "media_resolve": MEDIA_SQL, "figure_captions": FIG_SQL, "plate_match": PLATE_SQL,
}
