"""Fragments of the reference SQL (DuckDB dialect), independent of the library's code."""

from __future__ import annotations

from collections.abc import Iterable

from folioscope import lexicon as L
from registry.inputs import PATH_PREFIXES, RELIABILITIES, TRIGGERS


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values: Iterable[str]) -> str:
    return "[" + ", ".join(s(v) for v in values) + "]"


def ascii_words(x: str) -> str:
    """Words with an accented letter become '#', so ASCII word boundaries hold."""
    return f"regexp_replace({x}, '[\\p{{L}}\\p{{N}}_]*[\\x{{C0}}-\\x{{24F}}][\\p{{L}}\\p{{N}}_]*', '#', 'g')"


def tokens(masked: str, stop: Iterable[str] = ()) -> str:
    found = f"regexp_extract_all({masked}, '\\b[a-zA-Z0-9_\\-]{{3,}}\\b')"
    return f"list_filter({found}, lambda t: NOT list_contains({lst(sorted(set(stop)))}, t))" if stop else found


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


def hit(masked: str, pattern: str) -> str:
    return f"regexp_matches({masked}, {s(pattern)})"


def any_hit(masked: str, patterns: Iterable[str]) -> str:
    return "(" + " OR ".join(hit(masked, p) for p in patterns) + ")"


def count_hits(masked: str, patterns: Iterable[str]) -> str:
    return "(" + " + ".join(f"{hit(masked, p)}::INT" for p in patterns) + ")"


def any_in(x: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(n)})" for n in needles) + ")"


def alternation(values: Iterable[str]) -> str:
    return r"\b(?:" + "|".join(values) + r")\b"


def fields(masked: str) -> str:
    cases = ", ".join(f"CASE WHEN {hit(masked, alternation(a))} THEN {s(f)} END" for f, a in L.FIELD_ALIASES.items())
    return f"list_filter([{cases}], lambda f: f IS NOT NULL)"


def fields_in(asked: str, masked: str) -> str:
    """Those of the ``asked`` families that ``masked`` mentions."""
    cases = ", ".join(
        f"CASE WHEN list_contains({asked}, {s(f)}) AND {hit(masked, alternation(a))} THEN {s(f)} END"
        for f, a in L.FIELD_ALIASES.items()
    )
    return f"list_filter([{cases}], lambda f: f IS NOT NULL)"


def first_of_each(values: str) -> str:
    """Case-insensitive de-duplication, first spelling kept."""
    low = f"list_transform({values}, lambda y: lower(y))"
    return f"list_filter({values}, lambda x, i: list_position({low}, lower(x)) = i)"


_ALIASES = "|".join(a for aliases in L.FIELD_ALIASES.values() for a in aliases)
_CUTS = (L.PHRASE_LEAD, L.PHRASE_FIELDS.replace("ALIASES", _ALIASES), L.PHRASE_PREPOSITION)


def clean(p: str) -> str:
    out = f"trim(trim({p}), {s(',.?!' + chr(34) + chr(39))})"
    for pattern in _CUTS:
        out = f"trim(regexp_replace({out}, {s(pattern)}, '', 'i'))"
    return out


def entity_ctes(source: str, out: str = "qf") -> str:
    """CTEs turning ``source(query_id, question)`` into ``out`` with its features.

    Covers quoted and Title-Case entities and the leftover-word fallback.
    """
    stop = sorted(set(L.ENTITY_STOP) | set(L.ENTITY_CORPUS_STOP))
    alias_words = sorted({w for aliases in L.FIELD_ALIASES.values() for a in aliases for w in a.split()})
    generic = sorted(set(L.ENTITY_STOP) | set(alias_words))
    return f"""
{out}_0 AS (
  SELECT *, {ascii_words('question')} AS m, {ascii_words('lower(question)')} AS ml FROM {source}
), {out}_1 AS (
  SELECT *,
    list_filter(list_transform(regexp_extract_all(question, '["''](.*?)["'']', 1), lambda e: trim(e)),
      lambda e: length(e) >= 3 AND NOT list_contains({lst(stop)}, lower(e))) AS quoted,
    list_filter(list_transform(regexp_extract_all(m, '\\b[A-Z][a-zA-Z0-9_\\-]*(?:\\s+[A-Z][a-zA-Z0-9_\\-]*)*\\b'), lambda p: {clean('p')}),
      lambda e: length(e) >= 3 AND NOT list_contains({lst(stop)}, lower(e))
        AND NOT list_has_all({lst(generic)}, regexp_split_to_array(lower(e), '\\s+'))) AS runs,
    list_filter({tokens('m')}, lambda t: NOT list_contains({lst(stop)}, lower(t)) AND NOT list_contains({lst(alias_words)}, lower(t))) AS leftover
  FROM {out}_0
), {out}_2 AS (
  SELECT *, list_concat(quoted, list_filter({first_of_each('runs')},
      lambda e: NOT list_contains(list_transform(quoted, lambda y: lower(y)), lower(e)))) AS proper
  FROM {out}_1
), {out} AS (
  SELECT *, CASE WHEN len(proper) > 0 THEN proper
                 WHEN len(leftover) > 0 THEN [array_to_string(leftover, ' ')] ELSE []::VARCHAR[] END AS entities,
         {fields('ml')} AS fields
  FROM {out}_2
)"""


def pick(values: Iterable[str], key: str) -> str:
    values = list(values)
    return f"{lst(values)}[({key}) % {len(values)} + 1]"


CHUNKS = f"""ch AS (
  SELECT doc_id, 'doc_' || doc_id || '_p1_c01' AS chunk_id, source || '_' || doc_id || '.txt' AS document_name,
    'txt' AS document_type, 1 AS page_number, 'Section ' || lang AS section_title,
    CASE doc_id % 5 WHEN 0 THEN 'image-caption' WHEN 1 THEN 'table' ELSE 'text' END AS modality, text AS content,
    CASE WHEN doc_id % 5 = 0 THEN 'media/fig_' || doc_id || '.png' END AS media_path,
    CASE WHEN doc_id % 5 = 0 THEN 'Figure of ' || source END AS caption,
    {pick(RELIABILITIES, 'doc_id')} AS source_reliability
  FROM documents
)"""
PATHS = f"""paths AS (
  SELECT doc_id, text, lang, source, {pick(PATH_PREFIXES, 'doc_id')} || source || '_' || doc_id
    || {pick(['.md', '.pdf', '.docx', '.scan.pdf', '.markdown', '.txt', '.TXT'], 'doc_id')} AS path FROM documents
)"""
ROUTED = f"""routed AS (
  SELECT conv_id * 1000 + turn AS query_id, {pick(TRIGGERS, 'conv_id * 7 + turn')} || text AS question FROM conversations
)"""
ASKED = rf"""asked AS (
  SELECT conv_id * 1000 + turn AS query_id, conv_id, turn,
    {pick(TRIGGERS, 'conv_id * 7 + turn')} || '"' || (list_max(list_transform(regexp_extract_all(d.text, '\p{{L}}+'), lambda w: {{'n': length(w), 'word': w}}))).word || '" ' || c.text AS question
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user'
)"""
# Every question meets the ten chunks of its conversation's block of documents.
CANDIDATES = f"""{CHUNKS}, {ASKED}, {entity_ctes('asked')}, cand AS (
  SELECT qf.query_id, qf.question, qf.entities, qf.fields, qf.m, qf.ml, ch.*,
    ((conv_id * 7 + j * 13 + turn * 3) % 100) / 100.0::DOUBLE AS raw_similarity,
    round_even((((conv_id * 7 + j * 13 + turn * 3) % 100) / 100.0::DOUBLE) * [1.0::DOUBLE, 1.4, 1.6][j % 3 + 1], 4) AS relevance_score,
    (j + 1)::INT AS rank
  FROM qf, unnest(range(10)) AS u(j) JOIN ch ON ch.doc_id = conv_id * 10 + j
)"""
