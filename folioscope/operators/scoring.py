"""Sums of the terms that chunks hold, for all questions at once, in the task that found them.

Hits arrive chunk by chunk.  Every task adds them up by question and keeps what can still
be among the best ``k``, so that neither hits nor pairs of question and chunk are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

# Hits that are added up together; pairs, by asked chunk, that wait for the next cut.
TOGETHER, WAITING = 200_000, 8
# Scores this near may be equal or change places when rounded to four digits.
NEAR = 2e-4
SUMS = "q int, chunk_id string, traits int, words double, field_bits int, entity_points double, entities_matched long"
SHAPE = pa.schema([
    ("q", pa.int32()), ("chunk_id", pa.string()), ("traits", pa.int32()), ("words", pa.float64()), ("field_bits", pa.int32()),
    ("entity_points", pa.float64()), ("entities_matched", pa.int64()),
])


def numbered_terms(terms: pd.DataFrame, totals: pd.DataFrame, keys: list[str], codes: dict[str, int]) -> tuple[pd.DataFrame, dict]:
    """(token, kind, pattern, phrase, term) of the different terms, and arrays that tell
    which questions and entities a ``term`` counts for."""
    same = ["token", "kind", "pattern", "phrase"]
    places = totals[keys].assign(q=np.arange(len(totals)))
    t = terms.merge(places, on=keys)
    t["term"] = t.groupby(same, dropna=False, sort=False).ngroup()
    t = t.sort_values("term", kind="stable")
    entities = t[["q", "ent", "n_tok"]].drop_duplicates(["q", "ent"]).reset_index(drop=True)
    t = t.merge(entities[["q", "ent"]].assign(e=np.arange(len(entities))), on=["q", "ent"]).sort_values("term", kind="stable")
    kind = t["kind"].to_numpy()
    shares = {
        "starts": np.concatenate([[0], np.cumsum(np.bincount(t["term"], minlength=0))]).astype(np.int64),
        "q": t["q"].to_numpy(np.int64), "e": t["e"].to_numpy(np.int64), "weight": t["weight"].to_numpy(np.int64),
        "is_word": kind == codes["word"], "is_field": kind == codes["field"], "is_token": kind == codes["token"],
        "e_q": entities["q"].to_numpy(np.int64), "e_tokens": entities["n_tok"].to_numpy(np.int64),
        **{c: totals[c].to_numpy(np.float64) for c in ("n_entities", "n_fields", "n_words", "target_code", "boost")},
        "k": totals["k"].fillna(0).to_numpy(np.int64),
    }
    return t[[*same, "term"]].drop_duplicates("term"), shares


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different ``keys``, rising, and the sums of each of ``values`` by key."""
    known, at = np.unique(keys, return_inverse=True)
    return known, *[np.bincount(at, v, len(known)) for v in values]


def pair_sums(chunk: np.ndarray, term: np.ndarray, points: np.ndarray, s: dict) -> dict[str, np.ndarray]:
    """Sums by (``chunk``, question) of hits, each of a ``term`` with the ``points`` of its place."""
    first, n = s["starts"][term], s["starts"][term + 1] - s["starts"][term]
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    chunk, points, q, e, weight = np.repeat(chunk, n), np.repeat(points, n), s["q"][at], s["e"][at], s["weight"][at]
    n_q, n_e = len(s["boost"]), len(s["e_q"])
    word, field, token = s["is_word"][at], s["is_field"][at], s["is_token"][at]
    phrase = ~(word | field | token)
    # each family of fields once
    seen = np.unique(np.stack([(chunk * n_q + q)[field], weight[field]]), axis=1) if field.any() else np.zeros((2, 0), np.int64)
    pair_e, hits, phrases = _summed((chunk * n_e + e)[token | phrase], (weight * token)[token | phrase], phrase[token | phrase])
    c_e, e = np.divmod(pair_e, n_e)
    whole = (s["e_tokens"][e] > 0) & (hits == s["e_tokens"][e])
    gained = np.where(phrases > 0, 8.0, np.where(whole, 5.0, hits * 1.5))
    keys = np.concatenate([(chunk * n_q + q)[word], seen[0], c_e * n_q + s["e_q"][e]])
    parts = [len(keys) - len(seen[0]) - len(e), len(seen[0]), len(e)]

    def at_part(i: int, values: np.ndarray) -> np.ndarray:
        return np.concatenate([values if i == j else np.zeros(size) for j, size in enumerate(parts)])

    pair, words, bits, fields, entity, matched = _summed(
        keys, at_part(0, (weight * points)[word]), at_part(1, seen[1]), at_part(1, np.ones(parts[1])), at_part(2, gained), at_part(2, (phrases > 0) | whole)
    )
    return {"chunk": pair // n_q, "q": pair % n_q, "words": words, "bits": bits, "fields": fields, "entity": entity, "matched": matched}


def scores(p: dict[str, np.ndarray], traits: np.ndarray, s: dict, image: int) -> np.ndarray:
    """Relevance of pairs before it is rounded; 0 without points."""
    q = p["q"]
    total = p["entity"] + 3.0 * p["fields"] + p["words"]
    missed = (s["n_entities"][q] > 0) & (p["matched"] == 0) & (s["n_words"][q] > 0)
    ceiling = np.maximum(s["n_entities"][q] * 8.0 + s["n_fields"][q] * 3.0 + s["n_words"][q] * 2.0, 1.0)
    near = np.minimum(1.0, np.where(missed, total * 0.15, total) / ceiling)
    lift = np.where(traits // 2 == s["target_code"][q], s["boost"][q], np.where((s["target_code"][q] == image) & (traits % 2 == 1), 1.3, 1.0))
    return near * lift


def cut(held: dict[str, np.ndarray], s: dict, least: np.ndarray, max_k: int) -> dict[str, np.ndarray]:
    """``held`` without pairs that can't be among the best; ``least`` rises to what is
    needed. Of equal scores the smallest chunk ids stay, as many as a question asks for."""
    order = np.lexsort((-held["score"], held["q"]))
    q = held["q"][order]
    k = np.minimum(s["k"], max_k)
    place = np.arange(len(q)) - np.searchsorted(q, q)
    last = place == k[q] - 1
    least[q[last]] = np.maximum(least[q[last]], held["score"][order][last])
    open_ = (held["score"] >= least[held["q"]] - NEAR) & (k[held["q"]] > 0)
    held = {c: v[open_] for c, v in held.items()}
    if len(held["q"]) > WAITING // 2 * max(1, int(k.sum())):
        ids = held["chunk_id"]
        by_id = np.empty(len(ids), np.int64)
        by_id[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or ""))] = np.arange(len(ids))
        order = np.lexsort((by_id, -held["score"], held["q"]))
        q, score = held["q"][order], held["score"][order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (score[1:] != score[:-1])])
        starts = np.flatnonzero(new)
        place = np.arange(len(q)) - starts[np.cumsum(new) - 1]
        held = {c: v[order[place < k[q]]] for c, v in held.items()}
    return held


def best_sums(batches: Iterator[pa.RecordBatch], s: dict, max_k: int, image: int) -> Iterator[pa.RecordBatch]:
    """The sums of pairs that may be among a question's best, of hits (no, chunk_id,
    traits, term, points) with rising chunk numbers ``no``."""
    least, held, wait, n, last = np.full(len(s["boost"]), -np.inf), None, [], 0, -1
    limit = WAITING * max(1, int(np.minimum(s["k"], max_k).sum()))

    def take(rows: pa.Table) -> None:
        nonlocal held
        no = rows["no"].to_numpy()
        if (no[1:] < no[:-1]).any():
            raise ValueError("the hits of a chunk must come together")
        first = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]]))
        ordinal = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(no))))
        p = pair_sums(ordinal, rows["term"].to_numpy(), rows["points"].to_numpy(), s)
        traits = rows["traits"].to_numpy()[first][p["chunk"]]
        p |= {"traits": traits, "score": scores(p, traits, s, image)}
        open_ = (p["score"] >= least[p["q"]] - NEAR) & (p["score"] > 0)
        at = first[p.pop("chunk")[open_]]
        p = {c: v[open_] for c, v in p.items()} | {"chunk_id": np.array(rows["chunk_id"].take(pa.array(at)).to_pylist(), dtype=object)}
        held = p if held is None else {c: np.concatenate([held[c], p[c]]) for c in p}
        if len(held["q"]) > limit:
            held = cut(held, s, least, max_k)

    for batch in batches:
        if not batch.num_rows:
            continue
        wait.append(batch)
        n += batch.num_rows
        if n < TOGETHER:
            continue
        rows = pa.Table.from_batches(wait)
        no = rows["no"].to_numpy()
        # the last chunk may go on in the next batch
        end = int(np.flatnonzero(no != no[-1])[-1]) + 1 if (no != no[-1]).any() else 0
        if end:
            if no[0] < last:
                raise ValueError("the hits of a chunk must come together")
            last = no[end - 1]
            take(rows.slice(0, end))
        wait = rows.slice(end).to_batches()
        n -= end
    if wait:
        take(pa.Table.from_batches(wait))
    if held is not None:
        held = cut(held, s, least, max_k)
        names = {"field_bits": "bits", "entity_points": "entity", "entities_matched": "matched"}
        yield from pa.Table.from_arrays([pa.array(held[names.get(f.name, f.name)], from_pandas=True).cast(f.type) for f in SHAPE], schema=SHAPE).to_batches()
