"""Personal data: base patterns and a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import column, small_batches

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'`,;:!?()[]{}<>.*#$%&|="

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four base patterns, leftmost and non-overlapping within a kind,
    by start and kind. Every pattern is followed in linear time."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            end = found.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", end)
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, 1, stop))
            at = stop + 1
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


Candidate = tuple[int, int, int, int]  # first and last number among the words, start, end


def tokens(text: str) -> list[Candidate]:
    """The variables of the random field: words with an ASCII digit or "@", without the
    punctuation around them. Neighbouring groups of digits with one space between them
    are one variable if they have 7 to 19 digits together. All other words are none."""
    out: list[Candidate] = []
    group: list[Candidate] = []

    def close() -> None:
        n = sum(c.isdigit() for _, _, start, end in group for c in text[start:end]) if len(group) > 1 else 0
        out.extend([(group[0][0], group[-1][1], group[0][2], group[-1][3])] if 7 <= n <= 19 else group)
        group.clear()

    for number, m in enumerate(TOKEN.finditer(text)):
        word = m[0]
        if not HAS_VARIABLE.search(word):
            continue
        body = word.strip(EDGE)
        if not body:
            continue
        start = m.start() + word.index(body)
        digits = DIGIT_GROUP.match(body)
        if group and not (digits and body[0] != "+" and group[-1][1] == number - 1 and text[group[-1][3] : start].strip("()") == " "):
            close()
        (group if digits else out).append((number, number, start, start + len(body)))
    if group:
        close()
    return out


DIGIT_GROUP = re.compile(r"\+?[0-9().-]+\Z")
HAS_VARIABLE = re.compile(r"[0-9@]")
FEATURES = 30


def pattern(body: str, before: str) -> int:
    """Binary features of a word and the word before it, as bits."""
    digits = sum("0" <= c <= "9" for c in body)
    letters = sum(c.isalpha() for c in body)
    dots, dashes = body.count("."), body.count("-")
    parts = body.split(".")
    numeric = len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    compact = body.replace("-", "").replace(" ", "")
    tests = [
        True, "@" in body, body.startswith("+"), numeric, dots == 1, dots == 3, dots > 3, dashes == 1, dashes > 1, letters == 0, 0 < letters <= digits,
        letters > digits, digits == 0, 0 < digits < 4, digits == 4, 5 <= digits < 7, 7 <= digits < 9, 9 <= digits < 12, 12 <= digits < 20, digits > 19,
        compact.isdigit() and 12 <= len(compact) < 20 and luhn(compact), "(" in body or ")" in body, "=" in body or "/" in body, "_" in body,
        "@" in body and "." in body.rpartition("@")[2], before.startswith("+"), before.strip("()-").isdigit(), before == "", len(body) > 24, ":" in body,
    ]
    return sum(1 << k for k, yes in enumerate(tests) if yes)


def alike(body: str) -> str:
    """What a word shares with those that mean the same: the part before "@", four
    numbers of an address however they are parted, the last seven digits of a number, or
    the word itself, letter case aside."""
    if "@" in body:
        return "@" + body.partition("@")[0].lower()
    four = re.findall(r"[0-9]+", body)
    if len(four) == 4 and all(len(n) < 4 and int(n) < 256 for n in four):
        return ".".join(str(int(n)) for n in four)
    digits = "".join(four)
    return digits[-7:] if len(digits) >= 7 else body.lower()


def unmarked(body: str, before: str, kind: int) -> int:
    """Pattern of a base match as if written without the mark that tells its kind."""
    if kind == 0:
        local, _, domain = body.partition("@")
        return pattern(f"{local}@{domain.replace('.', '')}", before)
    if kind == 1:
        return pattern(body.replace(".", "-"), before)
    if kind == 2:
        return pattern(body, before) & ~(1 << 20)
    return pattern(body.lstrip("+"), before.lstrip("+"))


def links(bodies: list[str], found: list[Candidate]) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between neighbouring variables, and skip edges from each variable to
    the last one alike. Both make paths and are linear in the words."""
    chain = [(k - 1, k) for k in range(1, len(found)) if found[k][0] == found[k - 1][1] + 1]
    skip, last = [], {}
    for k, key in enumerate(map(alike, bodies)):
        if key in last:
            skip.append((last[key], k))
        last[key] = k
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def parts(text: str) -> tuple[list[Candidate], list[str], list[str], list[Span]]:
    """Variables, their words, the variables just before them, and the base spans of a text."""
    base, found = base_spans(text), tokens(text)
    bodies = [text[f[2] : f[3]] for f in found]
    before = [bodies[k - 1] if k and found[k - 1][1] == f[0] - 1 else "" for k, f in enumerate(found)]
    return found, bodies, before, base


def patterns(bodies: list[str], before: list[str]) -> np.ndarray:
    return np.array([pattern(a, b) for a, b in zip(bodies, before)], np.int64)


def covered(found: list[Candidate], base: list[Span]) -> np.ndarray:
    """Label of each variable: the kind of the first base span that overlaps it."""
    label, at = np.zeros(len(found), np.int64), 0
    for k, (_, _, start, end) in enumerate(found):
        while at < len(base) and base[at][2] <= start:
            at += 1
        for span in base[at:]:
            if span[0] >= end:
                break
            if span[2] > start:
                label[k] = span[1] + 1
                break
    return label


# Messages of a document that change by less have settled.
SETTLED = 1e-5
# Log messages and potentials below are taken as this.
LOWEST = -60.0


def roots(edges: np.ndarray, n: int) -> np.ndarray:
    """The first node of each node's path; ``edges`` lead from earlier to later nodes."""
    root = np.arange(n)
    root[edges[:, 1]] = edges[:, 0]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def unit(x: np.ndarray) -> np.ndarray:
    return x / x.max(-1, keepdims=True)


def forward(local: np.ndarray, follows: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Messages that reach each node from the one before it in its path, exactly.

    Nodes stand path after path; ``follows`` says which continue the path of the node
    before. The row is cut in about sqrt(n) blocks that are followed side by side: first
    what each block does to any message, then the messages themselves."""
    n, k = local.shape
    width = int(np.sqrt(n)) + 1
    blocks = -(-n // width)
    spare = blocks * width - n
    e = np.concatenate([local, np.ones((spare, k))]).reshape(blocks, width, k)
    goes = np.concatenate([follows[1:], np.zeros(spare + 1, bool)]).reshape(blocks, width)
    effect = np.tile(np.eye(k), (blocks, 1, 1))
    for t in range(width):
        q = effect * e[:, t, None, :]
        effect = np.where(goes[:, t, None, None], q @ pair, q.sum(2, keepdims=True))
        effect /= effect.max((1, 2), keepdims=True)
    message = np.ones((blocks, k))
    for b in range(1, blocks):
        message[b] = unit(message[b - 1] @ effect[b - 1])
    out = np.empty((blocks, width, k))
    for t in range(width):
        out[:, t] = message
        message = np.where(goes[:, t, None], unit((message * e[:, t]) @ pair), 1.0)
    return out.reshape(-1, k)[:n]


def along(local: np.ndarray, root: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log messages that reach each node over the paths of ``root``, from both sides."""
    order = np.lexsort((np.arange(len(root)), root))
    same = root[order][1:] == root[order][:-1]
    out = np.zeros_like(local)
    if same.any():
        e = np.exp(np.maximum(local - local.max(1, keepdims=True), LOWEST))[order]
        there = forward(e, np.append(False, same), pair)
        back = forward(e[::-1], np.append(False, same[::-1]), pair.T)[::-1]
        both = np.log(there) + np.log(back)
        out[order] = np.maximum(both - both.max(1, keepdims=True), LOWEST)
    return out


@dataclass(frozen=True)
class Field:
    """Log potentials: weights of word features by label, and of label pairs."""

    weight: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, codes: np.ndarray, chain: np.ndarray, skip: np.ndarray, document: np.ndarray | None = None, observed: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
        """Label probabilities by loopy sum-product message passing.

        Labels above 0 in ``observed`` are given. Chain and skip edges each make paths. A round passes all messages along every
        chain and then along every skip path, so evidence reaches all mentions at once and
        what has edges of one sort only is exact after a round. Rounds go on for the
        documents (``document``: numbers by variable) whose messages have not settled,
        from the tenth on by half steps, ``rounds`` at most."""
        kinds, which = np.unique(codes, return_inverse=True)
        node = (bits(kinds) @ self.weight)[which]
        n = len(node)
        if observed is not None:
            given = np.flatnonzero(observed)
            node[given] = LOWEST
            node[given, observed[given]] = 0
        document = np.zeros(n, np.int64) if document is None else document
        ways = [(roots(chain, n), np.exp(self.chain)), (roots(skip, n), np.exp(self.skip))]
        inward = np.zeros((2, n, len(LABELS)))
        joined = np.zeros(document.max(initial=-1) + 1, bool)
        joined[document[chain[:, 0]]] = True
        both = np.zeros_like(joined)
        both[document[skip[:, 0]]] = True
        at = np.flatnonzero((joined | both)[document])
        for number in range(rounds):
            if not len(at):
                break
            moved = np.zeros(len(joined))
            for way, (root, pair) in enumerate(ways):
                new = along(node[at] + inward[1 - way][at], root[at], pair)
                if number >= 10:
                    new = (new + inward[way][at]) / 2
                np.maximum.at(moved, document[at], np.abs(new - inward[way][at]).max(1))
                inward[way][at] = new
            at = at[((moved >= SETTLED) & joined & both)[document[at]]]
        return softmax(node + inward.sum(0))


def bits(codes: np.ndarray) -> np.ndarray:
    return ((codes[:, None] >> np.arange(FEATURES)) & 1).astype(float)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, text: str = "text", bound: int | None = None, steps: int = 300, hidden: float = 0.3, contrast: int = 2, agree: float = 0.9) -> Field:
    """Piecewise training on the base matches of all texts: words are counted by
    feature pattern and label, neighbours and repeats by label pair.

    A share ``hidden`` of the base matches (by a hash of the word) is learnt without the
    mark that tells its kind, beside ``contrast`` words of the same look that are none:
    such a word isn't taken by its look, but its kind is open to what its like say. A
    word outside the base matches that is alike one in its document has no known label
    and is not counted. Where the texts hold no repeats, those alike share a label in
    ``agree`` of all cases. The driver gets the counts of all patterns that occur, whose
    number the tests of ``pattern`` limit and not the rows (``bound``: the most frequent
    only), and the 50 counts of pairs."""
    small_batches()
    given = docs.select(column(docs, text).alias("text")).where(F.col("text").rlike("[0-9@]"))

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen: Counter[tuple[str, int, int]] = Counter()
            for text in frame["text"]:
                found, bodies, before, base = parts(text)
                label = covered(found, base)
                chain, skip = links(bodies, found)
                root = roots(skip, len(found))
                telling = np.zeros(len(found), bool)
                telling[root[label > 0]] = True
                known = (label > 0) | ~telling[root]
                for k in np.flatnonzero(known).tolist():
                    kind = int(label[k])
                    if kind and crc32(bodies[k].encode()) < hidden * 2**32:
                        code = unmarked(bodies[k], before[k], kind - 1)
                        seen["word", code, 0] += contrast
                        seen["none", 0, 0] += contrast
                    else:
                        code = pattern(bodies[k], before[k])
                    seen["word", code, kind] += 1
                for what, pairs in (("chain", chain), ("skip", skip)):
                    seen.update((what, a, b) for a, b in label[pairs[known[pairs].all(1)]].tolist())
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["what", "a", "b", "n"])

    counts = given.mapInPandas(counted, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("what") == "word", F.desc("n"), "a", "b")
    rows = (rows if bound is None else rows.limit(bound)).collect()
    words = [r for r in rows if r["what"] == "word"]
    weight = np.zeros((FEATURES, len(LABELS)))
    if words:
        x, y = bits(np.array([r["a"] for r in words])), np.array([r["b"] for r in words])
        n = np.array([r["n"] for r in words], float)
        n, goal = n / n.sum(), np.eye(len(LABELS))[y]
        moment = np.full_like(weight, 1e-8)
        for _ in range(steps):
            slope = x.T @ ((softmax(x @ weight) - goal) * n[:, None]) + 1e-5 * weight
            moment += slope**2
            weight -= 0.5 * slope / np.sqrt(moment)
    alone = np.full(len(LABELS), 0.5)
    for r in words:
        alone[r["b"]] += r["n"]
    alone[0] -= sum(r["n"] for r in rows if r["what"] == "none")
    alone /= alone.sum()
    chance = np.outer(alone, alone)
    priors = {"chain": np.full_like(chance, 0.5), "skip": 10 * (agree * np.diag(alone) + (1 - agree) * chance)}
    pairs = {}
    for what, joint in priors.items():
        for r in rows:
            if r["what"] == what:
                joint[r["a"], r["b"]] += r["n"]
        joint = (joint + joint.T) / 2 if what == "skip" else joint
        # what two ends tell about each other, beyond how often such ends have a label
        joint /= joint.sum()
        pairs[what] = np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -4, 4)
    return Field(weight, pairs["chain"], pairs["skip"])


# Variables of the texts that are worked on together; a text is never cut.
TOGETHER = 50_000


def find_all(field: Field, texts: Iterable[str | None], sure: float = 0.5) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, spans the random field adds) of each whole text. A variable outside
    all base spans is added if its label has a probability of ``sure`` at least;
    neighbouring ones of one kind make one span."""
    held, size = [], 0
    for text in texts:
        held.append(parts(text) if text and HAS_VARIABLE.search(text) else ([], [], [], []))
        size += len(held[-1][0])
        if size >= TOGETHER:
            yield from decided(field, held, sure)
            held, size = [], 0
    yield from decided(field, held, sure)


def decided(field: Field, held: list[tuple[list[Candidate], list[str], list[str], list[Span]]], sure: float) -> Iterator[tuple[list[Span], list[Span]]]:
    sizes = [len(found) for found, *_ in held]
    first = np.cumsum([0, *sizes])
    none = np.zeros((0, 2), np.int64)
    edges = [links(bodies, found) for found, bodies, *_ in held]
    chain, skip = (np.concatenate([none, *(e[way] + at for e, at in zip(edges, first))]) for way in (0, 1))
    codes = np.concatenate([np.zeros(0, np.int64), *(patterns(bodies, before) for _, bodies, before, _ in held)])
    known = np.concatenate([np.zeros(0, np.int64), *(covered(found, base) for found, _, _, base in held)])
    # base matches are certain
    belief = field.beliefs(codes, chain, skip, np.repeat(np.arange(len(held)), sizes), known)
    kinds, tops = belief.argmax(1).tolist(), belief.max(1).tolist()
    for (found, _, _, base), at in zip(held, first.tolist()):
        more: list[Span] = []
        last = -2
        for k, (begin, stop, start, end) in enumerate(found, at):
            kind = kinds[k]
            if known[k] or not kind or tops[k] < sure:
                continue
            if more and last == begin - 1 and more[-1][1] == kind - 1:
                more[-1] = (more[-1][0], kind - 1, end)
            else:
                more.append((start, kind - 1, end))
            last = stop
        yield base, more


def find(field: Field, text: str | None, sure: float = 0.5) -> tuple[list[Span], list[Span]]:
    """``find_all`` of one text."""
    return next(find_all(field, [text], sure))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def personal_data(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) per row.

    Spans are kind:start:end in code points, end exclusive, by start and kind. Null and
    empty texts have none. A null id stays null, repeated rows repeat, other columns
    are ignored, an empty table gives no row."""
    small_batches()
    given, content = column(docs, doc_id), column(docs, text)
    rows = docs.select(given.isNotNull().alias("named"), F.coalesce(given.cast("long"), F.lit(0)).alias("doc_id"), F.when(content.rlike("[0-9@]"), content).alias("text"))

    def searched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for base, more in find_all(field, frame["text"]):
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))] if base else [0] * len(KINDS)
                out.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more)))
            yield pd.concat([frame[["named", "doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])], axis=1)

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    out = rows.mapInPandas(searched, f"named boolean, doc_id long, {kinds}, base_sha256 string, spans string, n_added long")
    return out.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def masked(field: Field, text: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; null stays null."""
    small_batches()

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text, (base, more) in zip(batch, find_all(field, batch)):
                pieces, at = [], 0
                for start, kind, end in sorted(base + more):
                    if end > at:
                        pieces += [text[at : max(at, start)], f"<{KINDS[kind].upper()}>" if start >= at else ""]
                        at = end
                out.append("".join([*pieces, text[at:]]) if pieces else None)
            yield pd.Series(out, dtype=object)

    return F.coalesce(mask(F.when(text.rlike("[0-9@]"), text)), text)
