"""Personal data by weak supervision.

Patterns propose spans, strict ones (the base kinds) and looser ones. Labelers
vote on each span: patterns and check sums, gazetteers of domains, prefixes and
reserved numbers, and words in its context. A first pass over all rows counts
how often each combination of votes and features occurs; the number of
combinations is bounded by the labelers, not by the rows. From the counts
expectation-maximisation estimates each labeler's reliability without any
labels, and a logistic regression over votes and features is trained on its
posteriors. A second pass reports the base spans and those that the classifier
accepts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import released, ship, table, text_of, type_of

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 32
#: Fixed gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz ch at it nl".split())
CARD_HEADS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "2221", "2720")
CONTEXT_WORDS = {
    "email": re.compile(r"mail|contact|write|schreib|correo|courriel|address|adresse", re.A | re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|serveur|servidor", re.A | re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|carte|tarjeta|amex", re.A | re.I),
    "phone": re.compile(r"phone|call|tel|mobil|fax|anruf|appel|llam", re.A | re.I),
}
AGAINST_WORDS = re.compile(r"version|isbn|order|invoice|page|chapter|figure|sku|serial|build", re.A | re.I)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_DIGIT = re.compile(r"[0-9]")

#: Labelers, in the order of their votes: pattern, check, gazetteer, context, counter-context, edges.
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern: each @ is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of every span that a pattern proposes."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b, True
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                at, parts = m.start(), m[0].split(".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = at + sum(map(len, four)) + 3
                    yield "ip", at, end, all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in four)
                    at = end + 1
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                yield "card", *m.span(), luhn(digits)
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                phones.append(m.span())
                yield "phone", *m.span(), True
    for m in _LOOSE_PHONE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in phones):
            yield "phone", *m.span(), False


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote, 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9") if end - start < 80 else ""
    around = text[max(0, start - CONTEXT) : start]
    if kind == "email":
        check, known = (1 if span[0] not in ".-%" else -1), (1 if span.rsplit(".", 1)[1].lower() in TOP_DOMAINS else -1)
    elif kind == "ip":
        check, known = (1 if base else -1), (-1 if span.startswith(("0.", "255.")) else 1 if base else 0)
    elif kind == "card":
        check, known = (1 if base else -1), (1 if digits.startswith(CARD_HEADS) else 0)
    else:
        check, known = (1 if 9 <= len(digits) <= 15 else -1), (1 if span[0] == "+" else 0)
    edge = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return (
        1 if base else -1,
        check,
        known,
        1 if CONTEXT_WORDS[kind].search(around) else 0,
        -1 if AGAINST_WORDS.search(around) else 0,
        1 if edge else -1,
    )


def code_of(kind: str, vote: tuple[int, ...], mixed: bool) -> int:
    """Kind, votes and the one further feature (separators in the span) as one number."""
    code = KINDS.index(kind)
    for v in vote:
        code = code * 3 + v + 1
    return code * 2 + mixed


def parts_of(code: int) -> tuple[int, np.ndarray, int]:
    code, mixed = divmod(code, 2)
    found = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        found.append(v - 1)
    return code, np.array(found[::-1]), mixed


def features(kinds: np.ndarray, ballots: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    columns = [np.ones(len(kinds)), *(kinds == k for k in range(len(KINDS))), mixed]
    columns += [ballots[:, j] == v for j in range(LABELERS) for v in (-1, 1)]
    return np.column_stack(columns).astype(float)


def fit(counts: dict[int, int], rounds: int = 50, steps: int = 300) -> tuple[set[int], np.ndarray]:
    """The accepted codes among all that can occur, and the labelers' reliabilities.

    The classes start from the votes' majority; each labeler has its own chance of
    each vote in each class, with one pseudo-count. Without any span nothing beyond
    the base spans is accepted.
    """
    if not counts:
        return set(), np.full((LABELERS, 2), 0.5)
    codes = sorted(counts)
    kinds, ballots, mixed = (np.array(x) for x in zip(*map(parts_of, codes)))
    weight = np.array([counts[c] for c in codes], float)
    truth = 1 / (1 + np.exp(-ballots.sum(1).astype(float)))
    chance = np.zeros((LABELERS, 3, 2))
    for _ in range(rounds):
        classes = np.column_stack([1 - truth, truth]) * weight[:, None]
        prior = np.array([(classes[kinds == k].sum(0) + 1) / (classes[kinds == k].sum() + 2) for k in range(len(KINDS))])
        score = np.log(prior[kinds])
        for j in range(LABELERS):
            for v in (-1, 0, 1):
                chance[j, v + 1] = (classes[ballots[:, j] == v].sum(0) + 1) / (classes.sum(0) + 3)
            score += np.log(chance[j, ballots[:, j] + 1])
        truth = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    x = features(kinds, ballots, mixed)
    w, share = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(steps):  # Newton's steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - truth)) + 1e-4 * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    every = np.arange(len(KINDS) * 3**LABELERS * 2)
    kinds, ballots, mixed = (np.array(v) for v in zip(*map(parts_of, every.tolist())))
    accepted = set(every[features(kinds, ballots, mixed) @ w > 0].tolist())
    return accepted, np.column_stack([chance[:, 2, 1] + chance[:, 1, 1] / 2, chance[:, 0, 0] + chance[:, 1, 0] / 2])


def coded(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(start, kind's number, end, base, code) of each proposed span, in order."""
    found = []
    for kind, a, b, base in proposals(text):
        mixed = not text[a:b].isalnum()
        found.append((a, KINDS.index(kind), b, base, code_of(kind, votes(text, kind, a, b, base), mixed)))
    return sorted(found)


def count_codes(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """How often each combination of kind, votes and features occurs in all rows."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(x[4] for x in coded(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(released(run), "code long, n long")
    return {r.code: r.n for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # at most 2 * 4 * 3^6 rows


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row out for each row in.

    spans has ``kind:start:end`` in code points, by start, then in the order of KINDS;
    base_sha256 is over the base spans alone. Null and empty texts have no spans; ids
    pass through, of any type; an empty table gives no rows. Two scans, no shuffle of texts.
    """
    ship(docs.sparkSession)
    accepted, _ = fit(count_codes(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, spans = [], [], []
            for text in batch.column(1):
                found = coded(text.as_py())
                strict = [x for x in found if x[3]]
                counts.append([sum(x[1] == k for x in strict) for k in range(4)])
                base.append(hashlib.sha256(",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in strict).encode()).hexdigest())
                spans.append(",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in found if x[3] or x[4] in accepted))
            columns = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    schema = f"id {type_of(docs, id_col)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(released(run), schema).withColumnRenamed("id", id_col)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
