"""Secret scans by a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived that
holds for every text with a match. Each segment of rows gets an inverted index:
the rows that hold each trigram which some rule asks for. The rules' queries intersect and
unite these postings, and only the rows left are searched with the expression
itself. A rule whose query asks for nothing reads every row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import released, ship, table, text_of, type_of

#: A query is True, a trigram, ("and", parts) or ("or", parts).
Query = object
MOST_STRINGS = 64
SEGMENT_BYTES = 1 << 22


def _all(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: list[Query]) -> Query:
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[bytes]) -> Query:
    return _any([_all(sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in sorted(strings)])


def _strings(node) -> set[bytes] | None:
    """The texts (lower case) that a parsed expression can match, if they are few."""
    found = {b""}
    for op, arg in node:
        if op is ops.LITERAL and arg < 128:
            more = {bytes([arg]).lower()}
        elif op is ops.IN:
            more = set()
            for kind, x in arg:
                span = [x] if kind is ops.LITERAL else range(x[0], x[1] + 1) if kind is ops.RANGE else None
                if span is None or len(span) > MOST_STRINGS or max(span) > 127:
                    return None
                more |= {bytes([c]).lower() for c in span}
        elif op is ops.SUBPATTERN:
            more = _strings(arg[3])
        elif op is ops.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[1] != ops.MAXREPEAT and arg[1] <= 4:
            one, more = _strings(arg[2]), None
            if one is not None:
                tails = [{b""}]
                for _ in range(arg[1]):
                    tails.append({a + b for a in tails[-1] for b in one})
                    if len(tails[-1]) > MOST_STRINGS:
                        return None
                more = set().union(*tails[arg[0] :])
        else:
            more = None
        if more is None or len(found) * len(more) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in more}
    return found


def trigram_query(pattern: str) -> Query:
    """What every text with a match holds, after A-Z are made lower case."""

    def of(node) -> Query:
        parts: list[Query] = []
        run = {b""}
        for op, arg in node:
            few = _strings([(op, arg)])
            if few is not None and len(run) * len(few) <= MOST_STRINGS:
                run = {a + b for a in run for b in few}
                continue
            parts.append(_of_strings(run))
            run = {b""} if few is None else few
            if few is not None:
                continue
            if op is ops.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is ops.BRANCH:
                parts.append(_any([of(x) for x in arg[1]]))
            elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0]:
                parts.append(of(arg[2]))
        return _all([*parts, _of_strings(run)])

    return of(_parser.parse(pattern))


def _asked(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_asked, query[1]))


@dataclass
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False
    flags: int = re.ASCII

    def __post_init__(self):
        self.query = trigram_query(self.pattern)
        self.search = re.compile(self.pattern, self.flags).finditer


def rules() -> list[Rule]:
    """The base kinds, in their order, then the kinds that are added to them."""
    return [
        Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: m.end(2) - m.start(2) >= 12, True, re.ASCII | re.IGNORECASE),
        Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18, True),
        Rule("hex", r"[0-9a-f]{16,}", base=True),  # a run of 16 or more is a whole run: none starts inside another
        Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
        Rule("repository_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
        Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
        Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{16,}"),
        Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
        Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
        Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}"),
    ]


class Index:
    """Postings of the trigrams that the rules ask for, over one segment of rows."""

    def __init__(self, found: list[Rule]):
        self.rules = found
        self.asked = sorted(set().union(*(_asked(r.query) for r in found)))
        self.number = np.zeros(1 << 24, np.uint8 if len(self.asked) < 255 else np.uint16)
        for i, t in enumerate(self.asked, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, texts: list[bytes]) -> dict[bytes, set[int]]:
        found: dict[bytes, set[int]] = {t: set() for t in self.asked}
        held, rows, size = [], [], 0

        def flush():
            nonlocal held, rows, size
            raw = np.frombuffer(b"\0\0".join(held), np.uint8).astype(np.uint32)
            if len(raw) >= 3:
                numbers = self.number[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
                at = np.flatnonzero(numbers)
                ends = np.cumsum([len(x) + 2 for x in held])
                pairs = np.unique(numbers[at].astype(np.int64) * len(held) + np.searchsorted(ends, at, "right"))
                for number, k in zip(pairs // len(held) - 1, pairs % len(held)):
                    found[self.asked[number]].add(rows[k])
            held, rows, size = [], [], 0

        for row, text in enumerate(texts):
            for start in range(0, max(1, len(text) - 2), SEGMENT_BYTES):  # pieces of a long text share two bytes
                held.append(text[start : start + SEGMENT_BYTES + 2].lower())
                rows.append(row)
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    flush()
        if held:
            flush()
        return found

    def candidates(self, query: Query, postings: dict[bytes, set[int]], n: int) -> set[int]:
        if query is True:
            return set(range(n))
        if isinstance(query, bytes):
            return postings[query]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        return set.intersection(*parts) if query[0] == "and" else set.union(*parts)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule's number, end) of all matches in each text, in order; code points."""
        postings = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, rule in enumerate(self.rules):
            for row in self.candidates(rule.query, postings, len(texts)):
                out[row] += [(m.start(), number, m.end()) for m in rule.search(texts[row]) if rule.keep(m)]
        return [sorted(x) for x in out]


_INDEX: list[Index] = []


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans; one row out for each row in.

    spans has ``kind:start:end`` of all rules in code points, by start, then in the
    rules' order; base_sha256 is over those of the base rules. Null and empty texts
    have no spans; ids pass through as they are; an empty table gives no rows. There
    is no shuffle; a task holds an index over some megabytes of text at a time.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _INDEX:
            _INDEX.append(Index(rules()))
        index = _INDEX[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = index.spans(part.column(1).to_pylist())
                said = [[(n, f"{index.rules[n].kind}:{a}:{b}") for a, n, b in x] for x in spans]
                base = [",".join(s for n, s in x if index.rules[n].base) for x in said]
                columns = [part.column(0), *(pa.array([sum(n == k for n, _ in x) for x in said], pa.int64()) for k in range(3))]
                columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(s for _, s in x) for x in said])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {type_of(docs, id_col)}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
