"""Secret scans with a trigram index: Boolean queries from the rules' regular expressions choose the texts to verify.

Each slice of texts is a segment with an inverted index of its own: the distinct (trigram, text) pairs of
its bytes, A-Z lower-cased. A rule's query is derived from its pattern, its postings are intersected and
united, and the pattern runs only over the texts that remain. A rule whose pattern has no mandatory
trigram runs over every text. Segments are built and used in one pass, so nothing is shuffled and a lost
task is simply run again.

Nulls are empty texts and give a row without spans; repeated rows are scanned like any others; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from re import _constants as op, _parser as parser

from .words import LOWER, slices, texts

MANY = 24  # strings that a mandatory part of a pattern may stand for


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
BASE = [
    Rule("assign", rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 characters or more
]
RULES = [
    *BASE,
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]

# --- queries --------------------------------------------------------------------------------------
# A query is True (every text), ("tri", code), ("and", parts) or ("or", parts).


def _join(kind: str, parts: list):
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif True in parts:
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[bytes]):
    """Texts that hold one of some strings."""
    def one(s: bytes):
        return _join("and", [("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)])
    return _join("or", [one(s) for s in sorted(strings)])


def _fold(code: int) -> bytes:
    return bytes(LOWER[list(chr(code).encode())])


def _class(items) -> set[bytes] | None:
    out: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(_fold(value))
        elif kind is op.RANGE and value[1] - value[0] < MANY:
            out |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MANY else None


def _read(parsed) -> tuple[set[bytes] | None, object]:
    """(all strings a part of a pattern stands for, or None if they are many; its query)."""
    exact: set[bytes] | None = {b""}
    run, queries = {b""}, []
    for kind, value in parsed:
        query = True
        if kind is op.LITERAL:
            here = {_fold(value)}
        elif kind is op.IN:
            here = _class(value)
        elif kind is op.SUBPATTERN:
            here, query = _read(value[-1])
        elif kind is op.BRANCH:
            read = [_read(x) for x in value[1]]
            known = all(e is not None for e, _ in read)
            here = set().union(*(e for e, _ in read)) if known else None
            query = _join("or", [q for _, q in read])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, part = value
            inner, query = _read(part)
            here = {b"".join(x) for n in range(low, high + 1) for x in product(inner, repeat=n)} if (
                inner is not None and high != op.MAXREPEAT and len(inner) ** high * (high + 1) <= MANY) else None
            query = query if low else True
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            here = {b""}
        else:
            here = None
        joined = None if here is None else {a + b for a in run for b in here}
        if joined is None or len(joined) > MANY:
            queries += [_of_strings(run), query]
            run, exact = {b""} if here is None else here, None
        else:
            run = joined
    queries.append(_of_strings(run))
    return (run if exact is not None else None), _join("and", queries)


def trigram_query(pattern: str):
    """What a text must hold to match, as a Boolean query over trigrams of lower-cased bytes."""
    parsed = parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return True  # other alphabets fold into ASCII there
    return _read(parsed)[1]


# --- index ----------------------------------------------------------------------------------------

class Segment:
    """Postings of the trigrams of a slice: for each trigram the texts that hold it."""

    def __init__(self, s):
        data = LOWER[s.data].astype(np.uint32)
        self.rows = s.rows
        if len(data) < 3:
            self.pairs = np.zeros(0, np.uint64)
            return
        codes = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]).astype(np.uint64)
        owner = np.repeat(np.arange(s.rows, dtype=np.uint64), np.diff(s.offsets))
        whole = owner[:-2] == owner[2:]
        pairs = np.sort((codes << np.uint64(32) | owner[:-2])[whole])
        self.pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs

    def postings(self, code: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.pairs, np.array([code << 32, (code + 1) << 32], np.uint64))
        return (self.pairs[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def search(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        kind, value = query
        if kind == "tri":
            return self.postings(value)
        found = self.search(value[0])
        for part in value[1:]:
            if kind == "and" and not len(found):
                break
            found = (np.intersect1d if kind == "and" else np.union1d)(found, self.search(part))
        return found


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) for every row: spans (kind, start, stop) in code points, by start, then rule."""
    queries = [trigram_query(r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
        compiled = [re.compile(r.pattern) for r in rules]
        for b in batches:
            for s in slices(b.column(1)):
                segment, found, texts = Segment(s), [[] for _ in range(s.rows)], {}
                for n, (rule, query, regex) in enumerate(zip(rules, queries, compiled)):
                    for i in segment.search(query).tolist():
                        text = texts[i] if i in texts else texts.setdefault(i, s.text(i))
                        for m in regex.finditer(text):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), n, m.end()))
                spans = [[{"kind": rules[n].kind, "start": a, "stop": z} for a, n, z in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.first, s.rows).cast(pa.int64()), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, stop: long>>")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and spans of the base kinds, and all spans."""
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
