"""Secret scan with a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression. Each batch
of documents (a shard of the table) gets postings for the trigrams that the queries name;
the queries intersect and unite postings, and only the documents left are scanned with the
rule's expression. A rule without mandatory trigrams scans every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import spans_text

#: Boolean queries: True (all documents), a trigram (bytes), or ("and" | "or", parts).
MOST_EXACT = 16


def _and(*parts):
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _or(*parts):
    if any(p is True for p in parts):
        return True
    kept = list(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def _grams(text: str):
    raw = text.encode()
    return _and(*[raw[i : i + 3] for i in range(len(raw) - 2)])


def _need(exact: set[str]):
    return _or(*[_grams(x) for x in sorted(exact)]) if exact else True


def _sequence(items) -> tuple[set[str] | None, object]:
    """(all texts that the items can match, lower-cased, or None; what they require)."""
    exact: set[str] | None = {""}
    need, run = True, {""}
    for item in items:
        own, required = _node(*item)
        need = _and(need, required)
        if own is not None and len(run) * len(own) <= MOST_EXACT:
            run = {a + b for a in run for b in own}
        else:
            need, exact = _and(need, _need(run)), None
            run = own if own is not None else {""}
    return (run, True) if exact is not None else (None, _and(need, _need(run)))


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, True
    if op is C.SUBPATTERN:
        exact, need = _sequence(arg[-1])
        return exact, need
    if op is C.BRANCH:
        ways = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in ways) and sum(len(e) for e, _ in ways) <= MOST_EXACT:
            return set().union(*[e for e, _ in ways]), True
        return None, _or(*[_need(e) if e is not None else n for e, n in ways])
    if op is C.IN:
        chosen = {chr(x).lower() if x < 128 else chr(x) for k, x in arg if k is C.LITERAL}
        if all(k is C.LITERAL for k, _ in arg) and len(chosen) <= 8:
            return chosen, True
        return None, True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        if (low, high) == (0, 1):
            exact, _ = _sequence(body)
            return (exact | {""} if exact is not None and len(exact) < MOST_EXACT else None), True
        if low >= 1:
            exact, need = _sequence(body)
            return (exact if low == high == 1 else None), _and(need, _need(exact) if exact is not None else True)
        return None, True
    if op is C.AT or op is C.ASSERT or op is C.ASSERT_NOT:
        return {""}, True
    return None, True


def trigram_query(pattern: str):
    """What each match of the pattern must contain, in lower-cased text."""
    exact, need = _sequence(parser.parse(pattern))
    return _need(exact) if exact is not None else need


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*[trigrams(x) for x in query[1]])


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = False


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: The kinds, in order. The first three are the base kinds.
RULES = (
    Rule("assign", "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_password", r"://[^\s/:@]+:[^\s/:@]+@"),
)


class TrigramIndex:
    """Postings of a batch of texts for the trigrams that the rules' queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [trigram_query(r.pattern) for r in rules]
        names = sorted(set().union(*[trigrams(q) for q in self.queries]))
        self.ids = {g: i + 1 for i, g in enumerate(names)}
        if len(names) > 65_000:
            raise ValueError("too many trigrams; split the rules")
        self.lookup = np.zeros(1 << 24, np.uint16)
        for g, i in self.ids.items():
            self.lookup[g[0] << 16 | g[1] << 8 | g[2]] = i

    def postings(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Trigram id -> ascending numbers of the texts that contain it."""
        out: dict[int, list[np.ndarray]] = {}
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        for lo in range(0, max(len(raw) - 2, 0), 1 << 20):
            part = raw[lo : lo + (1 << 20) + 2].astype(np.uint32)
            found = self.lookup[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            at = np.flatnonzero(found)
            both = np.unique(found[at].astype(np.int64) << 40 | np.searchsorted(ends, at + lo, side="right"))
            ids, rows = both >> 40, both & (1 << 40) - 1
            for i in np.unique(ids).tolist():
                out.setdefault(i, []).append(rows[ids == i])
        return {i: np.unique(np.concatenate(p)) for i, p in out.items()}

    def candidates(self, query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(self.ids[query], np.zeros(0, np.int64))
        parts = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def scan_rule(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches that are long enough; the others are dropped."""
    return [(m.start(), m.end(), rule.kind) for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256, spans, n_spans for each document.

    Spans are code-point offsets, end exclusive; the other rules only add spans. Null text
    counts as empty; null ``doc_id`` stays null; repeated rows are scanned each; an empty
    table gives no rows; other columns are ignored.
    """
    kinds = tuple(r.kind for r in rules)
    base = tuple(r.kind for r in rules if r.base)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in base) + "base_sha256 string, spans string, n_spans long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        compiled = [re.compile(r.pattern) for r in rules]
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 500):
                texts = [t or "" for t in column.slice(lo, 500).to_pylist()]
                postings = index.postings([t.encode("utf-8", "replace") for t in texts])
                spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
                for rule, pattern, query in zip(rules, compiled, index.queries, strict=True):
                    for i in index.candidates(query, postings, len(texts)).tolist():
                        spans[i] += scan_rule(rule, pattern, texts[i])
                own = [[s for s in x if s[2] in base] for x in spans]
                columns = [ids.slice(lo, 500)]
                columns += [pa.array([sum(s[2] == k for s in x) for x in own], pa.int64()) for k in base]
                columns.append(pa.array([hashlib.sha256(spans_text(x, kinds).encode()).hexdigest() for x in own], pa.string()))
                columns.append(pa.array([spans_text(x, kinds) for x in spans], pa.string()))
                columns.append(pa.array([len(x) for x in spans], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
