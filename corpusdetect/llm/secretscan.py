"""Secrets found by one automaton for all rules in one pass over the bytes.

The pass tells for each text which rules can match in it. Spans of those are then read off with the
rules' own automata, leftmost and longest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton


@dataclass(frozen=True)
class Rule:
    """``matches`` is searched leftmost; ``trigger`` is part of every match that is kept.

    Triggers go into one automaton, in which counts of several rules would multiply; so few count.

    A match is kept from ``least`` characters on, counted after the sign that ``value_after`` names,
    blanks and one quote.
    """

    kind: str
    matches: str
    trigger: str
    least: int = 1
    value_after: str = ""
    # Whether places where matches begin are found by reading the text backwards first. It is for rules of which
    # long parts may repeat without a match, which would be read again from each beginning.
    backwards: bool = False


_KEY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", _KEY + "[A-Za-z0-9+/_.=-]", 8, ":="),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]", 16),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{32}", 32),
)
_NAME = r"\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"
# From the header to the END line, between which are no five dashes; where it is missing, over what
# follows in lines of base64 (also quoted, or with their ends written as escapes), the last of any length.
_ENDED = r"([\x00-\x2c\x2e-\xfe]|-{1,4}[\x00-\x2c\x2e-\xfe])*-----END" + _NAME
_APART = r"""([\x09\x0a\x0d\x20"',>|]|\\[nr])+"""
_OPEN = f"({_APART}[A-Za-z-]+:\\x20[\\x20-\\x7e]+)*({_APART}[A-Za-z0-9+/]{{16,}}={{0,2}})+({_APART}[A-Za-z0-9+/]+={{0,2}})?"
_PEM = f"-----BEGIN{_NAME}({_ENDED}|{_OPEN})?"
_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
MORE = (
    Rule("private_key", _PEM, r"-----BEGIN\x20"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", _JWT, "eyJ[A-Za-z0-9_-]", backwards=True),
)
RULES = BASE + MORE
MASK = "[secret]"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([r.trigger for r in rules], anywhere=True)
        self.own = [Automaton([r.matches], anywhere=False).prepare(r.matches if r.backwards else None) for r in rules]

    def _kept(self, rule: Rule, match: bytes) -> bool:
        if rule.value_after:
            at = min(i for i in (match.find(c.encode()) for c in rule.value_after) if i >= 0)
            match = match[at + 1 :].lstrip(b" ")
            match = match[1:] if match[:1] in (b'"', b"'") else match
        return len(match) >= rule.least

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) in code points of every text, in that order."""
        joined = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
        seen = np.bitwise_or.reduceat(self.all.accepts[self.all.states(joined)], begins)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i in np.flatnonzero(seen).tolist():
            text = texts[i]
            places = [
                (start, k, end)
                for k, rule in enumerate(self.rules)
                if seen[i] >> k & 1
                for start, end in self.own[k].leftmost(text)
                if self._kept(rule, text[start:end])
            ]
            before = np.concatenate([[0], np.cumsum(np.frombuffer(text, dtype=np.uint8) & 0xC0 != 0x80)])
            found[i] = sorted((int(before[a]), k, int(before[b])) for a, k, b in places)
        return found


@lru_cache(maxsize=4)
def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _listed(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_<kind> for the base kinds, base_sha256, spans.

    Spans are kind:start:end in code points, the end exclusive, by start and then by the order of
    the rules. Null and empty texts have none; null ids and repeated rows are kept; an empty table
    gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    counts = [f"n_{r.kind}" for r in BASE]
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scanner(rules).spans([(t or "").encode() for t in batch.column(1).to_pylist()])
            kinds = [[rules[k].kind for _, k, _ in spans] for spans in found]
            base = [_listed([s for s in spans if rules[s[1]] in BASE], rules) for spans in found]
            yield pa.record_batch(
                [
                    batch.column(0),
                    *(pa.array([x.count(r.kind) for x in kinds], pa.int64()) for r in BASE),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                    pa.array([_listed(spans, rules) for spans in found], pa.string()),
                ],
                names=["doc_id", *counts, "base_sha256", "spans"],
            )

    return docs.select(id_col, text_col).mapInArrow(find, schema)


def masked(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """The same rows and columns with every secret (and what overlaps it) replaced; nulls stay."""
    at, schema = docs.columns.index(text_col), docs.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = _scanner(rules).spans([(t or "").encode() for t in texts])
            for i, spans in enumerate(found):
                if spans:
                    out, done = [], 0
                    for start, _, end in spans:
                        if start >= done:
                            out += [texts[i][done:start], mask]
                        done = max(done, end)
                    texts[i] = "".join([*out, texts[i][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(replace, schema)
