"""Secret scans: a trigram inverted index in front of regular expressions.

From every rule's regular expression a Boolean query over trigrams is derived: any
text that the rule matches satisfies it. Texts are indexed in blocks, one posting list
a trigram that some query asks for; intersecting and uniting the lists gives a rule's
candidates, and only these are verified with the expression. A rule whose expression
has no mandatory trigram scans every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textops as X
from tessera.llm.tables import type_of

#: strings that an expression's exact part may stand for before its trigrams are taken
MOST_STRINGS = 32
ALL = ("all",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", 32, base=True),  # runs are taken whole, so shorter ones need no match
)
#: a key from BEGIN through its END line; else through the headers, base64 lines (line breaks may be escaped or
#: spaces), short last line and checksum that follow. No look-around, so that RE2 reads it too
_KEY_NAME = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:[\x20\t\r\n]|\\[nr])*"
_KEY = (rf"-----BEGIN {_KEY_NAME}(?:[^-]*(?:-{{1,4}}[^-]+)*-----END {_KEY_NAME}"
        rf"|(?:[\x20\t\r\n]*[A-Za-z][A-Za-z-]*:\x20[^\n]*\n)*(?:{_BREAK}[A-Za-z0-9+/]{{16,}}={{0,2}})+"
        rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}(?:==|=(?m:\r?$))|\r?\n[A-Za-z0-9+/]{{1,15}}(?m:\r?$))?"
        rf"(?:{_BREAK}=[A-Za-z0-9+/]{{4}}(?m:\r?$))?)?")
#: kinds beyond the base: public formats of keys
MORE_RULES = (
    Rule("private_key", _KEY),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"[a-z]{2,10}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


# --- Boolean trigram queries: ("all",), ("tri", code), ("and", q...), ("or", q...)

def trigram(s: str) -> int:
    a, b, c = s.encode("latin-1")
    return a << 16 | b << 8 | c


def both(*qs):
    qs = [q for q in dict.fromkeys(qs) if q != ALL]
    return ALL if not qs else qs[0] if len(qs) == 1 else ("and", *qs)


def either(*qs):
    qs = list(dict.fromkeys(qs))
    return ALL if ALL in qs else qs[0] if len(qs) == 1 else ("or", *qs)


def of_strings(strings) -> tuple:
    """The query for texts that hold one of the strings."""
    return either(*[both(*[("tri", trigram(s[i:i + 3])) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _joined(left, right):
    return {a + b for a in left for b in right}


def _node(op, arg):
    """(exact strings or None, query) of one parsed element; letters are lower-cased,
    as the index is."""
    if op is C.LITERAL:
        return ({chr(arg).lower()} if arg < 128 else None), ALL
    if op is C.IN:
        chars = set()
        for kind, x in arg:
            if kind is C.LITERAL and x < 128:
                chars.add(chr(x).lower())
            elif kind is C.RANGE and x[1] < 128 and x[1] - x[0] < 4:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, ALL
        return (chars if len(chars) <= MOST_STRINGS else None), ALL
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        if all(e is not None for e, _ in parts):
            exact = set().union(*[e for e, _ in parts])
            if len(exact) <= MOST_STRINGS:
                return exact, ALL
        return None, either(*[both(q, of_strings(e) if e is not None else ALL) for e, q in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, body = arg
        exact, q = _sequence(body)
        if low == high == 1:
            return exact, q
        if low == 0:
            return ((exact | {""}) if high == 1 and exact is not None and q == ALL else None), ALL
        return None, both(q, of_strings(exact) if exact is not None else ALL)
    if op is C.AT:
        return {""}, ALL
    return None, ALL


def _sequence(items):
    """Concatenation: exact strings grow while they can; where they end, their trigrams are mandatory."""
    done, run, cut = ALL, {""}, False
    for op, arg in items:
        exact, q = _node(op, arg)
        done = both(done, q)
        if exact is not None and len(grown := _joined(run, exact)) <= MOST_STRINGS:
            run = grown
        else:
            done, run, cut = both(done, of_strings(run)), (exact if exact is not None else {""}), True
    return (None, both(done, of_strings(run))) if cut or done != ALL else (run, ALL)


@cache
def trigram_query(rule: Rule):
    exact, q = _sequence(_parser.parse(rule.pattern))
    return both(q, of_strings(exact) if exact is not None else ALL)


def trigrams_of(q) -> set[int]:
    return {q[1]} if q[0] == "tri" else set().union(*map(trigrams_of, q[1:])) if q[0] in ("and", "or") else set()


class Index:
    """Posting lists of the wanted trigrams over one block of texts (lower-cased)."""

    def __init__(self, wanted: list[int]):
        self.slot = {t: i + 1 for i, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.int16)
        for t, i in self.slot.items():
            self.table[t] = i

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Rows of each trigram, ascending."""
        if len(data) < 3:
            return {}
        low = X.LOWER[data].astype(np.int32)
        ids = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(ids)
        row = np.searchsorted(offsets[1:], at, side="right")
        keep = at + 3 <= offsets[row + 1]
        at, row = at[keep], row[keep]
        pair = np.unique((ids[at].astype(np.int64) << 32) | row)
        slot, first = np.unique(pair >> 32, return_index=True)
        return dict(zip(slot.tolist(), np.split(pair & 0xFFFFFFFF, first[1:])))

    def rows(self, q, lists: dict[int, np.ndarray], n: int) -> np.ndarray:
        if q == ALL:
            return np.arange(n)
        if q[0] == "tri":
            return lists.get(self.slot[q[1]], np.zeros(0, np.int64))
        parts = [self.rows(x, lists, n) for x in q[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out


def found_in(text: str, rules, compiled) -> list[tuple[int, int, int]]:
    """(start, rule's place, end) of all spans in a text, ordered."""
    return sorted((a, k, b) for k, (r, c) in enumerate(zip(rules, compiled)) for a, b in r.spans(c, text))


def joined(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan_batch(column: pa.Array, rules, compiled, queries, index: Index) -> list[list[tuple[int, int, int]]]:
    """Spans of every text of a column, through the index."""
    texts = column.to_pylist()
    out: list[list] = [[] for _ in texts]
    data, offsets = X.buffers(column)
    for a, b in X.slices(offsets):
        lists = index.postings(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        for k, (rule, c, q) in enumerate(zip(rules, compiled, queries)):
            for i in index.rows(q, lists, b - a):
                if text := texts[a + i]:
                    out[a + i] += [(s, k, e) for s, e in rule.spans(c, text)]
    for spans in out:
        spans.sort()
    return out


def _prepared(rules):
    queries = [trigram_query(r) for r in rules]
    index = Index(sorted(set().union(*map(trigrams_of, queries))))
    return [r.compiled() for r in rules], queries, index


def _scan_fn(rules):
    base = [k for k, r in enumerate(rules) if r.base]

    def run(batches):
        prepared = _prepared(rules)
        for batch in X.pieces(batches):
            found = scan_batch(batch.column("text"), rules, *prepared)
            counts = [pa.array([sum(s[1] == k for s in spans) for spans in found], pa.int64()) for k in base]
            base_text = [joined([s for s in spans if s[1] in base], rules) for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts,
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t in base_text], pa.string()),
                 pa.array([joined(spans, rules) for spans in found], pa.string())],
                ["doc_id", *[f"n_{rules[k].kind}" for k in base], "base_sha256", "spans"])
    return run


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Secrets in every text of ``docs(doc_id, text, ...)``: doc_id, a count for each base
    kind, the SHA-256 of the base spans and all spans, as ``kind:start:end`` by start
    and then by kind as listed, in code points, end exclusive.

    A null or empty text has none (empty strings). One result row per input row,
    repeated rows and null ids included; other columns are ignored."""
    counts = "".join(f"n_{r.kind} BIGINT, " for r in rules if r.base)
    schema = f"doc_id {type_of(docs, 'doc_id')}, {counts}base_sha256 STRING, spans STRING"
    return docs.select("doc_id", "text").mapInArrow(_scan_fn(rules), schema)


def _mask_fn(rules, names):
    def run(batches):
        prepared = _prepared(rules)
        for batch in X.pieces(batches):
            found = scan_batch(batch.column("text"), rules, *prepared)
            texts = [masked(t, spans, rules) if spans else t for t, spans in zip(batch.column("text").to_pylist(), found)]
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in cols:
                old = batch.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(t) if s else o for t, s, o in zip(texts, found, old)],
                                           batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return run


def masked(text: str, spans, rules) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans
    one mark stays, the first's, over all they cover."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{rules[k].kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` with secrets in ``text`` masked (and ``n_chars``, if there, renewed
    where something was). Rows without a secret, null and empty texts stay as they are."""
    return docs.mapInArrow(_mask_fn(rules, docs.columns), docs.schema)
