"""Secret scans through a trigram inverted index.

Each rule's regex is parsed and turned into a Boolean query over trigrams that every match must
hold. A block of documents gets an inverted index (trigram -> ascending document numbers) over its
lower-cased UTF-8 bytes; the query's postings are intersected and united, and only the candidates
are verified with the regex. A rule whose regex has no mandatory trigram (a bare character run,
say) has the query TRUE and is verified on every document of the block.

An index lives as long as its block (shared.BLOCK_BYTES of text, or one longer document), so
memory is bounded, nothing is shuffled, and a lost executor only repeats its blocks.

Edge cases: a null text counts as empty and has no spans; very long texts are a block of their own and
take linear time, hostile ones too (runs that look like the start of a rule); repeated rows are scanned each on its
own; an empty table gives an empty result; other columns are ignored by scan_secrets() and kept by
redact_secrets().
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_pass, blocks, texts_of

# ---- Boolean trigram queries -------------------------------------------------------------------

TRUE = ("true",)
#: A set of literal strings that grows beyond this is given up for the trigrams found so far.
MOST_STRINGS = 48
#: Character classes up to this size are spelt out.
MOST_CLASS = 8


def _all(queries: list) -> tuple:
    parts = [q for q in dict.fromkeys(queries) if q != TRUE]
    return TRUE if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(queries: list) -> tuple:
    parts = list(dict.fromkeys(queries))
    return TRUE if TRUE in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_string(text: str) -> tuple:
    raw = text.encode()
    return _all([("gram", raw[i : i + 3]) for i in range(len(raw) - 2)])


def _of_strings(strings: set[str]) -> tuple:
    return _any([_of_string(x) for x in sorted(strings)])


def _class(items: list) -> set[str] | None:
    """The lower-cased characters of a small class, else None."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _strings(op, value) -> set[str] | None:
    """All lower-cased strings that one regex element can match, or None if they are too many."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        return _class(value)
    if op is sre.SUBPATTERN:
        return _strings_of(value[3])
    if op is sre.BRANCH:
        sets = [_strings_of(x) for x in value[1]]
        return None if None in sets else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] <= 2:
        inner = _strings_of(value[2])
        if inner is None:
            return None
        out, power = set(), {""}
        for n in range(value[1] + 1):
            out |= power if n >= value[0] else set()
            power = {a + b for a in power for b in inner}
        return out
    return {""} if op is sre.AT else None


def _strings_of(sequence) -> set[str] | None:
    out = {""}
    for op, value in sequence:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(sequence) -> tuple:
    found, run = [], {""}
    for op, value in sequence:
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        found.append(_of_strings(run))
        run = more if more is not None else {""}
        if more is None:
            if op is sre.SUBPATTERN:
                found.append(_query(value[3]))
            elif op is sre.BRANCH:
                found.append(_any([_query(x) for x in value[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                found.append(_query(value[2]))
    return _all([*found, _of_strings(run)])


def trigram_query(pattern: str) -> tuple:
    """The Boolean query over lower-cased trigrams that each text with a match of pattern fulfils."""
    return _query(sre_parse.parse(pattern, re.ASCII))


def grams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set().union(*(grams_of(q) for q in query[1:])) if query != TRUE else set()


# ---- rules -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and non-overlapping; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: A rule that begins with a long run of characters begins at the run's start: each run is read once,
#: so that a text takes time in proportion to its length whatever stands in it.
#: The first three are the base rules; spans that start together are listed in this order.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer\x20+[A-Za-z0-9._~+/=-]{16,})"),
    Rule("login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)


def matches(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Verification: (start, end) in code points of rule's matches in text."""
    return [m.span() for m in compiled.finditer(text) if len(m.group(rule.group)) >= rule.least]


# ---- the index ---------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of some trigrams over a block of documents: trigram -> ascending document numbers."""

    def __init__(self, documents: list[bytes], grams: list[bytes], number: np.ndarray | None = None):
        number = gram_numbers(grams) if number is None else number
        ends = np.cumsum([len(x) for x in documents])
        codes = _LOWER[np.frombuffer(b"".join(documents), dtype=np.uint8)]
        self.size, self.grams = len(documents), {g: i for i, g in enumerate(grams)}
        if len(codes) < 3:
            self.postings = [np.zeros(0, dtype=np.int64)] * len(grams)
            return
        found = number[(codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]]
        at = np.flatnonzero(found)
        owner = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[owner]  # not over a document's end
        pairs = np.unique(found[at[inside]].astype(np.int64) * (self.size + 1) + owner[inside])
        gram, owner = np.divmod(pairs, self.size + 1)
        cuts = np.searchsorted(gram, np.arange(1, len(grams) + 2))
        self.postings = [owner[cuts[i] : cuts[i + 1]] for i in range(len(grams))]

    def candidates(self, query: tuple) -> np.ndarray:
        """Ascending numbers of the documents that fulfil query."""
        if query == TRUE:
            return np.arange(self.size)
        if query[0] == "gram":
            return self.postings[self.grams[query[1]]]
        parts = [self.candidates(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for x in parts[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out


def gram_numbers(grams: list[bytes]) -> np.ndarray:
    """For each possible trigram its number from 1, or 0 if it is not indexed."""
    number = np.zeros(1 << 24, dtype=np.uint16)
    for i, g in enumerate(grams):
        number[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
    return number


class Scanner:
    """Rules with their queries, made once for each task."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.grams = sorted(set().union(*(grams_of(q) for _, _, q in self.rules)))
        self.number = gram_numbers(self.grams)

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Of each text: (kind, start, end) by start, then in the order of the rules."""
        out: list[list] = [[] for _ in texts]
        raw = [x.encode("utf-8", "replace") for x in texts]
        for a, b in blocks([len(x) for x in raw]):
            index = TrigramIndex(raw[a:b], self.grams, self.number)
            for rank, (rule, compiled, query) in enumerate(self.rules):
                for i in index.candidates(query).tolist():
                    out[a + i] += [(s, rank, e) for s, e in matches(rule, compiled, texts[a + i])]
        return [[(self.rules[rank][0].kind, s, e) for s, rank, e in sorted(x)] for x in out]


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of each row: its secrets as code-point spans, end exclusive, in the order of Scanner.spans()."""
    held: list[Scanner] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held or held.append(Scanner(rules))
        spans = held[0].spans(texts_of(batch.column(1)))
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]
        yield pa.record_batch([batch.column(0), pa.array(rows, _SPAN_TYPE)], names=["doc_id", "spans"])

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, f"doc_id long, spans {SPANS}")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each maximal run of overlapping spans put as mark."""
    out, at, end = [], 0, -1
    for _, s, e in spans:
        if s >= end:
            out += [text[at:s], mark] if s >= at else []
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, all columns, with the secrets in text put as a mark and n_chars, if there, made to fit. A null text stays null."""
    names, held = docs.columns, []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held or held.append(Scanner(rules))
        at = names.index("text")
        column, texts = batch.column(at), texts_of(batch.column(at))
        found = held[0].spans(texts)
        new = [None if not ok else redacted(t, s) for t, s, ok in zip(texts, found, column.is_valid().to_pylist(), strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(new, pa.string())
        if "n_chars" in names:
            old = batch.column(names.index("n_chars")).to_pylist()
            columns[names.index("n_chars")] = pa.array([len(n) if s else o for n, s, o in zip(new, found, old, strict=True)], batch.column(names.index("n_chars")).type)
        yield pa.record_batch(columns, names=names)

    return arrow_pass(docs, work, docs.schema)
