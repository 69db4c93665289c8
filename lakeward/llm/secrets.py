"""Secret scans over a trigram inverted index.

From each rule's regex a Boolean trigram query is derived: what every match must
contain. Per batch of documents one pass over all positions builds the postings
(the documents of each trigram that some rule asks for); they are intersected and
united as the query says, and only the candidates are verified by the regex on
the whole text. Rules from which no
trigram follows scan every document. The index holds lower-case ASCII, so it
serves rules in any case and never loses a match.

Null texts count as empty and have no spans. Spans are code points, end
exclusive, leftmost non-overlapping per kind. Rows that repeat get a row each.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import col, row_key, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1  # characters that the group must have


# The base kinds, in the order in which spans are listed, then the further ones.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
FURTHER = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    # a match starts where its run starts: one try per run, not one per place in it
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s/:@]+:[^\s/@]+@"),
)
RULES = BASE + FURTHER

#: A query is a set of alternatives' trigram sets per conjunct: every conjunct needs one alternative wholly present.
Query = tuple[frozenset[frozenset[str]], ...]


def _grams(text: str) -> frozenset[str]:
    low = "".join(c.lower() if c.isascii() else "\0" for c in text)
    return frozenset(g for g in (low[i : i + 3] for i in range(len(low) - 2)) if "\0" not in g)


def _strings(node) -> list[str] | None:
    """All strings a small sub-pattern can match, or None if they are many or unknown."""
    out = [""]
    for op, arg in node:
        if op is C.LITERAL:
            more = [chr(arg)]
        elif op is C.SUBPATTERN:
            more = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            more = None if None in parts else [s for p in parts for s in p]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            more = [chr(a) for _, a in arg]
        elif op is C.MAX_REPEAT and arg[1] <= 1:
            inner = _strings(arg[2])
            more = None if inner is None else inner + [""] * (arg[0] == 0)
        else:
            more = None
        if more is None or len(out) * len(more) > 64:
            return None
        out = [a + b for a in out for b in more]
    return out


def trigram_query(pattern: str) -> Query:
    """What any match must contain: the string sets of the maximal known runs of the top-level sequence."""
    conjuncts, run = [], []

    def close():
        known = _strings(run) if run else None
        if known and all(_grams(s) for s in known):
            sets = {_grams(s) for s in known}
            conjuncts.append(frozenset(s for s in sets if not any(t < s for t in sets)))
        run.clear()

    for item in _parser.parse(pattern):
        if _strings([item]) is None:
            close()
        elif _strings([*run, item]) is None:
            close()
            run.append(item)
        else:
            run.append(item)
    close()
    return tuple(conjuncts)


def _code(gram: str) -> int:
    a, b, c = gram.encode()
    return a << 16 | b << 8 | c


class Postings:
    """An inverted index over one batch: for each asked trigram the sorted numbers of the documents that hold it."""

    #: Bytes of text indexed at a time.
    SLICE = 4 << 20

    def __init__(self, texts: pa.Array, grams: frozenset[str]):
        self.size = len(texts)
        codes = np.array(sorted(_code(g) for g in grams), np.int32)
        asked = np.zeros(1 << 24, bool)
        asked[codes] = True
        self.rows: dict[int, np.ndarray] = {}
        pairs = []
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        at = 0
        while at < self.size and len(codes):
            done = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + self.SLICE, side="right")))
            pairs.append(self._pairs(pc.ascii_lower(texts.slice(at, upto - at)), asked, at))
            at = upto
        if pairs:
            both = np.unique(np.concatenate(pairs))  # trigram, then document
            gram, row = (both >> 32).astype(np.int32), (both & 0xFFFFFFFF).astype(np.int64)
            cut = np.searchsorted(gram, codes), np.searchsorted(gram, codes, side="right")
            self.rows = {int(c): row[i:j] for c, i, j in zip(codes, *cut, strict=True)}

    @staticmethod
    def _pairs(low: pa.Array, asked: np.ndarray, first: int) -> np.ndarray:
        """(trigram << 32 | document) of every place where an asked trigram stands within a document."""
        length = np.asarray(pc.fill_null(pc.binary_length(low), 0), np.int64)
        data = np.frombuffer(b"".join(x.as_buffer() for x in low if x.is_valid), np.uint8).astype(np.int32)
        if len(data) < 3:
            return np.zeros(0, np.int64)
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        place = np.flatnonzero(asked[code])
        ends = np.cumsum(length)
        row = np.searchsorted(ends, place, side="right")
        whole = place + 3 <= ends[row]
        return np.unique(code[place[whole]].astype(np.int64) << 32 | (row[whole] + first))

    def of(self, gram: str) -> np.ndarray:
        return self.rows.get(_code(gram), np.zeros(0, np.int64))

    def candidates(self, query: Query) -> np.ndarray:
        """The documents that a rule's query leaves; all of them if it asks for nothing."""
        hit = None
        for any_of in query:
            some = []
            for grams in any_of:
                lists = sorted((self.of(g) for g in grams), key=len)
                every = lists[0]
                for more in lists[1:]:
                    every = np.intersect1d(every, more, assume_unique=True)
                some.append(every)
            union = np.unique(np.concatenate(some))
            hit = union if hit is None else np.intersect1d(hit, union, assume_unique=True)
        return np.arange(self.size) if hit is None else hit


def matches(rule: Rule, compiled: re.Pattern, text: str):
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


_SPANS = "_id bigint, _key bigint, spans array<struct<kind:string,start:int,end:int>>"


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        ready = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        grams = frozenset(g for _, _, query in ready for any_of in query for each in any_of for g in each)
        for batch in batches:
            texts = batch.column("text")
            index = Postings(texts, grams)
            found: list[list[tuple[int, int, str, int]]] = [[] for _ in range(len(texts))]
            for rank, (rule, compiled, query) in enumerate(ready):
                for i in index.candidates(query).tolist():
                    found[i] += [(s, rank, rule.kind, e) for s, e in matches(rule, compiled, texts[i].as_py())]
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(f)] for f in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_key"), pa.array(spans, kind)], ["_id", "_key", "spans"]
            )

    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``_id, _key, spans`` (kind, start, end) by start, then rule order."""
    rows = docs.select(col("doc_id").alias("_id"), row_key(docs).alias("_key"), text_of().alias("text"))
    return rows.mapInArrow(_scan(rules), _SPANS)


def spans_text(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` joined by commas, as a column; of ``kinds`` only, if given."""
    own = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
