"""Secret scans: fixed patterns, and values in a credential context that are hard to guess."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .guesses import Words, dictionary, segments

#: The patterns of the base scan, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
#: Credential contexts: a name, which may end any identifier, a sign and a value up to white space or its closing quote; a user and password in a URL; an authorization header.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api_?key|access_?key|auth)["']?\x20*(?::=|=>|[:=])\x20*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))"""
    r"""|[a-z][a-z0-9+.-]{0,19}://[^\s:@/]{1,64}:([^\s@/]+)@"""
    r"""|authorization\x20*:\x20*(?:bearer|basic)\x20+(\S+)""",
    re.IGNORECASE | re.ASCII,
)
#: A value with so many bits or more is a secret.
BITS = 40.0
#: No name in CONTEXT is longer.
NAME = 16
_NAMED = re.compile(r"pass|pwd|secret|token|credential|key|auth|://", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def guess_spans(text: str, bits: float = BITS, words: Words | None = None) -> list[tuple[str, int, int, float]]:
    """Values in a credential context whose cheapest segmentation takes 2**bits guesses or more."""
    found = []
    if _NAMED.search(text):
        at = 0
        while m := CONTEXT.search(text, at):
            k = m.lastindex
            cost = segments(m[k], words)[0]
            at = m.end()
            if cost >= bits:
                found.append(("guess", m.start(k), m.end(k), cost))
            elif at == m.end(k):  # what seemed an easy value may be the name of the next one
                at = max(m.start(k), at - NAME)
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, max_bits double"


def _scan(batches: Iterator[pa.RecordBatch], bits: float, known: Callable[[], Words]) -> Iterator[pa.RecordBatch]:
    words = known()
    for b in batches:
        out = [[] for _ in range(8)]
        for doc, text in zip(b[0].to_pylist(), b[1]):
            text = text.as_py() or ""
            base, more = base_spans(text), guess_spans(text, bits, words)
            n = {k: sum(s[0] == k for s in base) for k in KINDS[:3]}
            row = (doc, *n.values(), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [s[:3] for s in more]), len(more), max((s[3] for s in more), default=0.0))
            for o, v in zip(out, row):
                o.append(v)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
        yield pa.record_batch([pa.array(o, t) for o, t in zip(out, types)], names=[x.split()[0] for x in _OUT.split(", ")])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: float = BITS, words: Callable[[], Words] = dictionary) -> DataFrame:
    """One row a document: counts of each base kind, the digest of the base spans, all spans, the number of hard-to-guess values and the most bits of one.

    Texts are read whole; a null text is empty and has no spans. Rows are independent: nothing is
    shuffled, rows that repeat an id each give a row, null ids stay null. words gives the dictionary, where texts are read.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: _scan(b, bits, words), _OUT)
