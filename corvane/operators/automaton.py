"""Symbols in texts by an automaton: every text is read once, whatever the number of symbols, in time linear in its length and its hits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import cut

#: Characters of the symbols that one automaton holds; more symbols are dealt over several, each with a pass of its own.
ROOM = 1 << 21
#: The automaton that a worker has, by the name of its pass.
_HELD: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, shared: Broadcast) -> ahocorasick.Automaton:
    if name not in _HELD:
        _HELD.clear()
        a = ahocorasick.Automaton()
        for s in shared.value:
            a.add_word(s, s)
        a.make_automaton()
        _HELD[name] = a
    return _HELD[name]


def _hits(batches: Iterator[pa.RecordBatch], name: str, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    search = _automaton(name, shared).iter
    for b in batches:
        found = [sorted({s for _, s in search(t.as_py())}) for t in b.column(1)]
        yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.string()))], names=["id", "symbols"])


def symbols_in(texts: DataFrame, symbols: DataFrame, id_col: str, text_col: str, room: int = ROOM) -> DataFrame:
    """(id, symbols): for every row of texts with a text the distinct symbols (symbol) anywhere in it, in ascending order.

    Empty and null symbols are left out; repeated ones count once. The symbols of a pass, about `room` characters, go through the
    driver to the tasks; their number of passes grows with the symbols' size, and nothing else does. A row without hits has an empty array.
    """
    s = cut(symbols.where("symbol <> ''").select("symbol").distinct(), "symbols")
    size = s.agg(F.sum(F.length("symbol"))).first()[0] or 0
    passes = max(1, -(-size // room))
    kind = texts.schema[id_col].dataType.simpleString()
    t = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for i in range(passes):
        part = s if passes == 1 else s.where(F.pmod(F.xxhash64("symbol"), F.lit(passes)) == i)
        shared = texts.sparkSession.sparkContext.broadcast([r.symbol for r in part.collect()])
        if shared.value:
            some = t.mapInArrow(lambda b, name=uuid.uuid4().hex, x=shared: _hits(b, name, x), f"id {kind}, symbols array<string>")
            out = some if out is None else out.unionByName(some)
    return t.select("id", F.array().cast("array<string>").alias("symbols")) if out is None else out
