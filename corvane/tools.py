"""A registry of named tools over tables: arguments are checked and coerced, results are DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import search as S
from .operators.code import findings, lines_of
from .operators.graph import reach
from .operators.lifecycle import sweep

#: Longest text and array of an argument.
LONGEST, MOST = 100_000, 500


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    arguments: dict[str, str]
    required: tuple[str, ...]
    run: Callable[..., DataFrame]


TOOLS: dict[str, Tool] = {}


def tool(name: str, about: str, required: tuple[str, ...] = (), **arguments: str):
    """Registers a function of tables (a dict of DataFrames) and keyword arguments of the types string, integer, number, boolean or array."""

    def add(f):
        TOOLS[name] = Tool(name, about, arguments, required, f)
        return f

    return add


def checked(t: Tool, arguments: dict) -> dict:
    """The arguments with the types that the tool takes; raises ValueError where they can't be."""
    if missing := [a for a in t.required if a not in arguments]:
        raise ValueError(f"Missing required fields: {', '.join(missing)}")
    out = {}
    for k, v in arguments.items():
        kind = t.arguments.get(k)
        if kind is None:
            raise ValueError(f"Field '{k}' is not known")
        try:
            v = "" if kind == "string" and v is None else {"string": str, "integer": int, "number": float, "boolean": bool}.get(kind, lambda x: x)(v)
        except (TypeError, ValueError):
            raise ValueError(f"Field '{k}' must be of type {kind}") from None
        if kind == "array" and not isinstance(v, list):
            raise ValueError(f"Field '{k}' must be an array")
        if isinstance(v, str) and len(v) > LONGEST or isinstance(v, list) and len(v) > MOST:
            raise ValueError(f"Field '{k}' exceeds its maximum length")
        if kind == "string" and k in ("file", "query") and ".." in v.split("/"):
            raise ValueError(f"Field '{k}' leaves its root")
        out[k] = v
    return out


def call(name: str, tables: dict[str, DataFrame], **arguments) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"Unknown tool: {name}")
    return TOOLS[name].run(tables, **checked(TOOLS[name], arguments))


@tool("search", "Memories (id, content) by the stems and synonyms of a question.", ("query",), query="string", limit="integer")
def _search(tables: dict[str, DataFrame], query: str, limit: int = 7) -> DataFrame:
    m = tables["memories"]
    terms = S.vector(query)
    c = S.counts(m, "id", "content", list(terms))
    return S.sparse_scores(c, S.query_weights(m.sparkSession, terms), S.document_frequency(c), m.count()).orderBy(F.round("score", 9).desc(), "id").limit(limit)


@tool("find", "Symbols (id, name) whose name contains a text.", ("query",), query="string", limit="integer")
def _find(tables: dict[str, DataFrame], query: str, limit: int = 20) -> DataFrame:
    return tables["symbols"].where(F.col("name").contains(query)).orderBy("name", "id").limit(limit)


@tool("impact", "What a symbol's calls (src, dst) reach, up or down.", ("node",), node="string", depth="integer", upstream="boolean")
def _impact(tables: dict[str, DataFrame], node: str, depth: int = 2, upstream: bool = True) -> DataFrame:
    e = tables["calls"].select(F.col("dst" if upstream else "src").cast("string").alias("src"), F.col("src" if upstream else "dst").cast("string").alias("dst"))
    return reach(e, e.sparkSession.createDataFrame([(node,)], "start string"), depth)


@tool("check_security", "Findings in files (path, text), all or those of one.", (), file="string")
def _security(tables: dict[str, DataFrame], file: str = "") -> DataFrame:
    f = tables["files"]
    return findings(lines_of(f.where(F.col("path") == file) if file else f, "path", "text"))


@tool("sweep", "What a sweep of memories changes.", ("now",), now="number", most="integer")
def _sweep(tables: dict[str, DataFrame], now: float, most: int = 200) -> DataFrame:
    return sweep(tables["memories"], now, most)
