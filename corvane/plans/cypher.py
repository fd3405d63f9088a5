"""Graph pattern queries as DataFrame plans: a subset of Cypher that reads.

    MATCH (f:File)-[:DEFINES]->(c:Class {name: $n}), (c)<-[d:USES]-(x) WHERE x.path CONTAINS 'a' AND NOT c.name IN ['b']
    WITH c, count(*) AS n ORDER BY n DESC LIMIT 100 WHERE n > 1
    MATCH (c)-[:MEMBER_OF]->(m:Community)
    RETURN DISTINCT c.id AS id, n, m.name AS community ORDER BY n DESC SKIP 5 LIMIT 10

A WITH ends a stage: the nodes and values that it names are what the next one knows, one row a group where it aggregates.
Nodes are tables by label, each with the column id; relationships are tables by type with src, dst and properties. Every
relationship is one join on ids, so the optimizer orders them and pushes filters and columns down to the tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+\.\d+|\d+)|(\$?[A-Za-z_]\w*)|(<>|<=|>=|->|<-|[-(){}\[\]:.,=<>*|+/%]))""")
_WORDS = {"MATCH", "WHERE", "RETURN", "DISTINCT", "AS", "ORDER", "BY", "ASC", "DESC", "SKIP", "LIMIT", "AND", "OR", "NOT", "IN", "CONTAINS", "STARTS", "ENDS", "WITH", "IS", "NULL", "TRUE", "FALSE"}
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_list}
_SCALARS = {"tolower": F.lower, "toupper": F.upper, "size": F.length, "abs": F.abs, "round": F.round}


class CypherError(ValueError):
    """A query that is not of the subset, or that names what the graph lacks."""


@dataclass
class Graph:
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    rels: dict[str, DataFrame] = field(default_factory=dict)
    #: The labels of a relationship's ends, for those that are written.
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)

    def query(self, text: str, **params) -> DataFrame:
        return _Plan(self, text, params).run()


class _Plan:
    def __init__(self, graph: Graph, text: str, params: dict) -> None:
        self.graph, self.params, self.at = graph, params, 0
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise CypherError(f"can't read {text[pos:pos + 20]!r}")
            pos = m.end()
            s, n, w, p = m.groups()
            kind = "string" if s else "number" if n else "sign" if p else "word" if w.upper() in _WORDS else "name"
            self.tokens.append((kind, re.sub(r"\\(.)", r"\1", s[1:-1]) if s else n or p or (w.upper() if kind == "word" else w)))
        self.frame: DataFrame | None = None
        self.known: dict[str, list[str]] = {}
        self.values: set[str] = set()
        self.filters: list[Column] = []
        self.unnamed = 0

    # reading
    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "word") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise CypherError(f"{value} expected, not {self.tokens[self.at][1] if self.at < len(self.tokens) else 'the end'}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise CypherError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    # patterns
    def table(self, var: str, df: DataFrame) -> DataFrame:
        self.known[var] = df.columns
        return df.select(*[F.col(c).alias(f"{var}.{c}") for c in df.columns])

    def properties(self, var: str) -> None:
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                self.filters.append(self.column(var, key) == self.value())
                self.take(",")

    def node(self) -> tuple[str, DataFrame | None]:
        self.need("(")
        var = self.name() if not self.peek(":", ")", "{") else self.fresh()
        df = None
        if self.take(":"):
            label = self.name()
            if label not in self.graph.nodes:
                raise CypherError(f"no nodes {label}")
            if var not in self.known:
                df = self.table(var, self.graph.nodes[label])
        elif var not in self.known:
            raise CypherError(f"{var} needs a label")
        self.properties(var)
        self.need(")")
        return var, df

    def fresh(self) -> str:
        self.unnamed += 1
        return f"_{self.unnamed}"

    def add(self, df: DataFrame | None, on: Column | None = None) -> None:
        if df is not None:
            if self.frame is None:
                self.frame = df
            elif on is None:
                raise CypherError("patterns that share no node are not joined")
            else:
                self.frame = self.frame.join(df, on)

    def path(self) -> None:
        var, df = self.node()
        self.add(df)
        while self.peek("-", "<-"):
            back = self.take("<-") or self.take("-")
            self.need("[")
            rel = self.name() if not self.peek(":", "]") else self.fresh()
            self.need(":")
            kind = self.name()
            if kind not in self.graph.rels:
                raise CypherError(f"no relationships {kind}")
            edge = self.table(rel, self.graph.rels[kind])
            self.properties(rel)
            self.need("]")
            ahead = self.take("->") or self.take("-")
            if (back == "<-") == (ahead == "->"):
                raise CypherError("a relationship has one direction")
            near, far = ("dst", "src") if back == "<-" else ("src", "dst")
            self.add(edge, self.column(var, "id") == self.column(rel, near))
            nxt, df = self.node()
            same = self.column(rel, far) == self.column(nxt, "id")
            if df is None:
                self.filters.append(same)
            self.add(df, same)
            var = nxt

    # expressions
    def column(self, var: str, key: str) -> Column:
        if var not in self.known or key not in self.known[var]:
            raise CypherError(f"no {var}.{key}")
        return F.col(f"`{var}.{key}`")

    def value(self) -> Column:
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.value())
                self.take(",")
            return F.array(*items)
        if self.take("("):
            e = self.either()
            self.need(")")
            return e
        if self.take("NULL"):
            return F.lit(None)
        if b := self.take("TRUE", "FALSE"):
            return F.lit(b == "TRUE")
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "string":
            return F.lit(t)
        if kind == "number":
            return F.lit(float(t) if "." in t else int(t))
        if kind != "name":
            raise CypherError(f"a value expected, not {t or 'the end'}")
        if t.startswith("$"):
            if t[1:] not in self.params:
                raise CypherError(f"no parameter {t}")
            return F.lit(self.params[t[1:]])
        if self.take("("):
            return self.call(t.lower())
        if self.take("."):
            return self.column(t, self.name())
        if t in self.values:
            return F.col(f"`{t}`")
        if t in self.known:
            return self.column(t, "id")
        raise CypherError(f"no {t}")

    def call(self, name: str) -> Column:
        if name in _AGGREGATES:
            self.aggregated = True
            distinct = self.take("DISTINCT")
            arg = F.lit(1) if self.take("*") else self.value()
            self.need(")")
            if distinct:
                return F.countDistinct(arg) if name == "count" else F.collect_set(arg) if name == "collect" else _AGGREGATES[name](arg)
            return _AGGREGATES[name](arg)
        if name not in _SCALARS:
            raise CypherError(f"no function {name}")
        arg = self.either()
        self.need(")")
        return _SCALARS[name](arg)

    def comparison(self) -> Column:
        left = self.value()
        if op := self.take("=", "<>", "<", ">", "<=", ">="):
            right = self.value()
            return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
        if self.take("CONTAINS"):
            return left.contains(self.value())
        if self.take("STARTS"):
            self.need("WITH")
            return left.startswith(self.value())
        if self.take("ENDS"):
            self.need("WITH")
            return left.endswith(self.value())
        if self.take("IN"):
            return F.array_contains(self.value(), left)
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return left.isNotNull() if no else left.isNull()
        return left

    def negated(self) -> Column:
        return ~self.negated() if self.take("NOT") else self.comparison()

    def both(self) -> Column:
        e = self.negated()
        while self.take("AND"):
            e = e & self.negated()
        return e

    def either(self) -> Column:
        e = self.both()
        while self.take("OR"):
            e = e | self.both()
        return e

    # the query
    def run(self) -> DataFrame:
        self.need("MATCH")
        self.patterns()
        while self.take("WITH"):
            self.stage()
            if self.take("MATCH"):
                self.patterns()
        self.need("RETURN")
        distinct, keys, aggregates, names = self.take("DISTINCT"), [], [], []
        while True:
            e, label = self.item()
            names.append(label)
            (aggregates if self.aggregated else keys).append(e.alias(label))
            if not self.take(","):
                break
        df = self.frame.groupBy(*keys).agg(*aggregates).select(*names) if aggregates else self.frame.select(*keys)
        df = self.ordered(df.distinct() if distinct else df, names)
        if self.at < len(self.tokens):
            raise CypherError(f"unread: {self.tokens[self.at][1]}")
        return df

    def patterns(self) -> None:
        """Patterns up to a WHERE, and its filter."""
        while True:
            self.path()
            if not (self.take(",") or self.take("MATCH")):
                break
        if self.take("WHERE"):
            self.filters.append(self.either())
        for f in self.filters:
            self.frame = self.frame.where(f)
        self.filters = []

    def item(self) -> tuple[Column, str]:
        start, self.aggregated = self.at, False
        e = self.either()
        return e, self.name() if self.take("AS") else "".join(t for _, t in self.tokens[start : self.at]).replace(".", "_")

    def stage(self) -> None:
        """The items of a WITH: nodes and relationships keep their columns, other values have the names they get."""
        distinct, nodes, keys, aggregates = self.take("DISTINCT"), [], [], []
        while True:
            kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
            alone = self.at + 1 == len(self.tokens) or self.tokens[self.at + 1][1] in (",", "WHERE", "ORDER", "SKIP", "LIMIT", "MATCH", "RETURN", "WITH")
            if kind == "name" and t in self.known and alone:
                self.at += 1
                nodes.append(t)
            else:
                e, label = self.item()
                if label in self.known:
                    raise CypherError(f"{label} is there already")
                (aggregates if self.aggregated else keys).append((e, label))
            if not self.take(","):
                break
        columns = [f"{n}.{c}" for n in nodes for c in self.known[n]]
        names = [label for _, label in keys + aggregates]
        kept = [F.col(f"`{c}`") for c in columns]
        keyed = [*kept, *[e.alias(label) for e, label in keys]]
        df = self.frame.groupBy(*keyed).agg(*[e.alias(label) for e, label in aggregates]) if aggregates else self.frame.select(*keyed)
        self.frame = self.ordered(df.distinct() if distinct else df, names, [f"`{c}`" for c in columns])
        self.known, self.values = {n: self.known[n] for n in nodes}, set(names)
        if self.take("WHERE"):
            self.frame = self.frame.where(self.either())

    def ordered(self, df: DataFrame, names: list[str], rest: list[str] = []) -> DataFrame:  # noqa: B006
        """df in the order that follows, if one does, ties by all names and the rest, and of its rows those that are asked for."""
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                label = self.name()
                while self.take("."):
                    label += ("_" if f"`{label}.{self.tokens[self.at][1]}`" not in rest else ".") + self.name()
                if label not in names and f"`{label}`" not in rest:
                    raise CypherError(f"order by a returned name, not {label}")
                order.append(F.desc(f"`{label}`") if self.take("DESC") else F.asc(f"`{label}`"))
                self.take("ASC")
                if not self.take(","):
                    break
        skip, limit = self.number("SKIP"), self.number("LIMIT")
        if order or skip is not None or limit is not None:
            df = df.orderBy(*order, *[f"`{n}`" for n in names], *rest)
        if skip:
            df = df.offset(skip)
        return df if limit is None else df.limit(limit)

    def number(self, word: str) -> int | None:
        if not self.take(word):
            return None
        kind, t = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "number":
            raise CypherError(f"{word} needs a number")
        self.at += 1
        return int(t)
