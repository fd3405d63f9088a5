"""From imports and names to files and symbols: import resolution, calls between symbols, symbols that texts contain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import symbols_in
from .code import resolved_calls

# Endings that an import may stand for, in order; roots of Java sources; confidence of a call by how it was found.
ENDINGS = [".py", ".ts", ".js", ".cs"]
INDEXES = ["/index.ts", "/index.js", "/__init__.py", ".java"]
JAVA_ROOTS = ["src/main/java/", "src/test/java/", "src/"]
IMPORTED, INVOKED, ANYWHERE = 0.9, 0.85, 0.5
LEAST = 3


def module_of(statement: Column) -> Column:
    """The module that an import statement names."""
    bare = F.regexp_replace(statement, r"\b(from|import|using)\s+", "")
    return F.regexp_replace(F.element_at(F.split(F.trim(bare), r"\s+"), 1), r"^['\"]|['\";]+$", "")


def _joined(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, without . and .. segments."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), relative), "/"), lambda s: ~s.isin("", "."))
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", up(a)).otherwise(F.concat(a, F.array(s)))), "/")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, import, target): of the paths that each import (file, import) may stand for the first that is one of files (path).

    Relative ones go from the importing file's folder; others from the root, then that folder; Java's by what follows a source root. Imports of * have none.
    """
    module, folder = module_of(F.col("import")), F.regexp_replace("file", "/?[^/]*$", "")
    relative = module.startswith("./") | module.startswith("../")
    base = F.when(relative, _joined(folder, module)).otherwise(F.replace(module, F.lit("."), F.lit("/")))
    i = imports.select("file", "import").distinct().where(~module.endswith("*") & (module != "")).withColumns({"base": base, "folder": folder, "relative": relative})
    plain = [F.concat("base", F.lit(e)) for e in ENDINGS]
    beside = [F.when(F.col("folder") != "", F.concat("folder", F.lit("/"), "base", F.lit(e))) for e in ENDINGS]
    java = F.when(F.col("file").endswith(".java"), F.concat(F.lit("java:"), "base", F.lit(".java")))
    tried = F.when(F.col("relative"), F.array(*plain)).otherwise(F.array(*plain, *[F.concat("base", F.lit(e)) for e in INDEXES], *beside, java))
    c = i.select("file", "import", F.posexplode(tried).alias("place", "key")).where("key IS NOT NULL")
    suffix = F.col("path")
    for root in reversed(JAVA_ROOTS):
        suffix = F.when(F.col("path").contains(root), F.substring_index(F.col("path"), root, -1) if root != "src/" else F.regexp_replace("path", "^.*?src/", "")).otherwise(suffix)
    keys = files.select(F.col("path").alias("key"), "path").union(files.where(F.col("path").endswith(".java")).select(F.concat(F.lit("java:"), suffix), "path"))
    hit = c.join(keys, "key").groupBy("file", "import").agg(F.min_by("path", F.struct("place", "path")).alias("target"))
    return hit.where("target <> file")


def contained(texts: DataFrame, symbols: DataFrame, id_col: str, text_col: str, least: int = LEAST, signs: str = "A-Za-z0-9_") -> DataFrame:
    """(id, symbol) where a symbol of `least` or more of these signs is anywhere in the text, within longer words too."""
    s = symbols.where(F.col("symbol").rlike(f"^[{signs}]{{{least},}}\\z"))
    return symbols_in(texts, s, id_col, text_col).select("id", F.explode("symbols").alias("symbol")).distinct()


def calls_between(symbols: DataFrame, imports: DataFrame, sources: DataFrame | None = None, invocations: DataFrame | None = None) -> DataFrame:
    """(src, dst, confidence, reason): calls from each file's first symbol, by ids file:symbol, the surest of each pair.

    symbols: file, symbol, label (Class, Function or Method), place. A file calls all symbols of the files that it imports (file, target) but its own; with sources
    (file, text) of files that import anything also classes and functions elsewhere that its text contains, the last definition of a name counting; with
    invocations (file, caller, type) also the types invoked.
    """
    named = symbols.where("label <> 'Method'")
    first = named.groupBy("file").agg(F.min_by("symbol", F.struct((F.col("label") != "Class").cast("int").alias("late"), "place")).alias("first"))
    own = symbols.select("file", "symbol").distinct()
    src = F.concat("file", F.lit(":"), F.coalesce("first", F.element_at(F.split(F.element_at(F.split("file", "/"), -1), r"\."), 1)))
    edges = imports.select("file", "target").distinct()
    there = edges.join(own.select(F.col("file").alias("target"), "symbol"), "target").where(F.length("symbol") >= LEAST).join(own, ["file", "symbol"], "left_anti")
    found = there.join(first, "file", "left").select(src.alias("src"), F.concat("target", F.lit(":"), "symbol").alias("dst"), F.lit(IMPORTED).alias("confidence"), F.lit("import-resolved").alias("reason"))
    defined = named.groupBy("symbol").agg(F.max_by("file", F.struct("file", "place")).alias("target"))
    if sources is not None:
        asking = sources.join(edges.select("file").distinct(), "file", "left_semi")
        hit = contained(asking, named, "file", "text").withColumnRenamed("id", "file").join(defined, "symbol").where("target <> file")
        hit = hit.join(edges, ["file", "target"], "left_anti").join(own, ["file", "symbol"], "left_anti")
        found = found.union(hit.join(first, "file", "left").select(src, F.concat("target", F.lit(":"), "symbol"), F.lit(ANYWHERE), F.lit("global")))
    if invocations is not None:
        to = invocations.join(defined.withColumnRenamed("symbol", "type"), "type").where("target <> file")
        found = found.union(to.select(F.concat("file", F.lit(":"), "caller"), F.concat("target", F.lit(":"), "type"), F.lit(INVOKED), F.lit("java-invocation")))
    return resolved_calls(found)


def split_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls with relation: CALLS between functions and CLASS_DEPENDS between classes of nodes (id, label); others go."""
    end = lambda c: nodes.where("label IN ('Function', 'Class')").select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")).distinct()
    both = calls.join(end("src"), "src").join(end("dst"), "dst").where("src_label = dst_label")
    return both.select("src", "dst", "confidence", "reason", F.when(F.col("src_label") == "Function", "CALLS").otherwise("CLASS_DEPENDS").alias("relation"))


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of communities (node, community) in an undirected weighted graph (src, dst, weight); nodes without a community are alone."""
    e = edges.select("src", "dst", "weight").where("src <> dst")
    ends = e.select(F.col("src").alias("node"), "weight").union(e.select("dst", "weight")).groupBy("node").agg(F.sum("weight").alias("degree"))
    at = ends.join(members, "node", "left").select("node", "degree", F.coalesce(F.col("community").cast("string"), F.concat(F.lit("-"), F.col("node").cast("string"))).alias("c"))
    x, y = at.select(F.col("node").alias("src"), F.col("c").alias("a")), at.select(F.col("node").alias("dst"), F.col("c").alias("b"))
    inside = e.join(x, "src").join(y, "dst").agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight"))), F.lit(0.0)).alias("inside"), F.sum("weight").alias("m"))
    squares = at.groupBy("c").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    return inside.crossJoin(squares).select((F.col("inside") / F.col("m") - F.col("s") / (4 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each
