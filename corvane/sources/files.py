"""A source tree as tables: files with hash and language, projects by manifest, parsed symbols."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, folders that are left out, the largest file in bytes, manifests with their languages.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".vue": "javascript", ".go": "go", ".cs": "csharp", ".java": "java", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".scala": "scala", ".sc": "scala",
}
IGNORED = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", "egg-info", "bin", "obj", "packages", ".vs", "wwwroot", "publish",
    "artifacts", "TestResults", "target", "vendor", ".gradle", ".idea", ".next", "_next", "out",
]
LARGEST = 200_000
MANIFESTS = {"pyproject.toml": "python", "package.json": "javascript", "go.mod": "go", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "composer.json": "php"}

_SYMBOLS = "classes array<struct<name:string,implements:string,methods:array<string>>>, functions array<string>, imports array<string>"
#: Declarations of languages without a parser at hand: classes, functions and imports by pattern.
_PATTERNS = {
    "javascript": (r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+\s*\([^)]*\))", r"""(?:from\s+|require\(\s*|^import\s+)["']([^"']+)["']"""),
    "csharp": (r"\b(?:class|interface|record)\s+(\w+)(?:\s*:\s*([\w<>, .]+))?", r"\b(?:public|private|protected|internal)\s+(?:static\s+|async\s+)*[\w<>\[\]]+\s+(\w+\s*\([^)]*\))", r"^\s*using\s+([\w.]+);"),
    "go": (r"^type\s+(\w+)\s+(?:struct|interface)()", r"^func\s+(?:\([^)]*\)\s*)?(\w+\([^)]*\))", r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"'),
    "java": (r"\b(?:class|interface|enum)\s+(\w+)(?:.*?\bimplements\s+([\w, .]+))?", r"\b(?:public|private|protected)\s+(?:static\s+|final\s+)*[\w<>\[\]]+\s+(\w+\s*\([^)]*\))", r"^import\s+(?:static\s+)?([\w.]+);"),
    "rust": (r"\b(?:struct|enum|trait)\s+(\w+)()", r"\bfn\s+(\w+\s*\([^)]*\))", r"^\s*use\s+([\w:]+)"),
    "ruby": (r"^\s*class\s+(\w+)(?:\s*<\s*([\w:]+))?", r"^\s*def\s+([\w.?!]+(?:\([^)]*\))?)", r"""^\s*require(?:_relative)?\s+["']([^"']+)["']"""),
    "php": (r"\b(?:class|interface|trait)\s+(\w+)(?:.*?\bimplements\s+([\w, \\]+))?", r"\bfunction\s+(\w+\s*\([^)]*\))", r"^\s*use\s+([\w\\]+)"),
    "c": (r"\b(?:struct|class)\s+(\w+)\s*(?::\s*(?:public\s+)?(\w+))?\s*\{", r"^[\w*&:<> ]+\s+(\w+\([^;{)]*\))\s*\{", r"""^\s*#include\s+[<"]([^>"]+)"""),
    "kotlin": (r"\b(?:class|interface|object)\s+(\w+)(?:\([^)]*\))?(?:\s*:\s*([\w<>, .()]+))?", r"\bfun\s+(?:<[^>]*>\s*)?([\w.]+\s*\([^)]*\))", r"^import\s+([\w.]+)"),
    "swift": (r"\b(?:class|struct|protocol|enum)\s+(\w+)(?:\s*:\s*([\w, ]+))?", r"\bfunc\s+(\w+\s*\([^)]*\))", r"^import\s+(\w+)"),
    "scala": (r"\b(?:class|object|trait)\s+(\w+)(?:.*?\bextends\s+(\w+))?", r"\bdef\s+(\w+(?:\([^)]*\))?)", r"^import\s+([\w.]+)"),
}
_PATTERNS |= {"typescript": _PATTERNS["javascript"], "cpp": _PATTERNS["c"]}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def scan(spark: SparkSession, root: str, ignored: list[str] = IGNORED, largest: int = LARGEST) -> DataFrame:
    """(path, name, language, size, hash, content) of source files under root; ignored folders and larger files are left out.

    The hash is the first sixteen hex digits of the content's SHA-256.
    """
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= largest)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    f = f.select(path.alias("raw"), "content", "length")
    f = f.withColumn("path", F.substring("raw", len(re.sub("^[a-z]+:/+", "/", base)) + 1, 1 << 20))
    parts = F.split("path", "/")
    f = f.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts)), F.array(*map(F.lit, ignored))))
    return f.select("path", F.element_at(parts, -1).alias("name"), _lookup(LANGUAGES, F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).alias("language"), F.col("length").alias("size"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), "content")


def ignore_list(spark: SparkSession, path: str) -> list[str]:
    """Names from an ignore file: one a line, # begins a comment, slashes and quotes are dropped."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim(F.regexp_replace("value", "#.*", "")), "[/'\"]", "").alias("n"))
    return [r.n for r in lines.where("n <> ''").collect()]


def projects(files: DataFrame) -> DataFrame:
    """(path, name, language, manifest): one project a folder that has a manifest; of several manifests the first named counts."""
    order = {m: i for i, m in enumerate([*MANIFESTS, "*.csproj"])}
    manifest = F.when(F.col("name").isin(*MANIFESTS), F.col("name")).when(F.col("name").endswith(".csproj"), "*.csproj")
    text = F.decode("content", "utf-8")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    given = F.when(F.col("name") == "package.json", F.get_json_object(text, "$.name")).when(F.col("name") == "go.mod", F.regexp_extract(text, r"^module\s+(?:\S*/)?([^/\s]+)", 1))
    base = F.when(folder == "", "root").otherwise(F.element_at(F.split(folder, "/"), -1))
    p = files.withColumn("manifest", manifest).where("manifest IS NOT NULL").select(folder.alias("path"), F.coalesce(given, base).alias("project"), F.coalesce(_lookup(MANIFESTS, F.col("manifest")), F.lit("csharp")).alias("language"), "manifest")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("manifest"))
    return p.groupBy("path").agg(F.min_by(F.struct("project", "language", "manifest"), rank).alias("p")).select("path", F.col("p.project").alias("name"), "p.language", "p.manifest")


def _python(source: str) -> tuple[list, list, list]:
    tree = ast.parse(source)
    sign = lambda f: f"{f.name}({', '.join(a.arg for a in f.args.args)})"
    is_fn = lambda n: isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)
    classes = [{"name": c.name, "implements": ", ".join(ast.unparse(b) for b in c.bases), "methods": [sign(m) for m in c.body if is_fn(m)]} for c in tree.body if isinstance(c, ast.ClassDef)]
    imports = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
    imports += ["." * n.level + (n.module or "") for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)]
    return classes, [sign(f) for f in tree.body if is_fn(f)], imports


def symbols(source: str, language: str | None) -> tuple[list, list, list]:
    """Classes, functions and imports of a source text; Python by its own parser, others by pattern. What can't be parsed has none."""
    if language == "python":
        try:
            return _python(source)
        except (SyntaxError, ValueError):
            return [], [], []
    if language not in _PATTERNS:
        return [], [], []
    if "<script" in source:
        source = re.sub(r"(?s).*?<script[^>]*>(.*?)</script>.*", r"\1", source, count=1)
    classes, functions, imports = (re.compile(p, re.MULTILINE) for p in _PATTERNS[language])
    return [{"name": m[1], "implements": (m[2] or "").strip(), "methods": []} for m in classes.finditer(source)], [m[1] for m in functions.finditer(source)], [m[1] for m in imports.finditer(source)]


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [symbols(bytes(c).decode("utf-8", "replace"), lang) for c, lang in zip(b["content"], b["language"])]
        yield pd.DataFrame({"path": b["path"], "language": b["language"], "classes": [f[0] for f in found], "functions": [f[1] for f in found], "imports": [f[2] for f in found]})


def parsed(files: DataFrame) -> DataFrame:
    """(path, language, classes, functions, imports) of every file with a language."""
    return files.where("language IS NOT NULL").select("path", "language", "content").mapInPandas(_parse, f"path string, language string, {_SYMBOLS}")


def with_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Parses by content: what the cache (hash, classes, functions, imports) has is taken from there, with the file's own path."""
    known = files.join(cache, "hash").select("path", "language", "classes", "functions", "imports")
    return known.unionByName(parsed(files.join(cache.select("hash"), "hash", "left_anti")))


def nodes(parse: DataFrame) -> DataFrame:
    """(id, label, name, file, signature) of classes, methods and functions; the nth method of a name in a class ends in _n."""
    from pyspark.sql import Window

    name = lambda sig: F.trim(F.regexp_replace(F.element_at(F.split(sig, r"\("), 1), r"^(def|func)\s+", ""))
    c = parse.select("path", F.explode("classes").alias("c"))
    classes = c.select(F.concat("path", F.lit(":"), "c.name").alias("id"), F.lit("Class").alias("label"), F.col("c.name").alias("name"), F.col("path").alias("file"), F.col("c.implements").alias("signature"))
    functions = parse.select("path", F.explode("functions").alias("s")).select(F.concat("path", F.lit(":"), name(F.col("s"))).alias("id"), F.lit("Function").alias("label"), name(F.col("s")).alias("name"), F.col("path").alias("file"), F.col("s").alias("signature"))
    m = c.select("path", F.col("c.name").alias("owner"), F.posexplode("c.methods").alias("pos", "s")).withColumn("name", F.element_at(F.split(name(F.col("s")), r"\s+"), -1))
    nth = F.row_number().over(Window.partitionBy("path", "owner", "name").orderBy("pos"))
    ident = F.concat("path", F.lit(":"), "owner", F.lit("."), "name", F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""))
    methods = m.select(ident.alias("id"), F.lit("Method").alias("label"), "name", F.col("path").alias("file"), F.col("s").alias("signature"))
    return classes.unionByName(functions).unionByName(methods)


def vector_chunks(parse: DataFrame) -> DataFrame:
    """(id, content): a class with what it implements and ten methods, a function's signature; 500 characters at most."""
    c = parse.select("path", F.explode("classes").alias("c"))
    text = F.concat_ws(" ", "c.name", "c.implements", F.array_join(F.slice("c.methods", 1, 10), " "))
    f = parse.select("path", F.explode("functions").alias("s"))
    return c.select(F.concat("path", F.lit(":"), "c.name").alias("id"), F.substring(text, 1, 500).alias("content")).unionByName(f.select(F.concat("path", F.lit(":"), F.element_at(F.split("s", r"\("), 1)).alias("id"), F.substring("s", 1, 500).alias("content")))


def refreshed(table: DataFrame, changed: DataFrame, removed: DataFrame, key: str = "file") -> DataFrame:
    """A node or edge table after a change: rows of changed and removed files go, new rows of changed files come."""
    return table.join(changed.select(key).union(removed.select(key)).distinct(), key, "left_anti").unionByName(changed)
