"""Merkle fingerprints of documents, in DataFrame expressions only.

A text is cut without loss into sections (ended by blank lines), paragraphs (lines) and leaves (up to
twelve words of a sentence). Leaves are hashed, a paragraph is the hash of its leaves' hashes, a
section of its paragraphs', the root of its sections'. Equal roots mean equal texts; where
roots differ, branches with equal hashes can be left aside and the rest locates the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SECTION, _PARAGRAPH = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)"
_LEAF = r"(?:[^\s.!?]++\s*+){1,12}+[.!?]*+\s*+|[.!?]++\s*+|\s++"
#: Hex digits of a node that the fingerprint shows; the root is shown whole.
_SHOWN = 8


def tree(text: Column) -> Column:
    """Leaf hashes: sections of paragraphs of leaves. A null text is the empty text."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda s: F.sha2(s, 256))
    paragraphs = lambda s: F.transform(F.split(s, _PARAGRAPH), leaves)
    return F.transform(F.split(F.coalesce(text, F.lit("")), _SECTION), paragraphs)


def nodes(t: Column) -> Column:
    """Of a tree: sections as struct(hash, paragraphs), paragraphs as struct(hash, leaves), hashes in full, leaves as shown."""
    node = lambda kind, children: F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)
    shown = lambda leaves: F.transform(leaves, lambda h: F.substring(h, 1, _SHOWN))
    paragraphs = lambda s: F.transform(s, lambda p: F.struct(node("paragraph", p).alias("hash"), shown(p).alias("leaves")))
    section = lambda ps: F.struct(node("section", F.transform(ps, lambda p: p["hash"])).alias("hash"), ps.alias("paragraphs"))
    return F.transform(F.transform(t, paragraphs), section)


def root(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("root"), F.array_join(F.transform(sections, lambda s: s["hash"]), "")), 256)


def leaves(sections: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.flatten(F.transform(s["paragraphs"], lambda p: p["leaves"])))))


def shown(sections: Column, root_hash: Column) -> Column:
    """The fingerprint: root|section(paragraph=leaf.leaf,...);..."""
    paragraph = lambda p: F.concat(F.substring(p["hash"], 1, _SHOWN), F.lit("="), F.array_join(p["leaves"], "."))
    section = lambda s: F.concat(F.substring(s["hash"], 1, _SHOWN), F.lit("("), F.array_join(F.transform(s["paragraphs"], paragraph), ","), F.lit(")"))
    return F.concat(root_hash, F.lit("|"), F.array_join(F.transform(sections, section), ";"))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 if the roots are equal, else twice the shared leaves over all leaves of both; equal branches share all theirs."""
    both = F.size(leaves_a) + F.size(leaves_b)
    shared = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * shared / both)


def _opened(sections_a: Column, sections_b: Column) -> tuple[Column, Column]:
    """a's paragraphs in sections that b lacks, as struct(section, paragraph, hash), and the hashes of all paragraphs of b."""
    new_s = F.array_except(F.transform(sections_a, lambda s: s["hash"]), F.transform(sections_b, lambda s: s["hash"]))
    known_p = F.flatten(F.transform(sections_b, lambda s: F.transform(s["paragraphs"], lambda p: p["hash"])))
    paragraphs = lambda s, i: F.transform(s["paragraphs"], lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p["hash"].alias("hash")))
    none = F.array().cast("array<struct<section:int,paragraph:int,hash:string>>")
    return F.flatten(F.transform(sections_a, lambda s, i: F.when(F.array_contains(new_s, s["hash"]), paragraphs(s, i)).otherwise(none))), known_p


def edits(sections_a: Column, sections_b: Column) -> Column:
    """Where a differs from b: struct(section, paragraph), from 0, of a's paragraphs that b has nowhere; equal sections aren't opened."""
    opened, known_p = _opened(sections_a, sections_b)
    new_p = F.array_except(F.transform(opened, lambda p: p["hash"]), known_p)
    return F.transform(F.filter(opened, lambda p: F.array_contains(new_p, p["hash"])), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))


def n_edits(sections_a: Column, sections_b: Column) -> Column:
    """The number of edits, by one sort of both sides' hashes: known ones come first among equals."""
    opened, known_p = _opened(sections_a, sections_b)
    tagged = lambda hashes, new: F.transform(hashes, lambda h: F.struct(h.alias("hash"), F.lit(new).alias("new")))
    both = F.sort_array(F.concat(tagged(F.array_distinct(known_p), False), tagged(F.transform(opened, lambda p: p["hash"]), True)))
    start = F.struct(F.lit("").alias("known"), F.lit(0).alias("n"))
    step = lambda a, x: F.when(~x["new"], F.struct(x["hash"].alias("known"), a["n"].alias("n"))).otherwise(F.struct(a["known"].alias("known"), (a["n"] + (x["hash"] != a["known"]).cast("int")).alias("n")))
    return F.aggregate(both, start, step, lambda a: a["n"])


def with_next(docs: DataFrame, id_col: str, text_col: str, slices: int) -> DataFrame:
    """doc_id, text, tie, bucket and, marked ghost, the row that follows each bucket's last; texts are shuffled once.

    Rows go by id, then tie, a hash of the text. Ids are cut into ranges at approximate quantiles; where one id, or null, has the rows of several
    ranges, its ties are cut evenly. The first row of each range is also given to
    the range before, the very first to the last. The driver sees a few numbers a range.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 33))  # 31 bits
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    at = [i / slices for i in range(1, slices)] or [0.5]
    cuts = sorted(set(d.agg(F.percentile_approx(key, at, 20 * slices).alias("c")).first()["c"] or []))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def found() -> Column:
        if not cuts:
            return F.lit(0)
        array = F.lit(cuts)
        fits = lambda n, step: F.coalesce(F.get(array, n + step - 1) <= key, F.lit(False))
        return F.aggregate(F.lit(steps), F.lit(0), lambda n, step: F.when(fits(n, step), n + step).otherwise(n))

    by_bucket = lambda values: F.get(F.lit([values.get(b, 0) for b in range(len(cuts) + 1)]), F.col("bucket"))
    d = d.withColumn("bucket", found())
    seen = {r["bucket"]: r for r in d.groupBy("bucket").agg(F.count("*").alias("n"), F.min(key).alias("head")).collect()}
    if not seen:
        return d.withColumn("ghost", F.lit(False))
    even = max(1, sum(r["n"] for r in seen.values()) // slices)
    large = {b: r["head"] for b, r in seen.items() if r["n"] > 2 * even}
    first = {b: (r["head"], None) for b, r in seen.items()}
    if large:  # an id that is many ranges by itself is a quantile, so it is the least of its range
        counts = d.where(key == by_bucket(large)).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        parts = {r["bucket"]: -(-r["n"] // even) for r in counts if r["bucket"] in large and r["n"] > 2 * even}
        ahead, offset = 0, {}
        for b in range(len(cuts) + 1):
            offset[b] = ahead
            ahead += parts.get(b, 0) + 1
        own = by_bucket(parts)
        inside = F.when((own > 0) & (key == by_bucket({b: large[b] for b in parts})), F.floor(F.col("tie") * own / 2**31).cast("int")).otherwise(own.cast("int"))
        d = d.withColumn("bucket", by_bucket(offset) + inside)
        cuts = [0] * ahead
        first = {r["bucket"]: tuple(r["f"]) for r in d.groupBy("bucket").agg(F.min(F.struct(key, "tie")).alias("f")).collect()}
    full = sorted(first)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    places = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(by_bucket(before).alias("bucket"), F.lit(True).alias("ghost"))
    is_first = key == by_bucket({b: f[0] for b, f in first.items()})
    if large:
        is_first &= F.col("tie") == by_bucket({b: f[1] for b, f in first.items()})
    places = F.when(is_first, F.array(places, ghost)).otherwise(F.array(places))
    return d.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.bucket", "p.ghost")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_edits (paragraphs of the edited text that are new).

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones
    of the next document's, or all there are; the last document is followed by the first. Null
    texts are empty; null ids come first; rows that repeat an id follow each other by a hash of the text, then text. One
    document is its own next. An empty table gives an empty result.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_next(docs, id_col, text_col, min(4 * parts, 20000)).repartition(parts, "bucket")
    d = d.withColumn("_s", nodes(tree(F.col("text"))))
    d = d.withColumn("_r", root(F.col("_s"))).withColumn("_l", leaves(F.col("_s")))
    w = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "tie", "text")
    n = F.length("text").cast("bigint")
    d = d.withColumns({f"_next{c}": F.lead(c).over(w) for c in ("text", "_r", "_l")}).where(~F.col("ghost"))
    cut = F.floor(n / 4).cast("int")
    d = d.withColumn("_e", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("_nexttext", F.lit(1), cut)))
    d = d.withColumn("_es", nodes(tree(F.col("_e"))))
    d = d.withColumn("_er", root(F.col("_es"))).withColumn("_el", leaves(F.col("_es")))
    return d.select(
        "doc_id",
        n.alias("n_chars"),
        F.sha2("_e", 256).alias("edited_sha256"),
        shown(F.col("_s"), F.col("_r")).alias("fingerprint"),
        shown(F.col("_es"), F.col("_er")).alias("edited_fingerprint"),
        likeness(F.col("_r"), F.col("_l"), F.col("_er"), F.col("_el")).alias("near_edited"),
        likeness(F.col("_r"), F.col("_l"), F.col("_next_r"), F.col("_next_l")).alias("near_next"),
        n_edits(F.col("_es"), F.col("_s")).alias("n_edits"),
    )
