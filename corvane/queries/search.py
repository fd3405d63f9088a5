"""Queries over tokens, vectors and fused rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import search as S
from ..plans.cut import cut
from .base import MEM, contents, memories, query, read, rounded
from .stems import DOC_COUNTS

ASK = "the erre reor of ththe on database designs and error logging"
#: Weights of the query: its stems, and synonyms at 0.49.
_WEIGHTS = """qs(token, w) AS (VALUES ('the', 1.0::DOUBLE), ('erre', 1.0), ('reor', 1.0), ('of', 1.0), ('ththe', 1.0), ('on', 1.0), ('databas', 1.0), ('design', 1.0), ('and', 1.0), ('error', 1.0), ('log', 1.0),
    ('err', 0.49), ('exception', 0.49), ('logging', 0.49), ('logs', 0.49))"""


_SPARSE = f"""{DOC_COUNTS}, {_WEIGHTS}, q AS (SELECT qs.token, w * (ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1) AS q, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)) + 1 AS i FROM qs LEFT JOIN df USING (token)),
    sparse AS (SELECT id, sum(least(q, n * i)) / greatest(1.0, (SELECT sum(q) FROM q)) AS score FROM cnt JOIN q USING (token) GROUP BY 1)"""


@query(f"WITH {DOC_COUNTS} SELECT token, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 6) AS idf FROM df")
def token_df_idf(spark, sf_dir):
    """Document frequency of every stem; a text's stems are counted where it lies."""
    d = read(spark, sf_dir, "documents")
    return S.document_frequency(S.counts(d, "doc_id", "text", synonyms=False)).select("token", "df", rounded(S.idf(F.col("df"), d.count())).alias("idf"))


def _sparse(spark, d):
    """Scores of documents for the query; texts are read once, and only the weights of its own stems leave them."""
    terms = S.vector(ASK)
    c = cut(S.counts(d, "doc_id", "text", list(terms)), "counts")
    return S.sparse_scores(c, S.query_weights(spark, terms), S.document_frequency(c), d.count())


@query(f"WITH {_SPARSE} SELECT id, round(score, 6) AS score FROM sparse")
def sparse_overlap_score(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return _sparse(spark, d).select("id", rounded(F.col("score")).alias("score"))


@query(f"WITH {DOC_COUNTS} SELECT token AS stem, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM own GROUP BY 1")
def stemmed_df(spark, sf_dir):
    """How many texts have a stem, and how often."""
    c = S.counts(read(spark, sf_dir, "documents"), "doc_id", "text", synonyms=False)
    return c.groupBy(F.col("token").alias("stem")).agg(F.count("*").alias("df"), F.sum("n").cast("bigint").alias("n"))


@query(f"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(trim(lower(text)), '\\s+'), lambda x: x <> ''))) AS t FROM documents),
    s AS (SELECT min(doc_id) AS id, t FROM w WHERE len(t) > 0 GROUP BY t), e AS (SELECT id, unnest(t) AS token FROM s),
    p AS (SELECT x.id AS a, y.id AS b, count(*) AS i FROM e x JOIN e y ON x.token = y.token AND x.id < y.id GROUP BY 1, 2)
    SELECT a, b, round(i / (len(x.t) + len(y.t) - i), 6) AS jaccard FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE i / (len(x.t) + len(y.t) - i) >= 0.7""")
def jaccard_pairs(spark, sf_dir):
    """Pairs of distinct word sets with a Jaccard similarity of 0.7 or more; equal sets are one."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda x: x != "")).alias("tokens"))
    return S.similar_sets(d, 0.7, once=True).select("a", "b", rounded(F.col("jaccard")).alias("jaccard"))


_LOOK = f"""WITH {DOC_COUNTS}, tot AS (SELECT id, greatest(sum(n), 1.0) AS total FROM cnt GROUP BY 1),
    s AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS m FROM cnt x JOIN cnt y ON x.token = y.token AND y.id < x.id AND y.id >= x.id - <back> GROUP BY 1, 2)
    SELECT a, b, round(m / total, 6) AS sim FROM s JOIN tot ON tot.id = a WHERE m / total >= <least> AND m / total < <below>"""


def _look(back: str, least: str, below: str) -> str:
    return _LOOK.replace("<back>", back).replace("<least>", least).replace("<below>", below)


def _lookback(spark, sf_dir, k, least, below=float("inf"), step=1):
    got = S.lookback(read(spark, sf_dir, "documents"), "doc_id", "text", k, least, below, step)
    return got.select("a", "b", rounded(F.col("sim")).alias("sim"))


@query(_look("20", "0.85", "1e9"))
def near_duplicate_dedup(spark, sf_dir):
    """A memory that shares 0.85 or more of its tokens with one of the 20 before it refreshes that one."""
    return _lookback(spark, sf_dir, 20, 0.85)


@query(_look("28 AND (x.id - y.id) % 7 = 0", "0.6", "0.85"))
def contradiction_supersede(spark, sf_dir):
    """Of the same category among the 28 before it: a similarity of 0.6 to 0.85 supersedes."""
    return _lookback(spark, sf_dir, 28, 0.6, 0.85, 7)


_VEC = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_DOT = f"list_dot_product(embedding::DOUBLE[], {_VEC})"


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _probe(v):
    row = v.where("id = 0").select("vec").first()
    return list(row["vec"]) if row else [0.0]


@query(f"SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings WHERE {_DOT} >= 0.05 ORDER BY round({_DOT}, 9) DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return S.nearest(v, _probe(v), 10).select("id", rounded(F.col("score")).alias("score"))


@query(f"SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings WHERE label = 3 AND {_DOT} >= 0.05 ORDER BY round({_DOT}, 9) DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return S.nearest(v, _probe(v), 10, where=F.col("label") == 3).select("id", rounded(F.col("score")).alias("score"))


@query(f"SELECT vec_id AS id, round({_DOT}, 6) AS score FROM embeddings WHERE {_DOT} >= 0.2")
def vector_min_score(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("id", S.dot(F.col("vec"), F.lit(_probe(v))).alias("score")).where("score >= 0.2").select("id", rounded(F.col("score")).alias("score"))


@query(f"""WITH s AS (SELECT vec_id AS id, label % 3 AS repo, {_DOT} AS score FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, id) AS r FROM s WHERE score >= 0.05)
    SELECT id, repo, round(score, 6) AS score FROM r WHERE r <= CASE WHEN repo = 0 THEN 10 ELSE 5 END ORDER BY round(score, 9) DESC, id LIMIT 10""")
def cross_repo_merge(spark, sf_dir):
    """Ten of the own repository and five of each linked one, merged by score."""
    v = _vectors(spark, sf_dir).withColumn("repo", F.col("label") % 3)
    v = v.withColumn("score", S.dot(F.col("vec"), F.lit(_probe(v)))).where("score >= 0.05")
    r = F.row_number().over(Window.partitionBy("repo").orderBy(F.round("score", 9).desc(), "id"))
    top = v.withColumn("r", r).where(F.col("r") <= F.when(F.col("repo") == 0, 10).otherwise(5))
    return top.orderBy(F.round("score", 9).desc(), "id").limit(10).select("id", "repo", rounded(F.col("score")).alias("score"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT e.vec_id, r.vec_id < 29 AS pos, list_dot_product(e.v, r.v) AS s FROM e, e r WHERE r.vec_id < 52),
    t AS (SELECT *, row_number() OVER (PARTITION BY vec_id, pos ORDER BY s DESC) AS k FROM s), m AS (SELECT vec_id, avg(s) FILTER (pos) AS p, avg(s) FILTER (NOT pos) AS n FROM t WHERE k <= 3 GROUP BY 1)
    SELECT vec_id, round(p, 6) AS pos, round(n, 6) AS neg, p > n AS is_decision FROM m""")
def intent_top3_vote(spark, sf_dir):
    """Mean of the three nearest of 29 positive and of 23 negative reference vectors, for every row."""
    from ..operators.vectors import top3_vote

    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    refs = {r["vec_id"]: r["embedding"] for r in e.where("vec_id < 52").collect()}
    out = top3_vote(e, [refs[i] for i in sorted(refs) if i < 29], [refs[i] for i in sorted(refs) if i >= 29])
    return out.select("vec_id", rounded(F.col("pos")).alias("pos"), rounded(F.col("neg")).alias("neg"), (F.col("pos") > F.col("neg")).alias("is_decision"))


_STREAMS = f"""{_SPARSE}, {MEM},
    dense AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round({_DOT}, 9) DESC, vec_id) - 1 AS rank FROM embeddings WHERE {_DOT} >= 0.05 QUALIFY rank < 30),
    kw AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM mem WHERE contains(lower(content), 'the thth') QUALIFY rank < 30),
    sp AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sparse QUALIFY rank < 30),
    ids AS (SELECT id FROM dense UNION SELECT id FROM kw UNION SELECT id FROM sp),
    fused AS (SELECT ids.id, 0.4 / (60 + coalesce(kw.rank, 14)) + 0.6 / (60 + coalesce(dense.rank, 14)) + 0.3 / (60 + coalesce(sp.rank, 14)) AS score FROM ids LEFT JOIN kw USING (id) LEFT JOIN dense USING (id) LEFT JOIN sp USING (id))"""


def _fusion(spark, sf_dir):
    v, m, d = _vectors(spark, sf_dir), contents(spark, sf_dir), read(spark, sf_dir, "documents")
    dense = S.nearest(v, _probe(v), 30)
    sparse = _sparse(spark, d)
    best = [F.round("score", 9).desc(), F.col("id")]
    lists = {
        "kw": (S.ranked(m.where(F.lower("content").contains("the thth")).select("id"), [F.col("id")], 30), 0.4),
        "dense": (S.ranked(dense, best, 30), 0.6),
        "sparse": (S.ranked(sparse, best, 30), 0.3),
    }
    return S.fused(lists, missing=14), m


@query(f"WITH {_STREAMS} SELECT id, round(score, 6) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fusion(spark, sf_dir)[0].select("id", rounded(F.col("score")).alias("score"))


@query(f"WITH {_STREAMS}, c AS (SELECT fused.*, category, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, id) AS k FROM fused JOIN mem USING (id)) SELECT id, category, round(score, 6) AS score FROM c WHERE k <= 3 ORDER BY round(c.score, 9) DESC, id LIMIT 7")
def hybrid_search(spark, sf_dir):
    """Dense, keyword and sparse ranks fused, at most three of a category, the best seven."""
    scored, m = _fusion(spark, sf_dir)
    return S.diversified(scored.join(m.select("id", "category"), "id"), "category", 3, 7).select("id", "category", rounded(F.col("score")).alias("score"))


@query(f"WITH {MEM}, c AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY access_count DESC, id) AS k, access_count FROM mem) SELECT id, category, access_count FROM c WHERE k <= 3 ORDER BY access_count DESC, id LIMIT 15")
def diversify_per_group(spark, sf_dir):
    return S.diversified(memories(spark, sf_dir), "category", 3, 15, "access_count").select("id", "category", "access_count")


@query(f"""WITH {_SPARSE}, r AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM sparse QUALIFY rank < 20), g AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS rank, label AS distance FROM embeddings WHERE label < 3 QUALIFY rank < 20)
    SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 1 / (61 + rank) AS s FROM r UNION ALL SELECT id, 1 / (61 + rank) + 0.5 / (1 + distance) FROM g) GROUP BY 1""")
def graph_rrf_merge(spark, sf_dir):
    """Keyword ranks at 1 / (61 + rank) and graph hits at 1 / (61 + rank) + 0.5 / (1 + distance)."""
    d = read(spark, sf_dir, "documents")
    sparse = _sparse(spark, d)
    kw = S.ranked(sparse, [F.round("score", 9).desc(), F.col("id")], 20).select("id", (1 / (61 + F.col("rank"))).alias("s"))
    v = _vectors(spark, sf_dir).where("label < 3")
    g = S.ranked(v, [F.col("id")], 20).join(v.select("id", "label"), "id").select("id", (1 / (61 + F.col("rank")) + 0.5 / (1 + F.col("label"))).alias("s"))
    return kw.union(g).groupBy("id").agg(rounded(F.sum("s")).alias("score"))


@query()
def vector_index_search(spark, sf_dir):
    """The ten nearest vectors of every vector whose id 50 divides, by an inverted file over all of them."""
    from ..operators import ivf

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    found = ivf.search(ivf.build(rows), rows.where("id % 50 = 0").withColumnRenamed("id", "query"))
    return found.select("query", "id", rounded(F.col("score")).alias("score"), "place")
