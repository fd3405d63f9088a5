"""The queries opN_<name> over whole tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op9_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scores, train

    docs = table(spark, sf_dir, "documents")
    return scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"))
    return interleave(d, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeats_removed

    return repeats_removed(table(spark, sf_dir, "documents"))


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    copies = mix(table(spark, sf_dir, "documents"))
    docs = copies.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"), F.coalesce(F.min(F.when(F.col("taken") > 0, F.col("ahead"))), F.lit(-1)).alias("first_word"))
    return docs.drop("row")


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import read_back, windows

    told = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return read_back(windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


def op7_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import phrases

    return phrases(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignments

    return alignments(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_secret_scan, op2_stratified_shards, op3_merkle_fingerprints, op4_repeated_substrings, op5_fair_mix, op6_chat_windows, op7_packed_sequences),
        *(op8_near_dedup, op9_boosted_quality, op10_grace_exact_dedup, op11_phrases, op12_token_alignment, op13_token_counts),
    )
}


def _crc_entry(c: int) -> int:
    for _ in range(8):
        c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
    return c


SQL = {
    "op2_stratified_shards": f"""
        WITH b AS (SELECT doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 AS size, md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS k,
                   list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
        c AS (SELECT doc_id, source, size, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, ({[_crc_entry(i) for i in range(256)]})[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n,
              (CAST('0x' || md5('shards phase:' || coalesce(source, '~'))[1:8] AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS phase FROM c),
        f AS (SELECT *, (rank + phase) / n AS fraction FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, k) - 1 AS pos, count(*) OVER () AS total FROM f)
        SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(pos * 8 // total AS INT) AS shard, CAST(pos - ((pos * 8 // total) * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, source, fraction FROM p
    """,
    "op3_merkle_fingerprints": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER o) AS nxt, length(text) // 4 AS q FROM d WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        v AS (SELECT doc_id, 'own' AS kind, text FROM n UNION ALL SELECT doc_id, 'edited', substr(text, 1, length(text) - q) || substr(nxt, 1, q) FROM n),
        s AS (SELECT doc_id, kind, text, list_concat(regexp_extract_all(text, '(?:[^\n]|\n[^\n])*?\n\n+|(?s:.+)'), CASE WHEN text = '' OR suffix(text, chr(10) || chr(10)) THEN [''] ELSE [] END) AS s FROM v),
        p AS (SELECT doc_id, kind, text, list_transform(s, lambda x: list_transform(list_concat(regexp_extract_all(x, '[^\n]*\n+|[^\n]+'), CASE WHEN x = '' OR suffix(x, chr(10)) THEN [''] ELSE [] END),
              lambda y: list_transform(regexp_extract_all(y, '(?:[^ \t\n\x0B\f\r.!?]+[ \t\n\x0B\f\r]*){1,12}[.!?]*[ \t\n\x0B\f\r]*|[.!?]+[ \t\n\x0B\f\r]*|[ \t\n\x0B\f\r]+'), lambda z: sha256(z)))) AS t FROM s),
        h AS (SELECT doc_id, kind, text, list_transform(t, lambda x: list_transform(x, lambda y: {'h': sha256('paragraph' || coalesce(array_to_string(y, ''), '')), 'l': list_transform(y, lambda z: z[1:8])})) AS t FROM p),
        g AS (SELECT doc_id, kind, text, list_transform(t, lambda x: {'h': sha256('section' || array_to_string(list_transform(x, lambda y: y.h), '')), 'p': x}) AS t FROM h),
        r AS (SELECT doc_id, kind, text, t, sha256('root' || array_to_string(list_transform(t, lambda x: x.h), '')) AS root, list_distinct(flatten(list_transform(t, lambda x: flatten(list_transform(x.p, lambda y: y.l))))) AS l,
              array_to_string(list_transform(t, lambda x: x.h[1:8] || '(' || array_to_string(list_transform(x.p, lambda y: y.h[1:8] || '=' || coalesce(array_to_string(y.l, '.'), '')), ',') || ')'), ';') AS shown FROM g),
        a AS (SELECT *, lead(root) OVER o AS root1, first_value(root) OVER o AS root0, lead(l) OVER o AS l1, first_value(l) OVER o AS l0 FROM r WHERE kind = 'own' WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        j AS (SELECT a.doc_id, length(a.text) AS n_chars, sha256(e.text) AS edited_sha256, a.root || '|' || a.shown AS fingerprint, e.root || '|' || e.shown AS edited_fingerprint, a.root, e.root AS er, coalesce(root1, root0) AS nr, a.l, e.l AS el, coalesce(l1, l0) AS nl,
              list_transform(a.t, lambda x: x.h) AS ks, flatten(list_transform(a.t, lambda x: list_transform(x.p, lambda y: y.h))) AS kp, e.t AS et FROM a JOIN r e ON e.kind = 'edited' AND e.doc_id = a.doc_id)
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
               CASE WHEN root = er THEN 1.0 WHEN len(l) + len(el) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(l, el)) / (len(l) + len(el)) END::DOUBLE AS near_edited,
               CASE WHEN root = nr THEN 1.0 WHEN len(l) + len(nl) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(l, nl)) / (len(l) + len(nl)) END::DOUBLE AS near_next,
               CAST(coalesce(len(list_filter(flatten(list_transform(list_filter(et, lambda x: NOT list_contains(ks, x.h)), lambda x: list_transform(x.p, lambda y: y.h))), lambda y: NOT list_contains(kp, y))), 0) AS INT) AS n_edits
        FROM j
    """,
    "op4_repeated_substrings": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)),
        r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY m ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
        i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM r)),
        g AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM i GROUP BY doc_id, run),
        c AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b, a AS e FROM g UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id),
        k AS (SELECT c.doc_id, sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' ORDER BY b))) AS kept_sha256 FROM c JOIN d ON d.doc_id = c.doc_id GROUP BY 1),
        t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, kept_sha256 FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
    """,
    "op5_fair_mix": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS k FROM documents),
        r AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        t AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM l) * w) AS target FROM l),
        c AS (SELECT r.*, t.source_size, t.target, p, CAST(greatest(0, least(r.size, ceil(t.target) - p * t.source_size - r.before)) AS BIGINT) AS offered,
                     CASE WHEN t.target > 0 THEN (p * t.source_size + r.before + r.size) / t.target ELSE 0.0 END AS vfinish
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(p)),
        a AS (SELECT *, coalesce(sum(offered) OVER (ORDER BY vfinish, source NULLS LAST, k, p, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM c),
        m AS (SELECT *, greatest(0, least(offered, (SELECT floor(sum(source_size) * 1.5::DOUBLE) FROM s) - ahead)) AS taken FROM a)
        SELECT doc_id, size, source_size, target, CAST(sum(taken) AS BIGINT) AS taken, CAST(coalesce(min(CASE WHEN taken > 0 THEN ahead END), -1) AS BIGINT) AS first_word
        FROM m GROUP BY doc_id, source, k, size, source_size, target, before
    """,
    "op6_chat_windows": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, len(regexp_extract_all(text, '\w+|[^\w\s]')) + 4 AS n, string_split(text, '<') AS cut FROM t),
        s AS (SELECT *, pos = 1 AND role = 'system' AS sys, length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1
                   + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
                   + len(list_filter(cut, lambda x, i: i > 1 AND (starts_with(x, '|') OR starts_with(x, '/') OR starts_with(x, 'S') OR starts_with(x, 's>') OR (x = '' AND i < len(cut))))) AS chars FROM p),
        o AS (SELECT *, greatest(1024 - max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv_id), 0) AS room, floor(turn / 4096) AS st FROM s),
        b AS (SELECT *, CAST(NOT sys AND n > room // 4 AS BIGINT) AS big, CASE WHEN sys THEN 0 ELSE n END AS m FROM o),
        a AS (SELECT *, coalesce(sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre, 2 * coalesce(sum(big) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + big AS seg0 FROM b WINDOW w AS (PARTITION BY conv_id, st ORDER BY pos)),
        g AS (SELECT *, CASE WHEN sys THEN coalesce(lead(seg0) OVER (PARTITION BY conv_id, st ORDER BY pos), 0) ELSE seg0 END AS seg FROM a),
        c AS (SELECT *, floor((pre - min(pre) OVER (PARTITION BY conv_id, st, seg)) / greatest(room - least(192, room // 4) - room // 4, 1)) AS span FROM g),
        d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, st ORDER BY seg, span) AS win FROM c),
        f AS (SELECT conv_id, st, win, arg_min(pre, pos) AS at0, sum(chars) AS own, any_value(room) - sum(m) AS fits, bool_or(sys) AS has_sys FROM d GROUP BY 1, 2, 3),
        h AS (SELECT f.conv_id, f.st, f.win, f.own, coalesce(sum(d.chars), 0) AS past FROM f LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM f.conv_id
              AND ((NOT d.sys AND d.st IS NOT DISTINCT FROM f.st AND d.pre BETWEEN f.at0 - least(192, f.fits) AND f.at0 - 1) OR (d.sys AND NOT f.has_sys)) GROUP BY 1, 2, 3, 4),
        z AS (SELECT conv_id, sum(own + past) AS formatted_chars FROM h GROUP BY 1),
        y AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM p GROUP BY 1)
        SELECT y.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM y JOIN z ON y.conv_id IS NOT DISTINCT FROM z.conv_id
    """,
    "op8_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * m >= 4 * (x.n + y.n - m)),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, c FROM r JOIN l ON a = doc_id)
        SELECT doc_id, min(c) AS class_id, doc_id = min(c) AS kept FROM r GROUP BY 1
    """,
    "op10_grace_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS w FROM w, range(1, 5) r(m) WHERE len(w) >= m),
        f AS (SELECT lang, w, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT c.lang, c.w, c.f AS a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score FROM f c JOIN range(1, 4) t(k) ON k < len(c.w)
              JOIN f l ON l.lang = c.lang AND l.w = c.w[1:k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1:]),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        s AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len(w)), lambda m: list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])))) AS w FROM f WHERE len(w) > 2),
        x AS (SELECT lang, w, max(f) AS f FROM s GROUP BY ALL),
        n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
        o AS (SELECT b.lang, array_to_string(b.w, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN x ON x.lang = b.lang AND x.w = b.w WHERE x.f IS NULL OR 100::HUGEINT * x.f < 80::HUGEINT * a),
        k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
        SELECT k.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang WHERE rank <= 2000
    """,
}
