"""Documents with nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, slot string, rep string, _key string, _row string, doc string, bands string, target string, anchor string, __file bigint, __at string"


def rows():
    long_ = " ".join(f"w{i * 7919 % 5003}" for i in range(20000))
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    texts = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "de", "b"),
        (6, long_, "en", "a"), (7, long_ + " tail", "en", None), (8, "one two", "fr", "c"), (9, "One two", "fr", "c"), (None, "no id here at all", "en", "a"),
        (None, None, "en", "a"), (10, "Ünïcödé 🙂 text\n\nsecond   paragraph.", "de", "ü"), (10, "Ünïcödé 🙂 text\n\nsecond   paragraph.", "de", "ü"), (11, "aaaa " * 400, "en", "a"), (12, "x", "en", "d"),
    ]
    return [(i, t, lang, s, len(t or ""), 1, "s", "t", "r", "k", "w", "d", "b", "t", "a", 7, "at") for i, t, lang, s in texts]


def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
