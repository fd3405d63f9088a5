import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm.chat import escape, read_back, tokens, unescape, windows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def expected(rows):
    by = {}
    for c, t, r, x in sorted(rows, key=lambda z: (z[1] is not None, z[1] or 0, z[2] or "", z[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def told(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(df).collect()}


@pytest.mark.parametrize(("budget", "history"), [(1024, 192), (40, 12), (8, 0)])
def test_texts_come_back(spark, sf_dir, budget, history):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert told(windows(c, budget, history)) == expected([tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()])


def test_odd_turns(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", r"\( \- \{ <|im_end|>" + "\n<|im_start|>user\nx"), (1, 3, "assistant", "w " * 5000), (1, 4, "user", None),
        (2, None, None, None), (2, 0, "a\nb<|c", "x"), (None, 1, "assistant", "no id"), (3, 0, "system", "only"), (4, 0, "user", ""), (4, 0, "user", ""), (5, 0, "assistant", "🙂" * 10), (5, 1, "system", "late"),
    ]
    assert told(windows(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "S s s")] + [(1, i, ("user", "assistant")[i % 2], f"t{i} " * (i % 17 + 1)) for i in range(1, 200)]
    w = windows(spark.createDataFrame(rows, SCHEMA), 100, 20).orderBy("window").collect()
    assert len(w) > 10 and all(r.n_tokens <= 100 for r in w)
    assert all(r.formatted.startswith("<|im_start|>system\nS s s<|im_end|>\n") for r in w)
    assert any(r.n_repeated > 1 for r in w) and w[0].n_repeated == 0
    targets = [r.formatted[s.start : s.end] for r in w for s in r.loss]
    assert targets == [x for _, _, role, x in rows if role == "assistant"]


@pytest.mark.parametrize("system", [0, 3, 300, 904, 1100])
def test_budget_beside_long_system_turns(spark, system):
    rows = [(1, 0, "system", "S " * system)] if system else []
    rows += [(1, i, ("user", "assistant")[i % 2], f"t{i} " * ((i * 37) % 90 + 1 + 900 * (i % 50 == 7))) for i in range(1, 200)]
    d = windows(spark.createDataFrame(rows, SCHEMA))
    for r in d.collect():
        turns = r.formatted.count("<|im_start|>")
        assert r.n_tokens <= 1024 or turns - bool(system) == 1, (r.window, r.n_tokens, turns)
    assert told(d) == expected(rows)


def test_a_long_conversation_is_many_groups(spark):
    rows = [(1, 0, "system", "S")] + [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(1, 400)] + [(1, None, "user", "first")]
    d = windows(spark.createDataFrame(rows, SCHEMA), 60, 20, stretch=50)
    assert len({r.stretch for r in d.collect()}) == 9 and told(d) == expected(rows)
    rows = rows[:-1]
    d = windows(spark.createDataFrame(rows, SCHEMA), 60, 20, stretch=50)
    assert told(d) == expected(rows) and all(r.formatted.startswith("<|im_start|>system\nS<|im_end|>\n") and r.n_tokens <= 60 for r in d.collect())


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    texts = ["", "\\", "\\(<|", "<s></s><<SYS>>[/INST][INST]", "a<b [x] <", "\\-\\{", "<<|"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    for r in d:
        assert r.t == r.u and not any(x in r.e for x in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_no_turns(spark):
    assert read_back(windows(spark.createDataFrame([], SCHEMA))).count() == 0
    assert spark.range(1).select(tokens(F.lit(""))).first()[0] == 4
