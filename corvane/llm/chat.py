"""Chat formatting in budgeted windows, in DataFrame expressions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window is the system
turn, some turns before the span repeated as history, and the span itself; the loss mask covers
the assistant texts of the span alone, so every assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, and of the turns before it that it repeats.
BUDGET, HISTORY = 1024, 192
#: Turn numbers that are formatted together.
STRETCH = 4096
#: Tokens that the template's marks count for a turn.
MARKS = 4


def escape(text: Column) -> Column:
    """Every backslash becomes \\-, and the first character of a control string \\( for < and \\{ for [."""
    t = F.replace(text, F.lit("\\"), F.lit("\\-"))
    t = F.regexp_replace(t, r"<(?=[|/<]|s>|S)", r"\\(")
    return F.regexp_replace(t, r"\[(?=/?INST\])", r"\\{")


def unescape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\("), F.lit("<"))
    t = F.replace(t, F.lit("\\{"), F.lit("["))
    return F.replace(t, F.lit("\\-"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Words and other signs, and the template's marks."""
    return (F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + MARKS).cast("bigint")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """conv_id, stretch, window, n_tokens, n_repeated, formatted, loss (array of start and end in code points) from conv_id, turn, role, text.

    Turns go by turn, then role and text; nulls come first, and a null role or text is empty. A
    first turn of the role system is kept in every window. The room is what the budget leaves beside it. A span holds turns of at
    most a quarter of the room each, as many as begin within a stride, so that they fit together; a longer turn is a span of its own. History is the turns
    that begin at most `history` tokens before the span, as far as they fit beside it: it is dropped first. No window exceeds the
    budget but one: turns are never cut, so where the system turn and a single turn do so by themselves, the window holds just these.
    Turn numbers are cut at multiples of `stretch`, which no window crosses, so a conversation that is a third of all rows is many groups. A
    null conv_id is a conversation. An empty table gives none.
    """
    key = ["_c", "_s"]
    own, whole = Window.partitionBy(*key), Window.partitionBy("_c")
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumns({"_c": F.coalesce(F.col("conv_id").cast("string"), F.lit("~")), "_s": F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(2**62)))})
    first = t.groupBy(*key).agg(F.min(F.struct("turn", "role", "text")).alias("f")).withColumns({"f": F.min(F.struct("_s", "f")).over(whole)["f"], "opens": F.col("_s") == F.min("_s").over(whole)})
    first = first.select(*key, F.when(F.col("f.role") == "system", F.col("f.text")).alias("sys_text"), F.when(F.col("f.role") == "system", tokens(F.col("f.text"))).otherwise(0).alias("sys_n"), "opens")
    t = t.withColumn("pos", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "role", "text"))).join(first, key)
    t = t.withColumn("sys", F.col("opens") & (F.col("pos") == 1) & F.col("sys_text").isNotNull()).withColumn("n", tokens(F.col("text")))
    room = F.greatest(F.lit(budget) - F.col("sys_n"), F.lit(0))
    by_pos = own.orderBy("pos")
    before = by_pos.rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(F.col("sys"), F.lit(0)).otherwise(F.col("n"))
    t = t.withColumns({"room": room, "most": F.floor(room / 4), "own_n": plain})
    big = (~F.col("sys") & (F.col("n") > F.col("most"))).cast("bigint")
    t = t.withColumns({"at": F.coalesce(F.sum("own_n").over(before), F.lit(0)), "seg": 2 * F.coalesce(F.sum(big).over(before), F.lit(0)) + big})
    t = t.withColumn("seg", F.when(F.col("sys"), F.coalesce(F.lead("seg").over(by_pos), F.lit(0))).otherwise(F.col("seg")))
    stride = F.greatest(F.col("room") - F.least(F.lit(history), F.col("most")) - F.col("most"), F.lit(1))
    t = t.withColumn("span", F.floor((F.col("at") - F.min("at").over(Window.partitionBy(*key, "seg"))) / stride))
    t = t.withColumn("window", F.dense_rank().over(own.orderBy("seg", "span")))
    turn = F.struct("pos", F.col("role"), F.col("text"), "n")
    past = F.collect_list(F.when(~F.col("sys"), F.struct(turn.alias("turn"), "at"))).over(own.orderBy("at").rangeBetween(-history, -1))
    t = t.withColumn("past", past).withColumn("lead", F.col("pos") == F.min("pos").over(Window.partitionBy(*key, "window")))
    t = t.withColumn("past", F.when(F.col("lead"), F.struct("past", "at")))
    g = t.groupBy(*key, "window").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("own"), F.first("past", ignorenulls=True).alias("p"), F.first("sys_text").alias("sys_text"), F.max("sys_n").alias("sys_n"),
        F.max("room").alias("room"), F.sum("own_n").alias("own_n"), F.bool_or("sys").alias("has_sys"),
    )
    fits = F.filter("p.past", lambda x: x["at"] >= F.col("p.at") - (F.col("room") - F.col("own_n")))
    g = g.withColumn("past", F.sort_array(F.transform(fits, lambda x: x["turn"])))
    system = F.struct(F.lit(0).alias("pos"), F.lit("system").alias("role"), F.col("sys_text").alias("text"), F.col("sys_n").cast("bigint").alias("n"))
    kept = F.when(~F.col("has_sys") & F.col("sys_text").isNotNull(), F.array(system)).otherwise(F.slice("own", 1, 0))
    g = g.withColumn("again", F.concat(kept, "past")).withColumn("all", F.concat("again", "own")).withColumn("n_repeated", F.size("again"))
    role = lambda r: F.replace(escape(r), F.lit("\n"), F.lit("\\~"))
    parts = F.transform("all", lambda x, i: F.struct(F.concat(F.lit(START), role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), ((i >= F.col("n_repeated")) & (x["role"] == "assistant")).alias("target")))
    g = g.withColumn("parts", parts)
    loss = F.expr(f"""aggregate(parts, struct(0 AS at, cast(array() AS array<struct<start:int,end:int>>) AS spans),
        (a, p) -> struct(a.at + length(p.head) + length(p.body) + {len(END)} AS at,
            if(p.target, a.spans || array(struct(a.at + length(p.head) AS start, a.at + length(p.head) + length(p.body) AS end)), a.spans) AS spans),
        a -> a.spans)""")
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    n = F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return g.select("conv_id", F.col("_s").alias("stretch"), "window", n.alias("n_tokens"), "n_repeated", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from windows alone; only for a digest does a conversation's text meet in one row."""
    turns = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0)))
    role = lambda x: unescape(F.replace(F.substring_index(F.substring(x, len(START) + 1, 1 << 30), "\n", 1), F.lit("\\~"), F.lit("\n")))
    text = lambda x: unescape(F.substring(x, F.instr(x, F.lit("\n")) + 1, F.length(x)))
    said = F.transform(turns, lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n")))
    target = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    w = formatted.select("conv_id", "stretch", "window", F.size(said).alias("n"), F.array_join(said, "").alias("said"), F.array_join(target, "").alias("target"), F.length("formatted").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("stretch", "window", "said", "target"))).alias("w"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return g.select("conv_id", "n_turns", F.sha2(joined("said"), 256).alias("turns_sha256"), F.length(joined("target")).cast("bigint").alias("loss_chars"), F.sha2(joined("target"), 256).alias("loss_sha256"), "formatted_chars")
