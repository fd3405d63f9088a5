import random

from corvane.operators import compress as K
from corvane.operators import resolve as R


def test_imports_stand_for_files(spark):
    files = ["foo/bar.py", "pkg/__init__.py", "web/utils.ts", "web/app/main.ts", "web/app/side.js", "svc/src/main/java/com/acme/Pay.java", "svc/src/main/java/com/acme/Bill.java", "a/index.ts"]
    imports = [
        ("x.py", "from foo.bar import baz", "foo/bar.py"), ("x.py", "import pkg", "pkg/__init__.py"), ("web/app/main.ts", "'../utils';", "web/utils.ts"), ("web/app/main.ts", "./side", "web/app/side.js"),
        ("web/app/main.ts", "side", "web/app/side.js"), ("svc/src/main/java/com/acme/Pay.java", "import com.acme.Bill;", "svc/src/main/java/com/acme/Bill.java"), ("x.java", "import com.acme.*", None),
        ("x.py", "import com.acme.Bill", None), ("x.ts", "import a", "a/index.ts"), ("foo/bar.py", "import foo.bar", None), ("x.py", "import nothing", None),
    ]
    d = spark.createDataFrame([(f, i) for f, i, _ in imports], "file string, import string")
    got = {(r.file, r["import"]): r.target for r in R.import_targets(d, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert got == {(f, i): t for f, i, t in imports if t}


def test_calls_between_files(spark):
    symbols = [("a.py", "Alpha", "Class", 0), ("a.py", "run", "Method", 1), ("b.py", "Beta", "Class", 0), ("b.py", "run", "Method", 1), ("b.py", "helper", "Function", 2), ("c.py", "solo", "Function", 0), ("d.py", "Delta", "Class", 0), ("b.py", "go", "Function", 3)]
    d = spark.createDataFrame(symbols, "file string, symbol string, label string, place int")
    imports = spark.createDataFrame([("a.py", "b.py")], "file string, target string")
    sources = spark.createDataFrame([("a.py", "x = unsolo(DeltaMaker)"), ("c.py", "helper()")], "file string, text string")
    invoked = spark.createDataFrame([("a.py", "Alpha", "Delta"), ("d.py", "Delta", "Delta")], "file string, caller string, type string")
    calls = R.calls_between(d, imports, sources, invoked)
    got = {(r.src, r.dst): (r.confidence, r.reason) for r in calls.collect()}
    assert got == {
        ("a.py:Alpha", "b.py:Beta"): (0.9, "import-resolved"), ("a.py:Alpha", "b.py:helper"): (0.9, "import-resolved"),
        ("a.py:Alpha", "c.py:solo"): (0.5, "global"), ("a.py:Alpha", "d.py:Delta"): (0.85, "java-invocation"),
    }
    nodes = spark.createDataFrame([(f"{f}:{s}", label) for f, s, label, _ in symbols], "id string, label string")
    assert {(r.dst, r.relation) for r in R.split_calls(calls, nodes).collect()} == {("b.py:Beta", "CLASS_DEPENDS"), ("d.py:Delta", "CLASS_DEPENDS")}


def test_contained_symbols_equal_plain_search(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab_1 .") for _ in range(40)) for _ in range(60)] + [None, ""]
    symbols = {"".join(rng.choice("ab_1") for _ in range(rng.randint(2, 5))) for _ in range(40)}
    d, s = spark.createDataFrame(list(enumerate(texts)), "id int, text string"), spark.createDataFrame([(x,) for x in symbols], "symbol string")
    want = {(i, x) for i, t in enumerate(texts) for x in symbols if len(x) >= 3 and x in (t or "")}
    assert {(r.id, r.symbol) for r in R.contained(d, s, "id", "text").collect()} == want and want


def test_modularity_of_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (range(4), range(10, 14)) for a in g for b in g if a < b] + [(0, 10, 1.0)]
    members = [(i, i // 10) for i in (*range(4), *range(10, 14))]
    q = R.modularity(spark.createDataFrame(pairs, "src long, dst long, weight double"), spark.createDataFrame(members, "node long, community long")).first()[0]
    assert abs(q - (12 / 13 - 2 * 13 * 13 / (4 * 13 * 13))) < 1e-9


def plain_fold(rows):
    """Every text against all that is kept, every kept one against all leaders."""
    kept, clusters = [], []
    for i, text in rows:
        words = set(text.lower().split())
        for k in kept:
            if K.jaccard(words, k["words"]) > K.MERGE:
                k["ids"].append(i)
                k["text"] = f"{k['text']} | {text}"[: K.LONGEST]
                break
        else:
            kept.append({"ids": [i], "text": text, "words": words})
    for k in kept:
        count = K.Counter(k["text"].lower().split())
        home = next((c for c in clusters if K.containment(count, c[0]) >= K.CLUSTER), None)
        if home:
            home[1].extend(k["ids"])
        else:
            clusters.append((count, list(k["ids"])))
    return [sorted(ids) for _, ids in clusters]


def test_fold_equals_plain_fold():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(15)], k=rng.randint(0, 9)))) for i in range(250)]
    assert [g["ids"] for g in K.fold(rows)] == plain_fold(rows)


def test_symbols_of_any_signs_and_number(spark):
    """Against plain search: one pass and several, a long run, repeated and odd symbols."""
    from corvane.operators.automaton import symbols_in

    texts = [(1, "ab abc abcd"), (2, "a.b é漢\n漢字"), (3, ""), (4, None), (5, "x" * 300_000 + "needle" + "y" * 700_000), (5, "again ab")]
    names = ["ab", "abc", "b", "a.b", "漢", "é漢", "needle", "xn", "none", "", None, "ab", "\n漢", "xxy"]
    t = spark.createDataFrame(texts, "id long, text string")
    s = spark.createDataFrame([(n,) for n in names], "symbol string")
    want = sorted((i, sorted({n for n in names if n and n in x})) for i, x in texts if x is not None)
    assert sorted((r.id, r.symbols) for r in symbols_in(t, s, "id", "text").collect()) == want
    split = {}
    for r in symbols_in(t.where("id <> 5"), s, "id", "text", room=5).collect():
        split.setdefault(r.id, set()).update(r.symbols)
    assert split == {i: set(x) for i, x in want if i != 5}
    assert [r.symbols for r in symbols_in(t.where("id = 1"), s.limit(0), "id", "text").collect()] == [[]]
