import hashlib
import random
import re
import time

import oracle
import pytest

from corvane.llm.guesses import SEGMENT, Words, _alphabet, dictionary, segments
from corvane.llm.secrets import base_spans, guess_spans, joined, scan
from llm import cases


def test_base_patterns():
    text = 'password: token: abcdefghijk API_KEY = "abcd1234" Secret=short AKIAABCDEFGHIJKL AKIA12 ' + "f" * 31 + " " + "0a" * 16
    kinds = [(k, text[a:b]) for k, a, b in sorted(base_spans(text), key=lambda x: x[1])]
    assert kinds == [("assign", 'API_KEY = "abcd1234'), ("access", "AKIAABCDEFGHIJKL"), ("hex", "0a" * 16)]


def test_case_is_ascii_only():
    assert base_spans("to\u212aen=abcdefghijk") == []
    assert base_spans("toKEN=abcdefghijk") == [("assign", 0, 17)]


@pytest.mark.parametrize(
    ("value", "kind"),
    [("password", "word"), ("qwertyuiop", "walk"), ("abcabcabcabc", "repeat"), ("1999-12-03", "date"), ("aaaaaaaaaa", "repeat")],
)
def test_weak_values_are_cheap(value, kind):
    cost, found = segments(value)
    assert cost < 25 and found[0][0] == kind
    assert guess_spans(f"passphrase: {value}") == []


@pytest.mark.parametrize("name", ["dbPassword", "clientSecret", "userPassword", "app.dbPassword", "my_long-serviceToken", "x" * 200 + "Secret", "password", "db_password"])
def test_names_that_end_in_a_keyword(name):
    value = "x9$Kq!v2@Lm"
    for text in (f'{name} = "{value}"', f"{name}: '{value}'", f"{name}={value} end"):
        assert [text[a:b] for _, a, b, _ in guess_spans(text)] == [value]


def test_an_easy_value_may_be_a_name():
    text = 'bypass: secret = "x9$Kq!v2@Lm" compass: north ' + "token:" * 20000
    assert [text[a:b] for _, a, b, _ in guess_spans(text)][:1] == ["x9$Kq!v2@Lm"]


def test_segments_cover_the_value_and_cost_no_more_than_brute_force():
    for value in ("x7$Kq9!zL2mP", "p@ssw0rd2020zz", "correct-horse-1987", "a", "ab" * 500):
        cost, found = segments(value)
        assert [f[1] for f in found] == [0, *[f[2] for f in found[:-1]]] and found[-1][2] == len(value)
        assert 0 <= cost <= len(value) * 6.6


def brute(s, words):
    """Least cost over all segmentations into words, dates, repeats, walks and brute-force spans: every span of every kind is tried."""
    from functools import lru_cache
    from math import log2

    per, low = _alphabet(s), s.lower()
    rank = {w: log2(k + 2) for k, w in enumerate(words)}
    leet = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
    rows = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
    place = {c: (x + y / 2, y) for y, r in enumerate(rows) for x, c in enumerate(r)}

    def near(a, b):
        if a == b or a not in place or b not in place:
            return False
        return abs(place[a][0] - place[b][0]) <= 1 and abs(place[a][1] - place[b][1]) <= 1

    def costs(i, j):
        part, n = s[i:j], j - i
        if n >= 3:
            forms = [(low[i:j], 0), ("".join(leet.get(c, c) for c in low[i:j]), 1)]
            for form, extra in forms:
                if form in rank:
                    yield rank[form] + extra + (0 if part.islower() or not part.isalpha() else 1 if part.isupper() or part.istitle() else n)
                    break
            steps = list(zip(low[i:j], low[i + 1 : j]))
            if all(near(a, b) for a, b in steps) or all(ord(b) - ord(a) == 1 for a, b in steps) or all(ord(a) - ord(b) == 1 for a, b in steps):
                yield log2(len(place)) + 1.5 * log2(n)
            for u in range(1, 9):
                if n % u == 0 and n // u >= 2 and part == part[:u] * (n // u):
                    yield u * _alphabet(part[:u]) + log2(n // u)
        if re.fullmatch(r"(19|20)[0-9]{2}", part):
            yield log2(120)
        for sign in ("", "-", "/", ".", "_"):
            d, m, y = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])", "(19|20)[0-9]{2}"
            x = re.escape(sign)
            if re.fullmatch(f"{y}{x}{m}{x}{d}|{d}{x}{m}{x}{y}", part):
                yield log2(365 * 120)

    @lru_cache(None)
    def best(i, opened):
        if i == len(s):
            return 0.0
        more = SEGMENT if i else 0
        out = per + (0 if opened else more) + best(i + 1, True)
        for j in range(i + 1, len(s) + 1):
            for c in costs(i, j):
                out = min(out, c + more + best(j, False))
        return out

    return best(0, False)


WORDS = ("fob", "obarq", "rqux", "password", "admin", "secret", "token", "pas", "asd")


@pytest.mark.parametrize("value", ["fobxobarqux", "zfobz", "kkfobobarqk", "ppppassword", "aaaadmin", "ssssecret", "ttttoken2020", "20201231", "qwertypassword", "asdfpasdf", "abcabcabcab", "P4ssw0rdabcdcba", "2020-01-012020", "ababababpassword", "zzzzzzz1999"])
def test_minimum_equals_brute_force(value):
    assert abs(segments(value, Words(WORDS))[0] - brute(value, WORDS)) < 1e-9


def test_minimum_of_random_values_equals_brute_force():
    rng = random.Random(11)
    parts = ["a", "b", "aa", "qwe", "asd", "pas", "1", "2020", "01", "12", "abc", "fob", "cba", "-", "password", "aaaa", "xyz", "Q"]
    for _ in range(250):
        value = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))[:24]
        assert abs(segments(value, Words(WORDS))[0] - brute(value, WORDS)) < 1e-9, value


def test_known_minima_and_long_values():
    assert abs(segments("ppppassword")[0] - 8.2854) < 1e-3
    assert segments("correcthorsebatterystaple")[0] < 65 and {k for k, _, _ in segments("correcthorsebatterystaple")[1]} == {"word"}
    assert len(dictionary().bits) > 10000
    began = time.time()
    for value in ("a" * 50000, "ab" * 25000, "qwertyuiop" * 5000, "a" * 20000 + "b" * 20000):
        segments(value)
    assert time.time() - began < 30


def test_whole_query_equals_sql_and_brute_force(spark, sf_dir):
    """Base columns as DuckDB counts them; spans of hard values by the plain search over all segmentations."""
    q = """SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(?:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM documents"""
    con = oracle.connect(sf_dir)
    con.execute("CREATE VIEW planted AS SELECT doc_id, text || ' clientSecret: \"' || substr(sha256(text), 1, CAST(doc_id % 14 AS INT)) || '\" token=' || text AS text FROM documents")
    want = {r[0]: r[1:] for r in con.execute(q.replace("documents", "planted")).fetchall()}
    docs = dict(con.execute("SELECT doc_id, text FROM planted").fetchall())
    ordered, seen = tuple(dictionary().bits), [0, 0]
    for r in scan(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect():
        assert (r.n_assign, r.n_access, r.n_hex) == want[r.doc_id]
        hard = {(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "guess"}
        m = re.search(r'clientSecret: "([0-9a-f]*)" token=', docs[r.doc_id])
        assert ((m.start(1), m.end(1)) in hard) == (m[1] != "" and brute(m[1], ordered) >= 40)
        seen[(m.start(1), m.end(1)) in hard] += 1
    assert min(seen) > 20


def test_hard_values_in_context():
    text = 'login: x\npwd = "x7$Kq9!zL2mP" and postgres://me:q8Zt_Lw4vX9r@db/x Authorization: Bearer 9fQ2xL7vTzR4'
    assert [text[a:b] for _, a, b, _ in guess_spans(text)] == ["x7$Kq9!zL2mP", "q8Zt_Lw4vX9r", "9fQ2xL7vTzR4"]
    assert guess_spans("x7$Kq9!zL2mP without any context") == []


def test_rows(spark):
    rows = scan(cases.odd(spark)).collect()
    assert len(rows) == len(cases.rows()) and all(r.spans == "" and r.n_assign == 0 for r in rows)
    d = spark.createDataFrame([(1, "token=abcdefgh1 " + "ab" * 20), (2, None)], "doc_id bigint, text string")
    a, b = scan(d).orderBy("doc_id").collect()
    base = "assign:0:15,hex:16:56"
    assert (a.n_assign, a.n_access, a.n_hex, a.base_sha256) == (1, 0, 1, hashlib.sha256(base.encode()).hexdigest())
    assert re.fullmatch(r"assign:0:15,(guess:6:15,)?hex:16:56", a.spans)
    assert b.base_sha256 == hashlib.sha256(b"").hexdigest() and joined([]) == ""


def test_empty_table(spark):
    assert scan(cases.none(spark)).count() == 0
