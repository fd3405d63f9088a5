"""How many guesses a password takes: the cheapest segmentation into words, dates, repeats, keyboard walks and brute-force spans.

The cost of a segmentation is the sum of its segments' log2 guesses, plus what naming the segments
in their order costs. A dynamic programme over positions finds the minimum over every segmentation. Repeats and walks may
have any length: their cost grows with the log of it, so of all starts that may end here an earlier one, once it is the
cheaper, stays so, and a stack of starts gives the cheapest in constant time. The time is linear in the length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from functools import lru_cache
from math import log2

#: Words that guessing tries first, in order of frequency.
COMMON_WORDS = (
    "password", "secret", "admin", "token", "qwerty", "letmein", "welcome", "login", "master", "dragon",
    "monkey", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "trustno", "iloveyou",
    "hello", "freedom", "whatever", "michael", "jordan", "hunter", "ranger", "harley", "thomas", "charlie",
    "summer", "winter", "spring", "autumn", "test", "guest", "user", "root", "default", "changeme",
    "example", "sample", "dummy", "public", "private", "system", "server", "service", "database", "backup",
    "google", "access", "demo", "temp", "none", "null", "true", "false", "your", "here",
    "pass", "word", "key", "api", "the", "and", "this", "that", "value", "string",
)
#: Rows of the keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Digits and signs that stand for letters.
LEET = {"4": "a", "@": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
_YEAR, _MONTH, _DAY = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates with what the log2 of their number is.
DATES = [(re.compile(p, re.ASCII), log2(n)) for p, n in ((_YEAR, 120), (rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}", 365 * 120), (rf"{_DAY}([-/._]?){_MONTH}\1{_YEAR}", 365 * 120))]
_LEET = str.maketrans(LEET)
#: Longest unit of a repeat, and least length of a word, a repeat and a walk.
UNIT, LEAST = 8, 3
#: log2 guesses that a further segment costs.
SEGMENT = 1.0


def _beside() -> dict[str, set[str]]:
    at = {c: (x + 0.5 * y, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (u, v) in at.items() if a != b and abs(u - x) <= 1 and abs(v - y) <= 1} for a, (x, y) in at.items()}


_NEAR = _beside()


def _alphabet(s: str) -> float:
    kinds = (any(c.isdigit() for c in s), any(c.islower() for c in s), any(c.isupper() for c in s), any(not c.isalnum() for c in s))
    return log2(max(2, sum(n for n, k in zip((10, 26, 26, 33), kinds) if k)))


class Words:
    """A dictionary, in the order in which guessing tries it."""

    def __init__(self, ordered: Iterable[str]) -> None:
        self.bits: dict[str, float] = {}
        for w in ordered:
            self.bits.setdefault(w, log2(len(self.bits) + 2))
        self.longest = max(map(len, self.bits), default=0)
        self.heads = {w[:LEAST] for w in self.bits}


@lru_cache(2)
def dictionary(ranks: str | None = None) -> Words:
    """COMMON_WORDS, then the words that a public tokenizer's vocabulary holds whole, as often used as its ranks say: some 18,000."""
    if ranks is None:
        import public_tokenizers as public

        ranks = public.path("byte_bpe_50k.tiktoken")
    with open(ranks, "rb") as f:
        tokens = sorted((int(n), base64.b64decode(t)) for t, n in map(bytes.split, f))
    return Words([*COMMON_WORDS, *(t[1:].decode() for _, t in tokens if re.fullmatch(rb" [a-z]{4,}", t))])


class _Starts:
    """Starts k of segments that end at j for value(k) + rate log2(j - k): the cheapest for each j in turn.

    The costs of two starts differ by what rises with j for the later one, so the later is the cheaper up to some end and never again.
    Starts that can be the cheapest yet lie on a stack, the latest on top, each with the end from which the one below is better.
    """

    def __init__(self, rate: float) -> None:
        self.rate, self.stack = rate, []

    def _settle(self, j: int) -> None:
        while len(self.stack) > 1 and self.stack[-1][2] <= j:
            self.stack.pop()

    def add(self, k: int, value: float, j: int) -> None:
        """A start whose first end is j."""
        self._settle(j)
        until = float("inf")
        while self.stack:
            i, other, ends = self.stack[-1]
            q = 2.0 ** min(0.0, (other - value) / self.rate)
            until = (k - q * i) / (1 - q) if q < 1 else float("inf")
            if until <= j:
                return
            if q < 1 and until < ends:
                break
            self.stack.pop()
            until = float("inf")
        self.stack.append((k, value, until))

    def best(self, j: int) -> tuple[int, float]:
        self._settle(j)
        k, value, _ = self.stack[-1]
        return k, value + self.rate * log2(j - k)


_WALKS = (lambda a, b: b in _NEAR.get(a, ()), lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(b) - ord(a) == -1)


def segments(s: str, words: Words | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log2 of the guesses for s and its cheapest segments (kind, start, end)."""
    words = dictionary() if words is None else words
    n, low = len(s), s.lower()
    low = low if len(low) == n else "".join(c.lower()[0] for c in s)
    plain, per, bits = low.translate(_LEET), _alphabet(s), words.bits
    best: list[float] = [0.0] + [float("inf")] * n  # up to here
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, open_ = 0, float("inf")  # where the brute-force span that ends here begins, and its cost
    same = [0] * (UNIT + 1)  # characters up to here that equal the one a unit before, without a break
    repeats: list[list[_Starts] | None] = [None] * (UNIT + 1)
    steps, walks = [0] * len(_WALKS), [_Starts(1.5) for _ in _WALKS]
    fresh = lambda i: best[i] + (SEGMENT if i else 0.0)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if cost < best[j] - 1e-12:
            best[j], back[j] = cost, (kind, i)

    for j in range(n + 1):
        if j:
            for u in range(1, min(UNIT, j - 1) + 1):
                if s[j - 1] != s[j - 1 - u]:
                    same[u], repeats[u] = 0, None
                    continue
                same[u] += 1
                least = max(2 * u, LEAST)
                if same[u] >= least - u:
                    if repeats[u] is None:
                        repeats[u] = [_Starts(1.0) for _ in range(u)]
                    i = j - least
                    repeats[u][i % u].add(i, fresh(i) + u * _alphabet(s[i : i + u]) - log2(u), j)
                    k = repeats[u][j % u]
                    if k.stack:
                        offer("repeat", k.best(j)[0], j, k.best(j)[1])
            for w, near in enumerate(_WALKS):
                if j < 2 or not near(low[j - 2], low[j - 1]):
                    steps[w], walks[w].stack = 0, []
                    continue
                steps[w] += 1
                if steps[w] >= LEAST - 1:
                    walks[w].add(j - LEAST, fresh(j - LEAST) + log2(len(_NEAR)), j)
                    offer("walk", walks[w].best(j)[0], j, walks[w].best(j)[1])
            if fresh(j - 1) < open_:
                open_, brute = fresh(j - 1), j - 1
            open_ += per
            offer("brute", brute, j, open_)
        if plain[j : j + LEAST] in words.heads or low[j : j + LEAST] in words.heads:
            for z in range(j + LEAST, min(n, j + words.longest) + 1):
                for form, extra in ((low[j:z], 0.0), (plain[j:z], 1.0)):
                    if form in bits:
                        part = s[j:z]
                        upper = 0.0 if part.islower() or not part.isalpha() else 1.0 if part.isupper() or part.istitle() else float(z - j)
                        offer("word", j, z, fresh(j) + bits[form] + extra + upper)
                        break
        if j < n and s[j] in "0123":
            for pattern, cost in DATES:
                if m := pattern.match(s, j):
                    offer("date", j, m.end(), fresh(j) + cost)
    found, j = [], n
    while j:
        kind, i = back[j]
        found.append((kind, i, j))
        j = i
    return best[n], found[::-1]
