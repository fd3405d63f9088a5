"""A suffix stemmer.

The order of its rules and its measure are those of the reference model, which differs from the textbook in
counting consonant runs by letters; rules are data, applied by one routine.
"""

from __future__ import annotations

import re

# Suffixes and what takes their place; the first that fits decides.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = dict.fromkeys(["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"], "")


class _Kinds(dict):
    """v for vowels, c for all else; y is left to what is before it."""

    def __missing__(self, _: int) -> str:
        return "c"


_KINDS = _Kinds({ord(ch): "v" for ch in "aeiou"} | {ord("y"): "y"})


def shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    kinds = word.translate(_KINDS)
    if "y" not in kinds:
        return kinds
    return "".join(k if k != "y" else "v" if i and kinds[i - 1] != "v" else "c" for i, k in enumerate(kinds))


def measure(word: str) -> int:
    """Consonants between the first and the last vowel."""
    return shape(word).strip("c").count("c")


def short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y; here y is no vowel."""
    return bool(re.search("[^aeiou][aeiou][^aeiouwxy]$", word))


def replaced(word: str, rules: dict[str, str], above: int) -> str:
    if not word.endswith(tuple(rules)):
        return word
    for suffix, by in rules.items():
        if word.endswith(suffix):
            rest = word.removesuffix(suffix)
            return rest + by if measure(rest) > above else word
    return word


def past(word: str) -> str:
    """Takes off eed, ed and ing."""
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    rest = word[:-2] if word.endswith("ed") else word[:-3] if word.endswith("ing") else None
    if rest is None or "v" not in shape(rest):
        return word
    if re.search("(at|bl|iz)$", rest):
        return rest + "e"
    if re.search(r"([^aeioulsz])\1$", rest):
        return rest[:-1]
    return rest + "e" if measure(rest) == 1 and short_end(rest) else rest


_PLURAL = re.compile("(ss)es$|(i)es$|(ss)$|s$")


def stem(word: str) -> str:
    """The stem of a word; one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _PLURAL.sub(lambda m: m[1] or m[2] or m[3] or "", word.lower())
    w = past(w)
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    w = replaced(replaced(replaced(w, STEP2, 0), STEP3, 0), STEP4, 1)
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or (m == 1 and not short_end(w[:-1])):
            return w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w
