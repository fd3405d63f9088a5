import random
import sys
from unicodedata import category

import public_tokenizers as public
import pytest
import regex
from tokenizers import Tokenizer

from corvane.llm import token_counts as t
from llm import cases

LIBRARY = Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return t.Counter(public.path("byte_bpe_50k.json"))


PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "é", "漢", "🙂", "1", "٣", ".", "<|endoftext|>", "՘", "\U00031350", "\x1c", "\xa0", "̀", "‍", "\t", "A", "'", "the", " the"]


def test_random_texts(counter):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([1, 3, 10, 60, 400]))) for _ in range(1500)]
    assert counter.counts(texts).tolist() == library(texts)


def test_runs_and_long_pieces(counter):
    rnd = random.Random(2)
    texts = ["a" * k for k in range(1, 200)] + ["ab" * k for k in range(1, 200, 7)] + ["=" * k for k in range(1, 400, 13)]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(k)) for k in range(60, 3000, 37)] + ["".join(rnd.choice("acgtäß漢") for _ in range(5000))]
    assert counter.counts(texts).tolist() == library(texts)


@pytest.mark.parametrize("seed", range(3))
def test_made_up_merges(seed, monkeypatch):
    """Rounds over ragged arrays and buckets, against the plain rule: the leftmost pair of the lowest rank, again and again. Ranks need not grow."""
    rnd = random.Random(seed)
    letters = t.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    merges, words = [], list("abcd")
    while len(merges) < 40:
        pair = rnd.choice(words), rnd.choice(words)
        if "".join(pair) not in vocab:
            vocab["".join(pair)] = len(vocab)
            merges.append(pair)
            words.append("".join(pair))
    rank = {p: r for r, p in enumerate(merges)}

    def plain(text):
        s = list(text)
        while pairs := [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]:
            _, i = min(pairs)
            s[i : i + 2] = [s[i] + s[i + 1]]
        return len(s)

    texts = ["".join(rnd.choice("aabcd") for _ in range(rnd.randrange(1, 60))) for _ in range(600)]
    for short in (64, 0):
        monkeypatch.setattr(t, "SHORT", short)
        assert t.Merges(vocab, merges).counts([x.encode() for x in texts]).tolist() == list(map(plain, texts))


def test_settled_letters_are_of_the_librarys_classes(counter):
    """Every code point that this Python knows splits alike in both; the others go to the library."""
    pattern, split = regex.compile(public.PATTERN), LIBRARY.pre_tokenizer.pre_tokenize_str
    known = [c for c in map(chr, range(sys.maxunicode + 1)) if category(c) not in ("Cn", "Cs")]
    known = [c for c in known if category(c) not in ("Co", "Lo") or ord(c) < 0x3400 or ord(c) % 16 == 0]
    for at in range(0, len(known), 500):
        text = "".join(f"a{c}a1{c}1.{c}." for c in known[at : at + 500])
        assert pattern.findall(text) == [text[a:z] for _, (a, z) in split(text)]


def test_blocks(counter, monkeypatch):
    texts = ["one two  three\nfour <|endoftext|> five's " * 50, "", "<|endoftext|>"]
    monkeypatch.setattr(t, "BLOCK", 20)
    monkeypatch.setattr(t, "KNOWN", 3)
    assert counter.counts(texts).tolist() == library(texts)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    n = library(r.text or "" for r in rows)
    expected = sorted((r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n))
    assert sorted(map(tuple, t.token_counts(docs).collect())) == expected


def test_odd_tables(spark):
    docs = cases.odd(spark)
    rows = docs.collect()
    n = library(r.text or "" for r in rows)
    expected = sorted(((r.doc_id, len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n)), key=repr)
    assert sorted(map(tuple, t.token_counts(docs).collect()), key=repr) == expected
    assert t.token_counts(cases.none(spark)).collect() == []
