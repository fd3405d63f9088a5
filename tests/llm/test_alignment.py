import random
from collections import Counter
from hashlib import sha256

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment
from llm import cases

A = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def known():
    return alignment.Aligned(alignment.Tokens("byte_bpe_50k.json", "piece_bpe_32k.model"))


def whole(text, tokens):
    """Groups as lists of ids and all links, from both libraries' tokens of the whole text and plain loops."""
    if not text:
        return [], []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes, b_bytes = [tokens.a_bytes[i] for i in a], [tokens.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], []
    spans = []
    for parts in (a_bytes, b_bytes):
        at, out = 0, []
        for p in parts:
            out.append((at, at := at + len(p)))
        spans.append(out)
    ends = sorted({z for _, z in spans[0]} & {z for _, z in spans[1]})
    groups, links, start, i, j = [], [], 0, 0, 0
    for end in ends:
        mine = [k for k in range(i, len(a)) if start <= spans[0][k][0] < end] if end - start > 0 else []
        theirs = []
        while j < len(b) and spans[1][j][0] < end:
            theirs.append(j)
            j += 1
        i = mine[-1] + 1
        groups.append(([a[k] for k in mine], [b[k] for k in theirs]))
        links += [(a[x], b[y]) for x in mine for y in theirs if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
        start = end
    return groups, links


def told(groups):
    return sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups).encode()).hexdigest() if groups else ""


def rows_by_loops(docs, tokens):
    each = [(i, *whole(t, tokens)) for i, t in docs]
    count = Counter(link for _, _, links in each for link in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, groups, links in each:
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((i, n_a, n_b, len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), told(groups)))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


PARTS = ["a", "b", " ", "  ", "\n", "\t", "\r", "'s", "é", "漢", "🙂", "1", ".", "<|endoftext|>", "<s>", "\x1c", "▁", "\xa0", "A", "'", "the", " the", ";", "<0x41>", "　", "\x85", "\0"]


def test_chunks_are_tokenized_as_whole_texts(known):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.choice([1, 3, 10, 60]))) for _ in range(1500)]
    texts += ["".join(rnd.choice(PARTS[:5] + PARTS[7:14]) for _ in range(40)) for _ in range(500)] + ["", " ", "\n", "a ", "▁"]
    for text, got in zip(texts, known.documents(texts), strict=True):
        groups, links = whole(text, known.tokens)
        assert (got.n_groups, got.n_links, got.groups_sha256) == (len(groups), len(links), told(groups)), text
        pairs = Counter(a * len(known.tokens.b_bytes) + b for a, b in links)
        assert {k >> 32: k & 0xFFFFFFFF for k in got.links.tolist()} == pairs


def test_long_texts_go_by_blocks(known, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["word ", "other\n", " more  ", "漢字"]) for _ in range(900))
    one = next(known.documents([text]))
    monkeypatch.setattr(alignment, "BLOCK", 50)
    monkeypatch.setattr(alignment, "KNOWN", 0)
    again = next(alignment.Aligned(known.tokens).documents([text]))
    assert again[:5] == one[:5] and (again.links == one.links).all()


@pytest.mark.parametrize("head", [1, 40, alignment.HEAD])
def test_whole_table_equals_loops(head, spark, sf_dir, known):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    assert result(alignment.alignments(docs, head=head)) == rows_by_loops([(r.doc_id, r.text) for r in docs.collect()], known.tokens)


def test_odd_tables(spark, known):
    docs = cases.odd(spark).where("length(coalesce(text, '')) < 5000")
    assert result(alignment.alignments(docs, head=3)) == rows_by_loops([(r.doc_id, r.text) for r in docs.collect()], known.tokens)
    assert alignment.alignments(cases.none(spark)).collect() == []
