import math

import pytest

from corvane.functions.words import DECISION_SENTENCES, OTHER_SENTENCES
from corvane.operators import intent as I


def plain(text):
    """(positive, negative) by loops over all references."""
    c = I.stems(text)
    out = []
    for refs in (DECISION_SENTENCES, OTHER_SENTENCES):
        cos = []
        for r in map(I.stems, refs):
            both = math.sqrt(sum(n * n for n in c.values()) * sum(n * n for n in r.values()))
            cos.append(sum(n * r[t] for t, n in c.items()) / both if both else 0.0)
        out.append(sum(sorted(cos)[-3:]) / 3)
    return out


@pytest.mark.parametrize("text", ["Use PostgreSQL for the database", "Fix this bug now", "", None, "zzz", "we use we use React", "Deploy to AWS ECS, looks good"])
def test_scores_are_those_of_plain_loops(text):
    p, n, conf = I.References().scores([text])[0]
    want = plain(text)
    assert [p, n] == pytest.approx(want, abs=1e-8)
    assert conf == pytest.approx(abs(want[0] - want[1]) / sum(want) if sum(want) else 0.0, abs=1e-6)


def test_references_classify_themselves():
    r = I.References()
    s = r.scores(DECISION_SENTENCES + OTHER_SENTENCES)
    right = (s[:, 0] > s[:, 1]) == ([True] * len(DECISION_SENTENCES) + [False] * len(OTHER_SENTENCES))
    assert right.mean() > 0.9


MESSAGES = [
    (1, "We use PostgreSQL for the database. Use dark theme. Call it Hive! Deploy to AWS ECS. Perfect"),
    (2, "What is the database that we use"),
    (3, "Fix this bug. We use React for the frontend."),
    (4, "Use tabs"),
    (5, "Name it X. Y"),
    (6, None),
    (7, ""),
    (None, "  We use a monorepo structure\n"),
    (None, "  We use a monorepo structure\n"),
    (8, "We use React for the frontend. " * 20_000),
]


def test_messages_give_their_first_decisions(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in MESSAGES], "id bigint, text string, _text string")
    got = sorted(((r.id, r.place, r.decision) for r in I.captured(d, ["id"]).collect()), key=repr)
    assert [g for g in got if g[0] == 1] == [(1, 1, "We use PostgreSQL for the database"), (1, 2, "Use dark theme"), (1, 3, "Call it Hive")] or len([g for g in got if g[0] == 1]) == 3
    assert [g for g in got if g[0] is None] == [(None, 1, "We use a monorepo structure")] * 2
    assert [g[1] for g in got if g[0] == 8] == [1, 2, 3]
    assert {g[0] for g in got} <= {1, 5, 8, None}
    assert I.captured(d.limit(0), ["id"]).count() == 0
