"""Which messages state decisions, and the sentences that do: cosines of stem counts with reference sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import DECISION_SENTENCES, INSTRUCTION_STARTS, OTHER_SENTENCES, QUESTION_STARTS
from .search import _stem as stem

#: Sentences of a matrix product.
BLOCK = 4096


def stems(text: str | None) -> Counter:
    return Counter(map(stem, re.findall("[a-z0-9]+", (text or "").lower().replace("_", " "))))


class References:
    """Unit vectors of reference sentences over their own stems. Stems of a text that no reference has count in its length alone."""

    def __init__(self, positive: list[str] = DECISION_SENTENCES, negative: list[str] = OTHER_SENTENCES, nearest: int = 3):
        counts = [stems(t) for t in [*positive, *negative]]
        self.at = {s: i for i, s in enumerate(sorted({s for c in counts for s in c}))}
        self.split, self.nearest = len(positive), nearest
        self.vectors = self._rows(counts)

    def _rows(self, counts: list[Counter]) -> np.ndarray:
        x = np.zeros((len(counts), len(self.at)))
        for row, c in zip(x, counts):
            for s, n in c.items():
                if s in self.at:
                    row[self.at[s]] = n
            row /= max(1.0, sum(n * n for n in c.values()) ** 0.5)
        return x

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(positive, negative, confidence) a text: the mean of the nearest references' cosines of either kind, and their distance over their sum."""
        out = []
        for lo in range(0, len(texts), BLOCK):
            cos = np.round(self._rows([stems(t) for t in texts[lo : lo + BLOCK]]) @ self.vectors.T, 9)
            p, n = (np.round(np.sort(c, axis=1)[:, -self.nearest :].sum(axis=1) / self.nearest, 9) for c in (cos[:, : self.split], cos[:, self.split :]))
            both = p + n
            out.append(np.stack([p, n, np.divide(np.abs(p - n), both, out=np.zeros_like(both), where=both > 0)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def sentences(text: Column) -> Column:
    """Sentences of more than ten characters, in order; the whole text if it has none."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]", -1), trimmed), lambda s: F.length(s) > 10)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def open_messages(messages: DataFrame, text_col: str) -> DataFrame:
    """Messages of ten characters or more that begin as neither a question nor an instruction, trimmed."""
    m = messages.withColumn(text_col, trimmed(F.col(text_col)))
    return m.where((F.length(text_col) >= 10) & ~F.lower(text_col).rlike(f"^({'|'.join(QUESTION_STARTS + INSTRUCTION_STARTS)}) "))


def captured(messages: DataFrame, keys: list[str], text_col: str = "text", threshold: float = 0.25, most: int = 3, references: References | None = None) -> DataFrame:
    """(keys, place, decision, confidence): the first `most` sentences of each message, in order from 1, that state a decision with a confidence above the threshold.

    A message is one only if it states a decision as a whole. Null, empty and short messages give no rows; rows that repeat give theirs each. A message is read where
    it lies, there is no shuffle; the limit is the feature.
    """
    refs = references or References()
    m = open_messages(messages, text_col).select(*keys, F.col(text_col).alias("_text"), sentences(F.col(text_col)).alias("_parts"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.schema.fields[: len(keys)])

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole = refs.scores(b["_text"].tolist())
            b = b[whole[:, 0] > whole[:, 1]]
            p = b[[*keys, "_parts"]].explode("_parts").rename(columns={"_parts": "decision"})
            s = refs.scores(p["decision"].tolist())
            p["place"], p["confidence"] = p.groupby(level=0).cumcount() + 1, s[:, 2]
            p = p[(s[:, 0] > s[:, 1]) & (s[:, 2] > threshold)]
            yield p.groupby(level=0).head(most)[[*keys, "place", "decision", "confidence"]]

    return m.mapInPandas(pick, f"{types}, place bigint, decision string, confidence double")
