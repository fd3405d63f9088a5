"""An embedder that needs no model: hashed stems as unit vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .search import _stem as stem

SIZE = 384


def vector(text: str | None, size: int = SIZE) -> np.ndarray:
    """Signed counts of hashed stems with unit length; zeros for a text without tokens."""
    v = np.zeros(size, np.float32)
    for t in re.findall("[a-z0-9]+", (text or "").lower().replace("_", " ")):
        h = zlib.crc32(stem(t).encode())
        v[h % size] += 1.0 if h >> 31 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embedded(df: DataFrame, text_col: str = "content", size: int = SIZE) -> DataFrame:
    """Adds vec to every row, by Arrow batches."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(vec=[vector(t, size) for t in b[text_col]])

    return df.mapInPandas(add, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, vec array<float>")
