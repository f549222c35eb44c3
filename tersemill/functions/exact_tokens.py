"""Exact token counts, where a tokenizer file and its library are at hand; else the heuristic count."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import heuristic_tokens

try:
    from tokenizers import Tokenizer
except ImportError:  # optional
    Tokenizer = None


@lru_cache(4)
def load(path: str):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True
    return t


#: Characters encoded at a time, or one text: what the library makes of a token is some hundred bytes.
AT_ONCE = 500_000


def encoded(path: str, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text, as four bytes each."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t or "") > AT_ONCE:
            yield from ids_of(path, some)
            some, held = [], 0
        some.append(t or "")
        held += len(t or "")
    yield from ids_of(path, some)


def ids_of(path: str, texts: list[str]) -> list[np.ndarray]:
    return [np.array(e.ids, dtype=np.int32) for e in load(path).encode_batch(texts, add_special_tokens=False)]


def is_exact(path: str | None) -> bool:
    return bool(path) and Tokenizer is not None


def count_tokens(text: Column, path: str | None = None) -> Column:
    """Tokens of a text; empty and null are 0."""
    if not is_exact(path):
        return heuristic_tokens(text)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([len(ids) for ids in encoded(path, texts)], index=texts.index, dtype="int64")

    return run(text)


word_token_cost = estimate_tokens = count_tokens


def tokenize(text: Column, path: str | None = None) -> Column:
    """Ids (array<int>): none for an empty text, null without a tokenizer."""
    if not is_exact(path):
        return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<int>"))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(index=texts.index, dtype=object)
        for k, ids in enumerate(encoded(path, texts)):
            out.iat[k] = ids
        return out

    return run(text)


def detokenize(ids: Column, path: str | None = None) -> Column:
    """The text of ids; null without a tokenizer."""
    if not is_exact(path):
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else load(path).decode(list(r), skip_special_tokens=False) for r in rows], index=rows.index, dtype=object)

    return run(ids)
