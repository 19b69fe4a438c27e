"""Token counts and truncation by a tokenizer file, loaded once in each Python worker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import kind


def _loader(path: str):
    """A function that gives the tokenizer of a `tokenizers` JSON file; its text travels with the task."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    held: list = []

    def load():
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_str(text))
        return held[0]

    return load


def counter(path: str):
    """A function of a text column: its tokens; a missing or empty text has none."""
    load = _loader(path)

    @F.pandas_udf(kind("int"))
    def count(texts: pd.Series) -> pd.Series:
        encoded = load().encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([len(e.ids) for e in encoded], dtype="int32")

    return lambda text: count(text)


def truncator(path: str):
    """A function of a text column and a number of tokens: a longer text's first ones with an ellipsis; null for an empty text or no room."""
    load = _loader(path)

    @F.pandas_udf(kind("string"))
    def cut(texts: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for text, n in zip(texts, most, strict=True):
            if not text or n <= 0:
                out.append(None)
                continue
            ids = load().encode(text, add_special_tokens=False).ids
            out.append(text if len(ids) <= n else load().decode(ids[:n]).rstrip() + "...")
        return pd.Series(out, dtype="object")

    return lambda text, most: cut(text, F.lit(most) if not isinstance(most, Column) else most)
