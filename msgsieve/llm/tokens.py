"""Sizes in tokens of a public tokenizer, counted on the executors."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The vocabulary file; its folder is the installed package unless a path is given.
DEFAULT = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = DEFAULT) -> str:
    """A path is taken as it is, a bare name is looked up among the installed public vocabularies."""
    if os.path.sep in name:
        return name
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin) if spec else "/opt/tokenizers", name)


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    # Fixed value: the published split pattern of this vocabulary.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = DEFAULT) -> DataFrame:
    """``keep`` plus (tokens, head_tokens): of the whole text and of its first line. Null texts have 0."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in batches:
            texts = pdf["__text"].fillna("")
            n = [len(enc.encode_ordinary(t)) for t in texts]
            head = [len(enc.encode_ordinary(t.split("\n", 1)[0])) if "\n" in t else 0 for t in texts]
            yield pdf[keep].assign(tokens=n, head_tokens=head)

    types = dict(df.dtypes)
    cols = [F.col(c) for c in keep] + [F.col(text).alias("__text")]
    return df.select(*cols).mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", tokens long, head_tokens long")
