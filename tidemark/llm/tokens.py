"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import fresh

#: Byte-level BPE ranks; the file is read where it lies, on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizing pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _counter(path: str, pattern: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pd.Series([0 if t is None else len(encode(t)) for t in texts], dtype="int64")

    return run


def token_sizes(df: DataFrame, text: str, out: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``df`` with the number of tokens of the whole ``text``; null and blank texts have 0.

    A column of ``df`` named like ``out`` is kept, the new one is then lengthened by ``_``.
    """
    count = F.pandas_udf(_counter(vocabulary, pattern), "bigint")
    c = F.col(f"`{text}`")
    return df.withColumn(fresh(out, df.columns), count(F.when(c.rlike("\\S"), c)))
