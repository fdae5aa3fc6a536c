"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Vocabulary file of the tokenizer, as ranks.
VOCABULARY = os.environ.get("STATUTA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``tokens`` (BIGINT), the length of the whole ``text``; null and empty texts have none.

    One pass without a shuffle; the text itself goes no further.
    """
    source = df.select(*keep, df[text].alias("__text"))
    schema = T.StructType([*[T.StructField(source.schema[c].name, source.schema[c].dataType, True) for c in keep], T.StructField("tokens", T.LongType())])

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            yield b.assign(tokens=[len(encode(t)) if isinstance(t, str) and t else 0 for t in b["__text"]])[[*keep, "tokens"]]

    return source.mapInPandas(kernel, schema)
