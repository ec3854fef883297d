"""A public sub-word tokenizer, loaded once per Python process."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Where the test machine keeps the rank file of a byte-level vocabulary; give another with ``ranks``.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that goes with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS, pattern: str = PATTERN):
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """``df`` with the number of tokens of ``text`` instead of the text itself; 0 for null."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(ranks).encode_ordinary
        for batch in batches:
            found = batch[kept].copy()
            found[out] = [len(encode(t)) if t else 0 for t in batch[text]]
            yield found

    return df.select(*(f"`{c}`" for c in kept), f"`{text}`").mapInPandas(count, f"{schema}, `{out}` long")
