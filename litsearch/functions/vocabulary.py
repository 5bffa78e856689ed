"""Token counts by a byte-level pair-merge vocabulary.

The index service counts tokens with such a vocabulary. Merging pairs has no
column expression, so the count is an Arrow UDF over whole abstracts, once per
paper when the corpus is prepared; the result is one number a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def token_counter(path: str | None = None, pattern: str | None = None) -> Callable[[str], Column]:
    """A column function: the number of tokens of a text, whole and without special tokens.

    ``path``: a file of base64 tokens and ranks, readable on every executor; ``pattern``: how a
    text is cut before pairs are merged. Null and empty texts have 0 tokens.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("counts", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return lambda text: F.pandas_udf(count, "long")(text)
