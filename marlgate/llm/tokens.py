"""Sizes of texts in tokens of a public byte-level BPE, and a quality weight of each text.

Defined results. A null or empty text has no tokens. Whole texts are measured. The vocabulary's path is a parameter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are split before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = re.compile(r"[^\W\d_]{2,}")


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    """The tokenizer, once in a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def quality(text: str) -> float:
    """Share of the characters that belong to words, at least 0.05: encoded attachments and tables weigh less."""
    return max(0.05, min(1.0, sum(map(len, WORDS.findall(text))) / max(1, len(text))))


def token_sizes(documents: DataFrame, path: str = VOCABULARY, weigh: bool = False) -> DataFrame:
    """doc_id, source, n_tokens and weight (1.0 unless ``weigh``)."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = encoding(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "source": batch["source"], "n_tokens": [len(tokens.encode_ordinary(t)) for t in texts],
                "weight": [quality(t) if weigh else 1.0 for t in texts],
            })

    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string").alias("source")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"), "text").mapInPandas(
        measure, "doc_id bigint, source string, n_tokens bigint, weight double"
    )
