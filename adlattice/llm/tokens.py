"""Token counts with a public byte-level BPE vocabulary (never trained, never stored here)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(data: bytes):
    """An encoding from the text of a rank file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ..., tokens)``; NULL text has 0 tokens, texts are read whole.

    The rank file (under 1 MB) is read on the driver and travels to the tasks.
    """
    with open(vocabulary, "rb") as f:
        data = documents.sparkSession.sparkContext.broadcast(f.read())
    kinds = dict(documents.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(data.value)
        for b in batches:
            yield b[["doc_id", *keep]].assign(tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]])

    schema = ", ".join([f"doc_id {kinds['doc_id']}", *[f"{c} {kinds[c]}" for c in keep], "tokens bigint"])
    return documents.select("doc_id", *keep, "text").mapInPandas(work, schema)
