"""Token counts with a public byte-pair vocabulary. The vocabulary file is a parameter and is read where the tokens are counted."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.session import spread

#: a file of ranks in tiktoken's format
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: fixed value: the pre-tokenizer pattern that the vocabulary was made with
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(vocabulary: str, keys: list[str], terms: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            counts, ids, tfs = [], [], []
            for text in b.column("text").to_pylist():
                got = encode(text) if text else []
                counts.append(len(got))
                if terms:
                    u, n = np.unique(np.array(got, dtype=np.int32), return_counts=True)
                    ids.append(u.tobytes())
                    tfs.append(n.astype(np.int32).tobytes())
            cols, names = [b.column(k) for k in keys] + [pa.array(counts, pa.int32())], [*keys, "n_tokens"]
            if terms:
                cols += [pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())]
                names += ["terms", "tfs"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def token_counts(docs: DataFrame, keys: list[str], vocabulary: str = VOCABULARY, terms: bool = False) -> DataFrame:
    """keys and n_tokens of every row of docs(keys, text), whole texts; a null text has no tokens. terms: also the distinct token
    ids and how often each occurs (int32)."""
    df = spread(docs.select(*keys, "text"))
    schema = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in keys) + ", n_tokens int" + (", terms binary, tfs binary" if terms else "")
    return df.mapInArrow(_count(vocabulary, keys, terms), schema)
