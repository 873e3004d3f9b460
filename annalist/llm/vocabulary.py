"""Public tokenizers. A file is read once, on the driver, and reaches the executors as a broadcast of a few MB."""

from __future__ import annotations

import base64
import functools
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
#: Vocabulary files of a larger size are refused, as they are broadcast.
MAX_BYTES = 64 << 20
# Fixed value: the pattern that cuts a text to pre-tokens in byte-level vocabularies of this family.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def share(spark: SparkSession, name: str, folder: str = FOLDER) -> Broadcast:
    data = Path(folder, name).read_bytes()
    if len(data) > MAX_BYTES:
        raise ValueError(f"{name}: {len(data)} bytes is too much for a vocabulary")
    return spark.sparkContext.broadcast(data)


@functools.lru_cache(maxsize=2)
def ranks_encoder(data: bytes):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
