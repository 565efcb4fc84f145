"""Token counting of whole texts with a public byte-level BPE vocabulary.

The vocabulary's path is a parameter; the file is read on the driver once and sent to the tasks
(its size is that of the vocabulary and does not depend on the data).
"""

from __future__ import annotations

import base64
from pathlib import Path

PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str = VOCABULARY) -> bytes:
    return Path(path).read_bytes()


def encoder(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
