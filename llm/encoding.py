"""Token ids of a public byte-level BPE vocabulary, given by path."""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Longest run of white space that the splitting pattern is tried on.
LONGEST_BLANK = 100_000
_BLANKS = re.compile(r"\s{%d}" % LONGEST_BLANK)


@dataclass(frozen=True)
class Encoder:
    """The vocabulary in two libraries: the faster one, and the one that takes every text."""

    fast: tiktoken.Encoding
    every: Tokenizer


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str, added: str) -> Encoder:
    """The vocabulary of a rank file with the added tokens of the ``tokenizers`` file ``added``."""
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(added, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{added}: added tokens that depend on what stands beside them")
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={t["content"]: t["id"] for t in tokens})
    return Encoder(fast, Tokenizer.from_file(added))


def ids(enc: Encoder, text: str | None) -> np.ndarray:
    """Ids of a text; an added token's string in it is that token.

    The splitting pattern backtracks without end on very long runs of white space in ``tiktoken``; texts with such
    a run are encoded by ``tokenizers``, whose ids are the same.
    """
    text = text or ""
    if len(text) >= LONGEST_BLANK and _BLANKS.search(text):
        return np.array(enc.every.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(enc.fast.encode(text, allowed_special="all"), dtype="<u4")


def vocabulary() -> dict[str, str]:
    """The rank file of the 50k byte-level vocabulary, its splitting pattern and the file that lists its added tokens."""
    import public_tokenizers

    return {"ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "added": public_tokenizers.path("byte_bpe_50k.json")}
