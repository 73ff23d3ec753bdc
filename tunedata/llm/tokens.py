"""Encoding of whole texts inside tasks.

``tiktoken`` and ``tokenizers`` files of one vocabulary give the same ids, those of plain
``Tokenizer.from_file(...).encode(text, add_special_tokens=False)`` (``tests/llm`` holds them against
it); the rank file is about three times faster and is the default.  The string of an added token in a
text (``<|endoftext|>``) gets that token's id.  The encoder is built once per Python worker from its path.

``tiktoken`` gives up on texts with a very long run of white space (its pattern backtracks); such a text
is encoded whole with the ``tokenizers`` file that lies beside the rank file.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: added tokens of the ``tokenizers`` file of the same vocabulary (rank files hold none)
ADDED = {"byte_bpe_50k.tiktoken": {"<|endoftext|>": 50256}}


def public_path(name: str) -> str:
    """Place of a public vocabulary file (installed on every executor with its package)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> list of ids; none is put around the text, strings of added tokens in it have their own id."""
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = ADDED.get(os.path.basename(path), {})
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

        def ids(text: str) -> list[int]:
            try:
                return own.encode(text, allowed_special="all")
            except ValueError:                                   # the pattern's stack is exhausted
                return encoder(path.removesuffix(".tiktoken") + ".json")(text)
        return ids
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of one text as little-endian unsigned 32-bit numbers; null counts as empty."""
    return np.array(encoder(path)(text or ""), dtype="<u4")
