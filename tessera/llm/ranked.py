"""Byte-level BPE by the tiktoken library, one encoder a worker process; the rank file's path is a parameter."""

from __future__ import annotations

import functools

import numpy as np


@functools.cache
def encoding(path: str, pattern: str):
    """The library's encoding of a rank file, without special tokens."""
    import tiktoken

    from .bpe import read_ranks

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(read_ranks(path))}, special_tokens={})


def id_bytes(path: str) -> int:
    """Bytes of an id: two where all ids and one more for the end fit."""
    from .bpe import read_ranks

    return 2 if len(read_ranks(path)) < 1 << 16 else 4


def encoded(text: str, path: str, pattern: str, end: list[int], width: int) -> bytes:
    """Ids of a whole text and its end, little-endian."""
    return np.array(encoding(path, pattern).encode_ordinary(text) + end, f"<u{width}").tobytes()


def count(text: str, path: str, pattern: str) -> int:
    return len(encoding(path, pattern).encode_ordinary(text))
