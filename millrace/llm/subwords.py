"""Hashed character n-grams of whole texts, in numpy over many texts at once."""

from __future__ import annotations

import numpy as np

#: n-gram lengths in UTF-8 bytes; a boundary mark may be the first or last of them.
NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 18
#: Texts are taken in blocks of about so many bytes, to bound memory; longer ones in pieces.
BLOCK_BYTES = 1_000_000

_CLASS = np.zeros(256, np.uint32)  # 0: boundary
_CLASS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = np.arange(1, 37)
_CLASS[128:] = np.arange(128, 256)
_BASE = 0x01000193


def pieces(raw: bytes):
    """A text in parts of at most BLOCK_BYTES that end at word boundaries, so that their n-grams are the text's."""
    while len(raw) > BLOCK_BYTES:
        marks = np.flatnonzero(_CLASS[np.frombuffer(raw[:BLOCK_BYTES], np.uint8)] == 0)
        end = int(marks[-1]) if len(marks) and marks[-1] else BLOCK_BYTES  # a longer word is cut
        yield raw[:end]
        raw = raw[end:]
    yield raw


def blocks(texts):
    """Lists of (text number, lower-cased UTF-8 piece) of at most about BLOCK_BYTES together; None counts as empty."""
    got, size = [], 0
    for k, text in enumerate(texts):
        for piece in pieces((text or "").lower().encode()):
            if got and size + len(piece) > BLOCK_BYTES:
                yield got
                got, size = [], 0
            got.append((k, piece))
            size += len(piece)
    if got:
        yield got


def ngrams(block: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): all n-grams of all texts, text after text within each length, and how many each text has.

    buckets has shape (k,) for all lengths in turn; counts has shape (lengths, texts).
    """
    raw = np.frombuffer(b"\0" + b"\0".join(block) + b"\0" * (max(NGRAMS) + 1), np.uint8)
    c = _CLASS[raw]
    marks = np.cumsum(c == 0, dtype=np.int32)
    ends = np.cumsum([len(b) + 1 for b in block])  # place of the mark after each text
    n_max = len(raw) - max(NGRAMS)
    h, power, found, counts = np.zeros(n_max, np.uint32), 1, [], []
    for k in range(max(NGRAMS)):
        h = h + c[k : k + n_max] * np.uint32(power)
        power = power * _BASE % (1 << 32)
        n = k + 1
        if n in NGRAMS:
            at = np.flatnonzero(marks[n - 2 : n - 2 + n_max] == marks[:n_max])  # no mark inside, ends apart
            x = h[at] ^ np.uint32(n * 0x9E3779B1 % (1 << 32))
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            found.append(x >> np.uint32(32 - BUCKET_BITS))
            counts.append(np.diff(np.searchsorted(at, ends, "left"), prepend=0))
    return np.concatenate(found), np.array(counts)
