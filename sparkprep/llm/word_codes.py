"""Exact integer codes of words: equal words of a batch, and no others, share a code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def joined(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts with a blank after each, where each text begins and the last one ends)."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    size = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return raw, np.concatenate([[0], np.cumsum(size)])


def word_spans(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of bytes that ``inside`` marks."""
    mask = inside[raw]
    change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        change = np.concatenate([[0], change])
    if len(mask) and mask[-1]:
        change = np.append(change, len(mask))
    return change[0::2], change[1::2]


def word_array(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of ascending, disjoint spans as one Arrow array."""
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    step = np.zeros(len(raw) + 1, dtype=np.int8)
    step[start] = 1
    step[end] -= 1  # spans do not touch, so no place gets both
    data = raw[np.cumsum(step, dtype=np.int8)[:-1].view(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words by code)."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
