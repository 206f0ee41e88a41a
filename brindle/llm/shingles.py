"""Word shingles of whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from brindle.llm import bpe

_A = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, ascending within each text, and where each text's begin, plus the end.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text with fewer words than ``size`` has its whole
    sequence as one shingle; a text without words has none.
    """
    joined = "".join(x + "\n" for x in texts.to_pylist()).encode("utf-8", "surrogatepass")
    data = np.frombuffer(joined, np.uint8)
    n_texts = len(texts)
    if not n_texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    sizes = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts.cast(pa.large_binary())
    ends = np.cumsum(pa.compute.binary_length(sizes).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)
    words = bpe.span_hashes(lower, start, stop)
    row = np.searchsorted(ends, start, "right")
    per = np.bincount(row, minlength=n_texts)
    first = np.cumsum(per) - per
    n = max(len(words) - size + 1, 0)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h = (h ^ words[k : k + n]) * _A
        h ^= h >> np.uint64(32)
    whole = row[:n] == row[size - 1 :]
    keys, owner = [h[whole]], [row[:n][whole]]
    for r in np.flatnonzero((per > 0) & (per < size)).tolist():
        x = np.array([per[r]], np.uint64)
        for w in words[first[r] : first[r] + per[r]]:
            x = (x ^ w) * _A
            x ^= x >> np.uint64(32)
        keys.append(x)
        owner.append(np.array([r]))
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.searchsorted(own, np.arange(n_texts + 1))
