"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from herdlens.llm.common import chunks, text_bytes

CHUNK_BYTES = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(buffer: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a chunk, and the text it stands in; texts begin at ``first`` and end with a blank."""
    buffer = _LOWER[buffer]
    inside = ~_BLANK[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    n = len(buffer)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * powers(_MULTIPLIER, n), dtype=np.uint64)])
    value = (running[end] - running[begin]) * powers(_INVERSE, n + 1)[begin]
    owner = np.searchsorted(first, begin, side="right") - 1
    return mix(value ^ (end - begin).astype(np.uint64)), owner


def sets(texts: pa.Array, width: int):
    """Chunks of (first text, number of texts, text of each shingle, its hash): distinct, sorted within a text.

    A text of fewer than ``width`` words has its whole sequence as one shingle; without words it has none.
    """
    import pyarrow.compute as pc

    raw, offsets = text_bytes(pc.binary_join_element_wise(texts, pa.scalar(""), pa.scalar(" ")))
    for begin, end in chunks(np.diff(offsets), CHUNK_BYTES):
        word, owner = word_hashes(raw[offsets[begin] : offsets[end]], offsets[begin:end] - offsets[begin])
        count = np.bincount(owner, minlength=end - begin)
        rank = np.arange(len(word)) - (np.cumsum(count) - count)[owner]
        at = np.flatnonzero(count[owner] - rank >= np.minimum(width, count[owner]))
        at = at[(rank[at] == 0) | (count[owner[at]] >= width)]
        total = mix(np.minimum(width, count[owner[at]]).astype(np.uint64))
        for k in range(width):
            there = k < count[owner[at]]
            total[there] = mix(total[there] + word[at[there] + k])
        order = np.lexsort((total, owner[at]))
        total, own = total[order], owner[at][order]
        new = np.ones(len(total), bool)
        new[1:] = (total[1:] != total[:-1]) | (own[1:] != own[:-1])
        yield begin, end - begin, own[new], total[new]
