"""Hashed character n-grams of words, vectorised over many texts, and bags of them with a linear softmax.

A text is lower-cased; every ASCII character that is no letter (or digit, where asked) ends a word. The n-grams
of a word include one boundary mark on either side, so a misspelling shares most of them with the word it hides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from herdlens.llm.common import chunks, text_bytes

SPACE = 32
CHUNK_BYTES = 1_000_000


def _fold_table(digits: bool) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        ch = chr(b)
        if not (ch.isalpha() or digits and ch.isdigit()):
            out[b] = SPACE
    return out


LETTERS, LETTERS_DIGITS = _fold_table(False), _fold_table(True)


@dataclass
class Bags:
    """Segments of texts: for each n-gram length the bucket at every position, and whether it counts there."""

    buffer: np.ndarray
    starts: np.ndarray  # first position of each segment
    text: np.ndarray  # the text each segment belongs to
    sizes: tuple[int, ...]
    bits: int

    def grams(self):
        """(buckets, valid) for each n-gram length; arrays are as long as the buffer."""
        b = self.buffer.astype(np.uint32)
        blank = np.concatenate([[0], np.cumsum(self.buffer == SPACE, dtype=np.int32)])
        n, h, have = len(b), b.copy(), 1
        for size in self.sizes:
            while have < size:
                if have < n:
                    h[: n - have] = h[: n - have] * np.uint32(0x01000193) + b[have:]
                have += 1
            valid = np.zeros(n, bool)
            if n >= size:
                last = n - size + 1
                valid[:last] = blank[size - 1 : size - 1 + last] == blank[1 : 1 + last]
            mixed = (h ^ np.uint32(size)) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - self.bits)).astype(np.int32), valid


def bags(texts: pa.Array, sizes: tuple[int, ...], bits: int, fold: np.ndarray, words: int | None):
    """Chunks of segments: whole texts, or runs of ``words`` words (the rest of a text joins its last run)."""
    padded = pc.binary_join_element_wise(pa.scalar(""), pc.utf8_lower(texts), pa.scalar(""), pa.scalar(" "))
    raw, offsets = text_bytes(padded)
    for begin, end in chunks(np.diff(offsets), CHUNK_BYTES):
        buffer = fold[raw[offsets[begin] : offsets[end]]]
        first = offsets[begin:end] - offsets[begin]
        if words is None:
            yield Bags(buffer, first, np.arange(begin, end), sizes, bits)
            continue
        opens = np.flatnonzero((buffer[1:] != SPACE) & (buffer[:-1] == SPACE))  # the mark before each word
        owner = np.searchsorted(first, opens, side="right") - 1
        count = np.bincount(owner, minlength=end - begin)
        rank = np.arange(len(opens)) - (np.cumsum(count) - count)[owner]
        cut = (rank % words == 0) & ((rank == 0) | (count[owner] - rank >= words))
        empty = np.flatnonzero(count == 0)
        starts = np.concatenate([opens[cut], first[empty]])
        text = np.concatenate([owner[cut], empty])
        order = np.argsort(starts, kind="stable")
        yield Bags(buffer, starts[order], text[order] + begin, sizes, bits)


def segment_scores(bag: Bags, table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over the n-grams of each segment; zero for a segment without any."""
    columns = np.ascontiguousarray(table.T)
    sums, count = np.zeros((len(bag.starts), len(columns))), np.zeros(len(bag.starts))
    for bucket, valid in bag.grams():
        at = np.flatnonzero(valid)
        bucket = bucket[at]
        bounds = np.append(np.searchsorted(at, bag.starts), len(at))
        count += np.diff(bounds)
        for k, column in enumerate(columns):
            running = np.concatenate([[0.0], np.cumsum(column[bucket], dtype=np.float64)])
            sums[:, k] += np.diff(running[bounds])
    return sums / np.maximum(1, count)[:, None]


def text_max(bag: Bags, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the chunk and the highest score of their segments."""
    cut = np.flatnonzero(np.concatenate([[True], bag.text[1:] != bag.text[:-1]]))
    return bag.text[cut], np.maximum.reduceat(scores, cut)


@dataclass
class Rows:
    """Training segments in compressed rows: buckets of segment i are ``bucket[indptr[i]:indptr[i + 1]]``."""

    bucket: np.ndarray
    indptr: np.ndarray
    text: np.ndarray


def rows(texts: list[str], sizes: tuple[int, ...], bits: int, fold: np.ndarray, words: int | None) -> Rows:
    parts, counts, owners = [], [], []
    for bag in bags(pa.array(texts, pa.string()), sizes, bits, fold, words):
        segment = np.zeros(len(bag.buffer), np.int32)
        segment[bag.starts[1:]] = 1
        segment = np.cumsum(segment)
        seg, buck = [], []
        for bucket, valid in bag.grams():
            at = np.flatnonzero(valid)
            seg.append(segment[at].astype(np.int32))
            buck.append(bucket[at].astype(np.uint32))
        seg, buck = np.concatenate(seg), np.concatenate(buck)
        parts.append(buck[np.argsort(seg, kind="stable")])
        counts.append(np.bincount(seg, minlength=len(bag.starts)))
        owners.append(bag.text)
    if not parts:
        return Rows(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64))
    return Rows(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(owners))


def segment_means(data: Rows, column: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Mean of one column of a table over each segment, a bounded part of the features at a time."""
    out = np.zeros(len(data.text))
    for begin, end in chunks(np.diff(data.indptr), most):
        low, high = data.indptr[begin], data.indptr[end]
        running = np.concatenate([[0.0], np.cumsum(column[data.bucket[low:high]], dtype=np.float64)])
        at = data.indptr[begin : end + 1] - low
        out[begin:end] = np.diff(running[at]) / np.maximum(1, np.diff(at))
    return out


class SubwordSoftmax:
    """Bag of hashed subword embeddings, averaged, into a linear softmax; both trained together by Adagrad SGD."""

    def __init__(self, classes: int, bits: int, dim: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
        self.out = draw.normal(0, 0.5, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self._e = np.full(self.embed.shape, 1e-4, np.float32)
        self._o = np.full(self.out.shape, 1e-4, np.float32)
        self._b = np.full(classes, 1e-4, np.float32)

    def table(self) -> np.ndarray:
        """What each bucket adds to the logits: averaging commutes with the linear layer."""
        return self.embed @ self.out

    def logits(self, data: Rows, chosen: np.ndarray) -> np.ndarray:
        return self.means(data, chosen)[0] @ self.out + self.bias

    def means(self, data: Rows, chosen: np.ndarray):
        size = (data.indptr[chosen + 1] - data.indptr[chosen]).astype(np.int64)
        begin = np.repeat(data.indptr[chosen], size)
        at = begin + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bucket, owner = data.bucket[at], np.repeat(np.arange(len(chosen)), size)
        mean = np.zeros((len(chosen), self.embed.shape[1]), np.float32)
        for k in range(mean.shape[1]):
            mean[:, k] = np.bincount(owner, self.embed[bucket, k], len(chosen)) / np.maximum(1, size)
        return mean, bucket, owner, size

    def step(self, data: Rows, chosen: np.ndarray, label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        mean, bucket, owner, size = self.means(data, chosen)
        logit = mean @ self.out + self.bias
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(label)), label] -= 1
        grad = prob * weight[:, None] / max(1e-9, weight.sum())
        back = (grad @ self.out.T / np.maximum(1, size)[:, None]).astype(np.float32)
        for value, past, g in ((self.out, self._o, mean.T @ grad), (self.bias, self._b, grad.sum(0))):
            past += g * g
            value -= rate * g / np.sqrt(past)
        used, inverse = np.unique(bucket, return_inverse=True)
        for k in range(self.embed.shape[1]):
            g = np.bincount(inverse, back[owner, k], len(used)).astype(np.float32)
            self._e[used, k] += g * g
            self.embed[used, k] -= rate * g / np.sqrt(self._e[used, k])
