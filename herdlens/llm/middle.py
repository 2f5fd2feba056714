"""Fill-in-middle: texts cut in three at unit boundaries and put in another order between markers.

A unit is a run of ASCII letters or one other character. Cuts are drawn from a row's key, fall on units, and are wanted
both in bytes (to copy spans) and in characters (to report them). A sparse index of exceptions converts between the
two: it holds only the characters of several bytes, their places and the running number of excess bytes, so a binary
search in it gives a cut's excess, and spans of ASCII stay plain arithmetic. A batch of texts is handled as one buffer.

Cases: null and empty texts have no units, are ``plain``, and their output is empty (null texts stay null in ``text``);
texts that hold a marker are plain, as their output could not be read back; one long text is one buffer of its own; a
null key hashes as an empty one; equal texts under different keys are cut differently, repeated rows alike; columns of
the input that are named like new ones are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from herdlens.llm.common import chunks, text_bytes

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts so many change, and so many of those have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
CHUNK_BYTES = 1_000_000
NEW = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


class Exceptions:
    """Characters of several bytes in a buffer of UTF-8: where they begin, and the excess bytes before each."""

    def __init__(self, buffer: np.ndarray):
        self.place = np.flatnonzero(buffer >= 0xC0)
        lead = buffer[self.place]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(more)])
        # The same places counted in characters.
        self.char = self.place - self.excess[:-1]

    def to_chars(self, byte: np.ndarray) -> np.ndarray:
        """Character number of byte offsets that lie between characters."""
        return byte - self.excess[np.searchsorted(self.place, byte)]

    def to_bytes(self, char: np.ndarray) -> np.ndarray:
        """Byte offset of character numbers."""
        return char + self.excess[np.searchsorted(self.char, char)]


def unit_starts(buffer: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin in a buffer of texts that begin at ``first``."""
    low = buffer | 0x20
    letter = (low >= ord("a")) & (low <= ord("z")) & (buffer < 0x80)
    begins = (buffer & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[first[first < len(buffer)]] = True
    return np.flatnonzero(begins)


def _draws(key: Column, salt: str) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the salt and the key's text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _cut(raw: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray]) -> list[pa.Array]:
    """The new columns of one chunk of texts, whose bytes are ``raw``."""
    units, index = unit_starts(raw, offsets[:-1]), Exceptions(raw)
    own = np.searchsorted(units, offsets)
    n = np.diff(own)
    cut = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)]), axis=0)
    stops = np.append(units, len(raw))
    at = np.where(cut == n, offsets[1:], stops[np.minimum(own[:-1] + cut, len(units))])
    chars = index.to_chars(np.stack([offsets[:-1], at[0], at[1]]))
    data, bounds = raw.tobytes(), offsets.tolist()
    changed, suffix_first = (draws[2] % 100 < CHANGED) & (n > 0), draws[3] % 100 < SUFFIX_FIRST
    form, output = [], []
    for i, (a, b) in enumerate(zip(at[0].tolist(), at[1].tolist(), strict=True)):
        text = data[bounds[i] : bounds[i + 1]]
        if not changed[i] or PREFIX in text or SUFFIX in text or MIDDLE in text:
            form.append("plain")
            output.append(text)
            continue
        a, b = a - bounds[i], b - bounds[i]
        ahead, middle, behind = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
        form.append("spm" if suffix_first[i] else "psm")
        output.append(behind + ahead + middle if suffix_first[i] else ahead + behind + middle)
    plain = np.array([f == "plain" for f in form])
    return [
        pa.array(n.astype(np.int64)),
        pa.array(form, pa.string()),
        *(pa.array((chars[k + 1] - chars[k]).astype(np.int64), mask=plain) for k in range(2)),
        pa.array(output, pa.binary()).cast(pa.string()),
    ]


def rearrange(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: str = "1") -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    new = set(NEW.names)
    kept = [c for c in docs.columns if c not in new]
    schema = T.StructType([docs.schema[c] for c in kept] + NEW.fields)
    # Columns are read by place, so that no name of the input can clash.
    draws = F.array(*_draws(F.col(f"`{key}`"), salt))
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")), draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(len(kept)))
            drawn = batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4).T
            for a, b in chunks(np.diff(offsets), CHUNK_BYTES):
                made = _cut(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], list(drawn[:, a:b]))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[: len(kept)]] + made, names=schema.names)

    return source.mapInArrow(run, schema)


def original(output: str, form: str) -> Column:
    """The exact text of an output: markers stand where its form says, and no span holds one."""
    out = F.col(output)
    prefix, suffix, middle = (F.lit(m.decode()) for m in (PREFIX, SUFFIX, MIDDLE))
    # Of psm, the suffix begins after its marker and ends before the middle's; of spm, the prefix does.
    second = F.when(F.col(form) == "psm", suffix).otherwise(prefix)
    before = lambda text, marker: F.call_function("substring_index", text, marker, F.lit(1))
    head = before(out, second)
    rest = F.substr(out, F.length(head) + 4)
    between = before(rest, middle)
    last = F.substr(rest, F.length(between) + 4)
    head = F.substr(head, F.lit(4))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(head, last, between)).otherwise(F.concat(between, last, head))
