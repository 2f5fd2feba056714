"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits; in scripts without blanks each character is one. A seed hashes the tokens at the marked positions of a fixed mask and
ignores the others, so a substituted token spoils few seeds. The seeds of documents are joined with those of benchmark
items; at each hit the item is laid beside the document, and the best stretch is kept (a match counts 1, a mismatch
-2). An overlap counts if it has ``LEAST`` matches, or ``SHARE`` of the item's tokens if that is less.

Before the join, document seeds meet a filter of a fixed number of bits: it keeps every seed that an item has, and the
fewer others the fewer items there are. Documents are read twice: all of them for their seeds, and those with hits, one
of each text, for the tokens beside items. Items of equal text are one item until their ids come back.

Cases: null and empty texts and items have no tokens and overlap with nothing; items shorter than a mask have masks of
their own, which no substitution that ``SHARE`` allows can spoil all at once, and count all their matches; items of up
to four tokens are thus sought whole; repeated items give a row each and rows with equal doc_id
and item_id one row, the best; ties go to the earliest place; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herdlens.llm import common, subwords
from herdlens.llm.shingles import mix, word_hashes

# Span 11, weight 7.
MASKS = ("11101100101", "11010011011", "10110101101")
LEAST, SHARE = 13, 0.8
SPAN = len(MASKS[0])
#: Bits of the filter (4 MB), and tokens of a text whose lines are looked at together.
FILTER_BITS, PART_TOKENS = 1 << 25, 1 << 16
CHUNK_BYTES = 1_000_000


#: Characters of scripts that do without blanks, and the full-width punctuation between them.
UNSPACED = r"([\p{Han}\x{3041}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
WIDE_MARKS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{30FB}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}]"


def spaced(texts: pa.Array) -> pa.Array:
    """Blanks around every character of a script that has none."""
    if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
        return texts
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, WIDE_MARKS, " "), UNSPACED, r" \1 ")


def needed(n: int) -> int:
    """Matches that an overlap with an item of n tokens has at least."""
    return min(LEAST, int(np.ceil(SHARE * n)))


def short_masks(n: int) -> set[str]:
    """Masks for an item of n tokens: of two blocks more than substitutions, all choices that leave so many blocks out."""
    spoiled = n - needed(n)
    if not spoiled:
        return {"1" * n}
    block = np.arange(n) * (spoiled + 2) // n
    out = combinations(range(spoiled + 2), spoiled)
    return {"".join("0" if b in left else "1" for b in block.tolist()).strip("0") for left in out}


def tokens(texts: pa.Array):
    """Chunks of (first text, number of texts, hash of each token, its text)."""
    raw, offsets = common.text_bytes(pc.binary_join_element_wise(spaced(pc.utf8_lower(texts)), pa.scalar(""), pa.scalar(" ")))
    for a, b in common.chunks(np.diff(offsets), CHUNK_BYTES):
        word, owner = word_hashes(subwords.LETTERS_DIGITS[raw[offsets[a] : offsets[b]]], offsets[a:b] - offsets[a])
        yield a, b - a, word, owner


def seeds(word: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a mask laid at every token where it stays inside one text."""
    span = len(mask)
    if len(word) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    count = len(word) - span + 1
    total = np.full(count, np.uint64(int(mask, 2)))
    for k, mark in enumerate(mask):
        if mark == "1":
            total = (total ^ word[k : k + count]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
    at = np.flatnonzero(owner[:count] == owner[span - 1 :])
    return at, mix(total[at])


def _item_words(items: DataFrame) -> DataFrame:
    """(item, words) of each distinct item text: its hash, and the hashes of its tokens."""
    distinct = items.where("text IS NOT NULL").select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("item")
            for a, n, word, owner in tokens(batch.column("text")):
                bound = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(bound), pa.array(word.view(np.int64)))
                yield pa.RecordBatch.from_arrays([key[a : a + n], words], names=["item", "words"])

    return distinct.mapInArrow(run, "item bigint, words array<bigint>").where(F.size("words") > 0)


def _item_seeds(words: DataFrame) -> DataFrame:
    """(code, item, at) of every mask at every token of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, own in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                word = own.values.to_numpy().view(np.uint64)
                for mask in MASKS if len(word) >= SPAN else sorted(short_masks(len(word))):
                    at, code = seeds(word, np.zeros(len(word), np.int64), mask)
                    arrays = [pa.array(code.view(np.int64)), pa.array(np.full(len(at), item)), pa.array(at)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["code", "item", "at"])

    return words.mapInArrow(run, "code bigint, item bigint, at bigint")


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """A bit for every seed of an item: ``FILTER_BITS`` bits in words of 64, however many seeds there are."""
    bit = F.pmod(F.col("code"), F.lit(FILTER_BITS))
    mark = F.expr(f"shiftleft(1L, cast(pmod(code, {FILTER_BITS}) & 63 AS int))")
    got = item_seeds.select(F.shiftright(bit, 6).alias("place"), mark.alias("mark")).groupBy("place").agg(F.bit_or("mark").alias("marks")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("place").to_numpy()] = got.column("marks").to_numpy().view(np.uint64)
    return out


def _hits(source: DataFrame, masks: list[str], marked: np.ndarray) -> DataFrame:
    """(code, row, id, spot) of the seeds of (row, id, text) rows that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id"))
            for a, n, word, owner in tokens(batch.column("text")):
                bound = np.searchsorted(owner, np.arange(n + 1))
                for mask in masks:
                    spot, code = seeds(word, owner, mask)
                    place = code & np.uint64(FILTER_BITS - 1)
                    near = np.flatnonzero(marked[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    if len(near):
                        spot, text = spot[near], owner[spot[near]]
                        columns = (code[near].view(np.int64), row[a + text], key[a + text], spot - bound[text])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["code", "row", "id", "spot"])

    return source.mapInArrow(run, "code bigint, row bigint, id bigint, spot bigint")


def _stretches(texts: DataFrame) -> DataFrame:
    """(row, item, first, skipped, words): of (row, text, lines) rows, the tokens that lie beside an item on each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines = batch.column("row").to_pylist(), batch.column("lines")
            for a, n, word, owner in tokens(batch.column("text")):
                bound = np.searchsorted(owner, np.arange(n + 1))
                for i in range(n):
                    own = lines[a + i].values
                    item, start, size = (own.field(c).to_numpy() for c in ("item", "start", "size"))
                    first, last = np.maximum(start, 0), np.minimum(start + size, bound[i + 1] - bound[i])
                    for c in range(0, len(item), 5000):
                        p = slice(c, c + 5000)
                        length = last[p] - first[p]
                        end = np.cumsum(length)
                        at = np.arange(int(end[-1])) + np.repeat(bound[i] + first[p] - (end - length), length)
                        words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(word[at].view(np.int64)))
                        arrays = [pa.array(np.full(len(length), rows[a + i])), pa.array(item[p]), pa.array(first[p]), pa.array((first - start)[p]), words]
                        yield pa.RecordBatch.from_arrays(arrays, names=["row", "item", "first", "skipped", "beside"])

    return texts.mapInArrow(run, "row bigint, item bigint, first bigint, skipped bigint, beside array<bigint>")


def best_stretch(same: np.ndarray, n: int) -> tuple[int, int, int] | None:
    """(matches, begin, end) of the best stretch beside an item of n tokens, if it is an overlap."""
    if n < SPAN:
        at = np.flatnonzero(same)
        return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) >= needed(n) else None
    running = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    end = int((running - np.minimum.accumulate(running)).argmax())
    begin = int(running[: end + 1].argmin())
    matches = int(same[begin:end].sum())
    return (matches, begin, end) if matches >= needed(n) else None


def _verified(beside: DataFrame) -> DataFrame:
    """(row, item, matches, item_tokens, start, span) of the stretches that are overlaps, once per line."""
    names = ["row", "item", "matches", "item_tokens", "start", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            keys = (batch.column(c).to_pylist() for c in ("row", "item", "first", "skipped"))
            for row, item, first, skipped, there, own in zip(*keys, batch.column("beside"), batch.column("words"), strict=True):
                there, own = there.values.to_numpy(), own.values.to_numpy()
                found = best_stretch(there == own[skipped : skipped + len(there)], len(own))
                if found:
                    out.append((row, item, found[0], len(own), first + found[1], found[2] - found[1]))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return beside.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, item, matches, item_tokens, start, span) of every overlap; row and item are the hashes of the texts."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.xxhash64(text).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), text.alias("text"))
    words = common.written(_item_words(items), "item-words")
    short = [r[0] for r in words.select(F.size("words")).where(F.size("words") < SPAN).distinct().collect()]  # ten sizes at most
    item_seeds = common.written(_item_seeds(words), "item-seeds")
    masks = [*MASKS, *sorted({m for n in short for m in short_masks(n)})]
    hits = common.written(_hits(source, masks, seed_filter(item_seeds)), "seed-hits")
    # Both sides are written, so that a frequent seed can be split. Copies of a text fold here; one of them stands for all.
    lines = hits.join(item_seeds, "code").groupBy("row", "item", (F.col("spot") - F.col("at")).alias("start")).agg(F.min("id").alias("id"))
    lines = common.written(lines.join(words.select("item", F.size("words").alias("size")), "item"), "lines")
    part = F.floor(F.col("start") / PART_TOKENS).alias("part")
    per_text = lines.groupBy("row", "id", part).agg(F.collect_list(F.struct("item", "start", "size")).alias("lines"))
    per_text = common.written(per_text, "text-lines")
    texts = source.join(per_text, ["row", "id"]).select("row", "part", "text", "lines").dropDuplicates(["row", "part"])
    found = common.written(_verified(_stretches(texts).join(words, "item")), "overlaps")
    common.dropped(words, item_seeds, hits, lines, per_text)
    return found


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matches, item_tokens, start, span) of each document and item that overlap, the best place of each."""
    best = F.max(F.struct("matches", (-F.col("start")).alias("back"), "item_tokens", "start", "span")).alias("best")
    found = common.written(_found(docs, items).groupBy("row", "item").agg(best), "best-overlaps")
    named = found.join(items.where("text IS NOT NULL").select(F.xxhash64("text").alias("item"), F.col("item_id").cast("bigint")), "item")
    keys = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    pairs = keys.join(named, "row").groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return pairs.select("doc_id", "item_id", "best.matches", "best.item_tokens", "best.start", "best.span")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with an item; other rows of the same or no doc_id stay."""
    bad = common.written(_found(docs, items).select(F.col("row").alias("__bad__")).distinct(), "leaks")
    return docs.join(bad, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__bad__"], "left_anti")
