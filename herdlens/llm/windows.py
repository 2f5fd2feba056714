"""Substring dedup by words: every word of a window that also starts in a document of a smaller id goes.

Level-wise doubling. The wanted length is reached from half of it (or a quarter, and so on) by doubling. At a level, a
document shows of each candidate window one shorter window inside it, chosen by content (the smallest hash, of equal
ones the leftmost), so that equal candidates show the same. Only candidates whose shorter window stands in another text
too stay for the level of twice the length; at the wanted length a window shows itself, and the least id that has it is
compared with its own. If no candidate survives a level, the next ones have nothing to do.

Equal texts are one text, with its least id: its other rows lose all their words if they are long enough. Counts are
partial aggregates of hashes, so a passage that a third of all rows share is no hot group, and joins back to the places
are between written tables, which adaptive execution can split. Words and windows are compared by 64-bit hashes.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; a null id counts as larger than
any other, and equal ids are not smaller than each other, so rows that share an id or have none keep what only they
share; very long texts are one buffer of their own; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm import common
from herdlens.llm.common import chunks, text_bytes
from herdlens.llm.shingles import mix, powers

WORDS = 50
#: How often the wanted length is halved to get the first level.
HALVINGS = 1
CHUNK_BYTES = 250_000  # arrays of eight bytes for each byte of it stay in a processor's cache
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0xA24BAED4963EE407)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(1313).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = (1 << 63) - 1


class Sequences:
    """Hashes of any run of values of one chunk, from running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_INVERSE, n + 1)

    def at(self, begin: np.ndarray, size) -> np.ndarray:
        return mix((self.running[begin + size] - self.running[begin]) * self.back[begin])


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of each word of the texts in ``raw``, and the number of the first word of each text.

    Words do not cross texts, whether or not a blank stands between.
    """
    inside = ~_BLANK[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    code = mix(Sequences(_BYTE[raw]).at(begin, end - begin) ^ (end - begin).astype(np.uint64))
    return begin, end, code, np.searchsorted(begin, offsets)


def shown(code: np.ndarray, starts: np.ndarray, words: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For candidate windows at sorted ``starts``: the distinct shown windows of ``size`` words, one a run of candidates.

    Returns their hashes, and the first and last place in ``starts`` of the candidates that each stands for.
    """
    sequences = Sequences(code)
    if size == words:
        at = np.arange(len(starts))
        return sequences.at(starts, size), at, at
    choices = words - size + 1
    spots = len(code) - size + 1
    value = sequences.at(np.arange(spots), size)
    value = (value >> np.uint64(31) << np.uint64(31)) | np.arange(spots, dtype=np.uint64)  # ties: the leftmost
    blocks = -(-spots // choices) + 1
    padded = np.full(blocks * choices, np.iinfo(np.uint64).max, np.uint64)
    padded[:spots] = value
    grid = padded.reshape(blocks, choices)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[starts], ahead[starts + choices - 1]) & np.uint64((1 << 31) - 1)).astype(np.int64)
    # A run ends where another window is shown, or where candidates are not neighbours.
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return sequences.at(place[first], size), first, np.concatenate([first[1:], [len(starts)]]) - 1


def _shown_rows(texts: DataFrame, words: int, size: int, known: bool) -> DataFrame:
    """Rows (code, t, id, first, last): shown windows and the candidate places they stand for.

    ``texts`` has (t, id, text), and if ``known`` the candidates as an array ``s`` of (first, last); else all windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            key, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "id"))
            for a, b in chunks(np.diff(offsets), CHUNK_BYTES):
                _, _, code, word = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if known:
                    lists = batch.column("s").slice(a, b - a)
                    each = lists.flatten()
                    low, high = (each.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    text = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy(zero_copy_only=False))
                    low, count = low + word[text], high - low + 1
                else:
                    low, count = word[:-1], np.maximum(0, np.diff(word) - words + 1)
                    text = np.arange(b - a)
                text = np.repeat(text, count)
                starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                if not len(starts):
                    continue
                if known:
                    order = np.argsort(starts, kind="stable")
                    starts, text = starts[order], text[order]
                hashes, first, last = shown(code, starts, words, size)
                own = text[first]
                for c in range(0, len(hashes), 200_000):
                    p = slice(c, c + 200_000)
                    at = [starts[first[p]] - word[own[p]], starts[last[p]] - word[own[p]]]
                    columns = [hashes[p].view(np.int64), key[a + own[p]], number[a + own[p]], *at]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["code", "t", "id", "first", "last"])

    return texts.mapInArrow(run, "code bigint, t bigint, id bigint, first bigint, last bigint")


def levels(words: int, halvings: int) -> list[int]:
    """Rising lengths up to ``words``, each at most twice the one before and two words at least."""
    out = [words]
    while len(out) <= halvings and out[0] > 3:
        out.insert(0, -(-out[0] // 2))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))


def repeated_windows(docs: DataFrame, words: int = WORDS, halvings: int = HALVINGS) -> tuple[DataFrame, DataFrame]:
    """Texts that lose words, as (t, id, text, s): ``s`` lists the windows that go; and (t, id, count) of every text.

    ``docs`` has (doc_id, text); t is the hash of a text and id its least doc_id.
    """
    rows, counts, texts, _ = _candidates(docs, words, halvings, "t")
    if texts is None:
        texts = common.written(rows.join(counts.drop("count"), ["t", "id"]).dropDuplicates(["t"]), "texts")
    return _found(texts, words, "id", "least < id"), counts


def windows_elsewhere(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(t, id, text, s): windows of a text that stand at any other place of any text, the same one included.

    Copies of a text are one text here too; those of so many words are listed beside, as (t).
    """
    place = "xxhash64(t, first)"
    _, counts, texts, copied = _candidates(docs, words, 1, place)
    common.dropped(counts)
    return _found(texts, words, place, "true"), copied


def _candidates(docs: DataFrame, words: int, halvings: int, place: str) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Rows, (t, id, count) of texts, the texts with candidates after all levels but the last, and copied texts of so many words.

    ``place`` tells places apart at which a window counts as repeated.
    """
    rows = _keyed(docs)
    counts = common.written(rows.groupBy("t").agg(F.min("id").alias("id"), F.count("*").alias("count")), "counts")
    # A text of w words has 2 w - 1 bytes at least.
    texts, known, made, copied = rows.where(F.octet_length("text") >= 2 * words - 1), False, [], None
    for size in levels(words, halvings)[:-1]:
        own = common.written(_shown_rows(texts, words, size, known).drop("id"), "shown")
        both = own.groupBy("code").agg(F.expr(f"min({place})").alias("one"), F.expr(f"max({place})").alias("other"))
        alive = common.written(both.where("one < other").select("code"), "alive")
        live = own.join(alive, "code").select("t", "first", "last").distinct()
        per_text = common.written(live.groupBy("t").agg(F.collect_list(F.struct("first", "last")).alias("s")).join(counts.select("t", "id"), "t"), "candidates")
        if copied is None:
            copied = common.written(counts.where("count > 1").select("t").join(own.select("t").distinct(), "t"), "copied")
        common.dropped(own, alive)
        source = rows.join(per_text, ["t", "id"]).dropDuplicates(["t"]) if not known else texts.drop("s").join(per_text.drop("id"), "t")
        texts, known = common.written(source.select("t", "id", "text", "s"), "texts"), True
        common.dropped(per_text, *made)
        made = [texts]
    return rows, counts, texts if known else None, copied


def _found(texts: DataFrame, words: int, order: str, goes: str) -> DataFrame:
    """The last level: windows of the wanted length, of which those go whose hash has several values of ``order``."""
    own = common.written(_shown_rows(texts, words, words, "s" in texts.columns).drop("last"), "shown")
    least = own.groupBy("code").agg(F.expr(f"min({order})").alias("least"), F.expr(f"max({order})").alias("most"))
    least = common.written(least.where("least < most").select("code", "least"), "least")
    gone = common.written(own.join(least, "code").where(goes).groupBy("t").agg(F.collect_list("first").alias("s")), "gone")
    cut = common.written(texts.drop("s").join(gone, "t"), "cut")
    common.dropped(own, least, gone, texts)
    return cut


def covered_bytes(cut: DataFrame, words: int = WORDS) -> DataFrame:
    """(t, n_passage): bytes of each text of ``repeated_windows`` in its windows, blanks between their words included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            total = []
            for i, s in enumerate(batch.column("s")):
                own = raw[offsets[i] : offsets[i + 1]]
                begin, end, *_ = words_of(own, np.array([0, len(own)]))
                at = np.sort(s.values.to_numpy(zero_copy_only=False))
                low, high = begin[at], end[at + words - 1]
                # What a window adds to those before it, whose ends rise as well.
                total.append(int((high - np.maximum(low, np.concatenate([low[:1], high[:-1]]))).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(total, pa.int64())], names=["t", "n_passage"])

    return cut.mapInArrow(run, "t bigint, n_passage bigint")


def kept_words(cut: DataFrame, words: int = WORDS) -> DataFrame:
    """(t, n_removed, kept): words removed from each text of ``repeated_windows``, and the others joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            removed, kept = [], []
            for i, s in enumerate(batch.column("s")):
                own = raw[offsets[i] : offsets[i + 1]]
                begin, end, *_ = words_of(own, np.array([0, len(own)]))
                at = s.values.to_numpy(zero_copy_only=False)
                change = np.bincount(at, minlength=len(begin) + 1) - np.bincount(at + words, minlength=len(begin) + 1)[: len(begin) + 1]
                stay = np.cumsum(change)[: len(begin)] == 0
                data = own.tobytes()
                removed.append(int((~stay).sum()))
                kept.append(b" ".join([data[a:b] for a, b in zip(begin[stay].tolist(), end[stay].tolist(), strict=True)]))
            arrays = [batch.column("t"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["t", "n_removed", "kept"])

    return cut.mapInArrow(run, "t bigint, n_removed bigint, kept string")


def spaced(text: Column) -> Column:
    """The words of a text, joined by one space."""
    return F.regexp_replace(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+", " ")


def _joined(docs: DataFrame, words: int, halvings: int, rows: DataFrame, cut_columns: list[Column]) -> DataFrame:
    """``rows`` (with __t__, __id__, __n__) beside what their text loses; __gone__ marks rows that lose every word."""
    cut, counts = repeated_windows(docs, words, halvings)
    per_text = common.written(counts.join(kept_words(cut, words).select("t", *cut_columns), "t", "left").withColumnsRenamed({"t": "__t__", "id": "__least__"}).drop("count"), "per-text")
    joined = rows.join(per_text, "__t__")
    return joined.withColumn("__gone__", (F.col("__id__") > F.col("__least__")) & (F.col("__n__") >= words))


def _with_keys(docs: DataFrame, kept: list[Column]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = spaced(text)
    count = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "))) + 1).cast("long")
    return docs.select(*kept, F.xxhash64(text).alias("__t__"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("__id__"), count.alias("__n__"))


def digests(docs: DataFrame, words: int = WORDS, halvings: int = HALVINGS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row; texts of rows that lose nothing are not shuffled."""
    narrow = docs.select("doc_id", "text")
    rows = _with_keys(narrow, [F.col("doc_id"), F.sha2(spaced(F.coalesce("text", F.lit(""))), 256).alias("__whole__")])
    joined = _joined(narrow, words, halvings, rows, [F.col("n_removed").alias("__removed__"), F.sha2("kept", 256).alias("__kept__")])
    return joined.select(
        "doc_id", F.col("__n__").alias("n_words"), F.when(F.col("__gone__"), F.col("__n__")).otherwise(F.coalesce("__removed__", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("__gone__"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("__kept__", "__whole__")).alias("kept_sha256"),
    )


def deduplicate(docs: DataFrame, words: int = WORDS, halvings: int = HALVINGS) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of each row: the words that stay, joined by one space; a text that loses none as it was."""
    narrow = docs.select("doc_id", "text")
    rows = _with_keys(narrow, [F.col("doc_id"), F.col("text")])
    joined = _joined(narrow, words, halvings, rows, [F.col("n_removed").alias("__removed__"), F.col("kept").alias("__kept__")])
    text = F.when(F.col("__gone__"), F.lit("")).otherwise(F.coalesce("__kept__", "text"))
    removed = F.when(F.col("__gone__"), F.col("__n__")).otherwise(F.coalesce("__removed__", F.lit(0)))
    return joined.select("doc_id", text.alias("text"), F.col("__n__").alias("n_words"), removed.cast("long").alias("n_removed"))
