"""Suffix-array dedup: every byte of a string of ``length`` bytes that also starts somewhere else goes.

Units are bytes or, for passages of so many words, words (``WORDS``); what follows holds for either.

Equal texts are one text with a count. In each text some suffixes are sampled by content: of the first ``window``
positions of every string of ``length`` bytes, the one with the smallest k-gram hash, so that equal strings sample the
same place in themselves. A sampled suffix whose first ``length - window`` bytes are unique cannot be in a repeated
string and goes first. The leading ``length + window`` bytes of the other suffixes, each distinct string once, are
range-partitioned by sampled splitters, sorted within a bucket by multikey quicksort, and compared with their
neighbours, across bucket boundaries too: the longest common prefix m of a suffix at p shows that the strings at
p .. p + m - length are repeated. What is left are the strings just before a sampled suffix, at the two ends of a
repeat; they are the same string only at the same distance before suffixes with equal beginnings, and are counted
there by hash.

Cases: extra columns may have any name; texts of any length keep their places, as these are 64-bit numbers and their
order among hashes has 32 bits; null and empty texts have no bytes; texts shorter than ``length`` lose nothing; a text that occurs in several
rows loses everything if it is that long; rows that repeat a doc_id, and null ids, are rows as any other; an empty
table gives an empty result. Texts and strings are compared by 64-bit hashes where they are not compared in full.
``kept_text`` is the remaining bytes as UTF-8, a cut character becoming U+FFFD.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm import common, windows
from herdlens.llm.shingles import mix, powers

LENGTH, GRAM = 400, 16
#: Words of a repeated passage.
PASSAGE = 51
CHUNK_BYTES = 250_000  # arrays of eight bytes for each byte of it stay in a processor's cache
BUCKET_ROWS = 20_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Scripts without blanks, each character of which counts as a word: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = [(0x0E01, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
_CLASS = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
WORD = f"[{_CLASS}]|[^ \t-\r{_CLASS}]+"
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _unspaced(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to a character of a script without blanks."""
    out = np.zeros(len(raw), bool)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
    for lead, size in ((0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero(raw & (0xF0 if size == 3 else 0xF8) == lead)
        code = padded[at] & (0x0F if size == 3 else 0x07)
        for k in range(1, size):
            code = code << 6 | padded[at + k] & 0x3F
        at = at[np.any([(code >= a) & (code <= b) for a, b in UNSPACED], axis=0)]
        for k in range(size):
            out[at + k] = True
    return out


class Words:
    """The words of a chunk of texts as units: hashes, the unit each text begins with, units of each text, byte spans."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        blank, alone = _BLANK[raw], _unspaced(raw)
        lead = (raw & 0xC0) != 0x80
        begins = ~blank & lead
        begins[1:] &= alone[1:] | blank[:-1] | alone[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        begins[first] = ~blank[first]
        ends = ~blank
        ends[:-1] &= blank[1:] | begins[1:]
        ends[first[1:] - 1] = ~blank[first[1:] - 1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.values = mix(_Hashes(_BYTE[raw]).at(self.begin, self.end - self.begin) ^ (self.end - self.begin).astype(np.uint64))
        place = np.searchsorted(self.begin, offsets)
        self.first, self.size = place[:-1], np.diff(place)

    def cut(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from the first unit of a run to the end of its last."""
        return self.begin[first], self.end[last - 1]

    def context(self, first: int, last: int) -> bytes:
        return self.values[first:last].astype(">u8").tobytes()


class Bytes:
    """The bytes of a chunk of texts as units."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.values = raw, _BYTE[raw]
        self.first, self.size = offsets[:-1], np.diff(offsets)

    def cut(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first, last

    def context(self, first: int, last: int) -> bytes:
        return self.raw[first:last].tobytes()


class Kind:
    """What texts are cut into: the units, their bytes in a context, how many make the k-gram that samples, and eighths.

    So many eighths of a string, less the k-gram, are the window of places of which one is sampled.
    """

    def __init__(self, units: type, width: int, gram: int, eighths: int):
        self.units, self.width, self.gram, self.eighths = units, width, gram, eighths

    def window(self, length: int) -> int:
        return max(1, length * self.eighths // 8 - self.gram)


# A few words tell more than as many bytes, so fewer of their suffixes do.
BYTES, WORDS = Kind(Bytes, 1, GRAM, 5), Kind(Words, 8, 4, 6)


def _alone(kind: Kind, text: str) -> Bytes | Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return kind.units(raw, np.array([0, len(raw)]))


class _Hashes:
    """Hashes of any run of units of one chunk, from running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(_BASE, n), dtype=np.uint64)])
        self.back = powers(_BASE_INVERSE, n + 1)

    def at(self, begin: np.ndarray, size) -> np.ndarray:
        return mix((self.running[begin + size] - self.running[begin]) * self.back[begin] + np.uint64(1))


def sampled(units: Bytes | Words, kind: Kind, length: int):
    """Sampled suffixes of a chunk: text, position in it, least and most distance of the strings they stand for, hashes.

    The strings are those of ``length`` units inside one text; each belongs to one suffix.
    """
    window, none = kind.window(length), np.zeros(0, np.int64)
    first, size, n = units.first, units.size, len(units.values)
    if n < length or not (size >= length).any():
        return none, none, none, none, none, none, none
    gram = min(kind.gram, length)
    hashes = _Hashes(units.values)
    spots = n - gram + 1
    value = hashes.at(np.arange(spots), gram)
    value = (value >> np.uint64(32) << np.uint64(32)) | np.arange(spots, dtype=np.uint64)  # ties: the leftmost
    # Least of every ``window`` spots: from the two blocks it touches.
    blocks = -(-spots // window) + 1
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:spots] = value
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.concatenate([np.arange(f, f + s - length + 1) for f, s in zip(first.tolist(), size.tolist(), strict=True) if s >= length])
    place = (np.minimum(behind[starts], ahead[starts + window - 1]) & np.uint64((1 << 32) - 1)).astype(np.int64)
    owner = np.searchsorted(first, starts, side="right") - 1
    cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.concatenate([cut[1:], [len(starts)]]) - 1
    at, text = place[cut], owner[cut]
    end = first[text] + size[text]
    head = hashes.at(at, length - window)
    reach = np.minimum(end - at, length + window)
    whole = mix(hashes.at(at, reach) + reach.astype(np.uint64))
    return text, at - first[text], at - starts[last], at - starts[cut], reach, head.view(np.int64), whole.view(np.int64)


def _suffixes(texts: DataFrame, kind: Kind, length: int) -> DataFrame:
    """Rows (t, pos, near, far, reach, head, whole) of the sampled suffixes of (t, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column("text"))
            key, size = batch.column("t").to_numpy(zero_copy_only=False), np.diff(offsets)
            for a, b in common.chunks(size, CHUNK_BYTES):
                text, *rest = sampled(kind.units(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), kind, length)
                if len(text):
                    names = ["t", "pos", "near", "far", "reach", "head", "whole"]
                    yield pa.RecordBatch.from_arrays([pa.array(key[a + text]), *map(pa.array, rest)], names=names)

    return texts.mapInArrow(run, "t bigint, pos bigint, near bigint, far bigint, reach bigint, head bigint, whole bigint")


def multikey_order(rows: list[bytes]) -> np.ndarray:
    """Order of the strings by three-way quicksort, eight bytes as one character; short runs are sorted directly."""
    width = max(1, -(-max(map(len, rows), default=0) // 8))
    table = np.zeros((len(rows), width * 8), np.uint8)
    for i, r in enumerate(rows):
        table[i, : len(r)] = np.frombuffer(r, np.uint8)
    chars = table.view(">u8").astype(np.uint64)
    out, stack = [], [(np.arange(len(rows)), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) <= 16 or depth == width:
            out += sorted(part.tolist(), key=rows.__getitem__)
            continue
        own = chars[part, depth]
        pivot = np.partition(own[:: max(1, len(own) // 63)], len(own[:: max(1, len(own) // 63)]) // 2)[len(own[:: max(1, len(own) // 63)]) // 2]
        stack.append((part[own > pivot], depth))
        stack.append((part[own == pivot], depth + 1))
        stack.append((part[own < pivot], depth))
    return np.array(out, np.int64)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    return int(differ.argmax()) if differ.any() else n


def _neighbours(contexts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(head, whole, m): the longest common prefix, in units of ``width`` bytes, of each distinct context with another one.

    Also the table of sorted contexts that it reads.
    """
    rows = contexts.count()
    buckets = max(common.tasks(contexts), -(-rows // BUCKET_ROWS))
    # Splitters are whole contexts: few for each bucket, so that their sample stays small at the driver.
    dealt = contexts.repartitionByRange(buckets, "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part = pa.Table.from_batches(got)
        strings = part.column("context").to_pylist()
        order = multikey_order(strings)
        shared = np.array([common_prefix(strings[i], strings[j]) for i, j in zip(order[:-1], order[1:], strict=True)], np.int64)
        most = np.zeros(len(order), np.int64)
        most[1:] = shared
        most[:-1] = np.maximum(most[:-1], shared)
        edge: list[bytes | None] = [None] * len(order)
        edge[0], edge[-1] = strings[order[0]], strings[order[-1]]
        for begin in range(0, len(order), 5000):
            at = slice(begin, begin + 5000)
            columns = [part.column(c).take(pa.array(order[at])).combine_chunks() for c in ("head", "whole")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(most[at]), pa.array(edge[at], pa.binary())], names=["head", "whole", "m", "edge"])

    with common.setting(contexts.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", "20"):
        sorted_rows = common.written(dealt.mapInArrow(run, "head bigint, whole bigint, m bigint, edge binary"), "sorted")
    # The last suffix of a bucket and the first of the next one: two rows of each bucket.
    edges = sorted_rows.where("edge IS NOT NULL").select("head", "whole", "edge")
    beside = edges.selectExpr("head", "whole", "edge", "lag(edge) OVER (ORDER BY edge) AS before", "lead(edge) OVER (ORDER BY edge) AS after")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [
                max(common_prefix(e, x) if x is not None and x != e else 0 for x in (p, q))
                for e, p, q in zip(*(batch.column(c).to_pylist() for c in ("edge", "before", "after")), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("head"), batch.column("whole"), pa.array(most, pa.int64())], names=["head", "whole", "m"])

    across = beside.mapInArrow(compare, "head bigint, whole bigint, m bigint")
    longest = sorted_rows.select("head", "whole", "m").union(across).groupBy("head", "whole").agg(F.max("m").alias("m"))
    return longest.withColumn("m", (F.col("m") / width).cast("bigint")), sorted_rows


def _cover(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals [start, end)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.concatenate([new[1:] - 1, [len(starts) - 1]])]


def _entries(lists: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The list that each entry of an array of lists of structs of whole numbers is in, and the fields of all entries."""
    each = lists.flatten()
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), [x.to_numpy(zero_copy_only=False) for x in each.flatten()]


def _open(places: DataFrame, length: int) -> DataFrame:
    """(head, t, pos, low, high): distances before a suffix where a string may be repeated and no suffix shows it."""
    per_text = places.where("count = 1").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("pos", "near", "far", "head", "m"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, (pos, near, far, head, m) = _entries(batch.column("s"))
            # All texts on one line, with gaps between them that no distance reaches over.
            gap = int((pos + m).max(initial=0)) + int(far.max(initial=0)) + 2 * length
            at = pos + text * gap
            first, last = at - far, np.minimum(at - near, at - length + m)
            shown = m >= length
            if shown.any():
                begin, end = _cover(at[shown], (at + m - length + 1)[shown])
                # Narrow [first, last] to what no interval covers, from both sides.
                i = np.searchsorted(begin, first, side="right") - 1
                first = np.where((i >= 0) & (end[i] > first), end[i], first)
                j = np.searchsorted(begin, last, side="right") - 1
                last = np.where((j >= 0) & (end[j] > last), begin[j] - 1, last)
            left = first <= last
            key = batch.column("t").to_numpy(zero_copy_only=False)[text]
            columns = [x[left] for x in (head, key, pos, at - last, at - first)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["head", "t", "pos", "low", "high"])

    return per_text.mapInArrow(run, "head bigint, t bigint, pos bigint, low bigint, high bigint")


def _counted(texts: DataFrame, places: DataFrame, kind: Kind, length: int) -> DataFrame:
    """(t, found): starts of repeated strings that only their hash shows; ``texts`` has (t, text)."""
    own = common.written(_open(places, length), "open")
    groups = common.written(own.groupBy("head").agg(F.min("low").alias("least"), F.max("high").alias("most")), "groups")
    asked = places.join(groups, "head").join(own.select("t", "pos", "low", "high"), ["t", "pos"], "left")
    asked = asked.withColumn("near", F.greatest("near", "least", F.lit(length) - F.col("m"))).withColumn("far", F.least("far", "most")).where("near <= far")
    # Nothing is open where low exceeds high.
    bounds = [F.coalesce("low", F.lit(1)).alias("low"), F.coalesce("high", F.lit(0)).alias("high")]
    per_text = asked.groupBy("t").agg(F.collect_list(F.struct("pos", "near", "far", *bounds)).alias("s"))
    source = texts.join(per_text, "t")

    def strings(only_open: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = common.text_bytes(batch.column("text"))
                key, lists = batch.column("t").to_numpy(zero_copy_only=False), batch.column("s")
                for first, last in common.chunks(np.diff(offsets), CHUNK_BYTES):
                    text, (pos, near, far, low, high) = _entries(lists.slice(first, last - first))
                    if only_open:
                        text, pos, near, far, low, high = (x[low <= high] for x in (text, pos, near, far, low, high))
                    if not len(text):
                        continue
                    units = kind.units(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    hashes, count = _Hashes(units.values), far - near + 1
                    which = np.repeat(np.arange(len(count)), count)
                    away = far[which] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                    is_open = (low[which] <= away) & (away <= high[which])
                    if only_open:
                        which, away = which[is_open], away[is_open]
                    start = pos[which] - away
                    code = hashes.at(units.first[text[which]] + start, length).view(np.int64)
                    for a in range(0, len(code), 200_000):
                        p = slice(a, a + 200_000)
                        columns = {"code": code[p]}
                        columns |= {"t": key[first + text[which[p]]], "start": start[p]} if only_open else {"open": is_open[p]}
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

        return source.mapInArrow(run, "code bigint, " + ("t bigint, start bigint" if only_open else "open boolean"))

    # Hashing the few texts again costs less than keeping every string.
    twice = common.written(strings(False).groupBy("code").agg(F.count("*").alias("n"), F.max("open").alias("asked")).where("n > 1 AND asked").select("code"), "twice")
    found = common.written(strings(True).join(twice, "code").groupBy("t").agg(F.collect_list("start").alias("found")), "found")
    common.dropped(own, groups, twice)
    return found


def removals(docs: DataFrame, length: int = LENGTH, kind: Kind = BYTES) -> DataFrame:
    """What is cut from each text of (doc_id, text) rows that has repeats: t, n_removed, n_spans (of bytes), kept (bytes).

    t is the hash of the text. A text of several rows that is long enough is cut whole, whether it is listed or not.
    """
    window = kind.window(length)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))
    counts = rows.groupBy("t").agg(F.count("*").alias("count"), F.min("id").alias("id"))  # one row stands for each text
    suffixes = common.written(_suffixes(rows.where(F.octet_length("text") >= length).select("t", "text"), kind, length), "suffixes")
    place = F.xxhash64("t", "pos")
    repeated = suffixes.groupBy("head").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one < other").select("head")
    # Small tables are written before a join by a key that may be hot: only then can adaptive execution split it.
    repeated = common.written(repeated, "repeated")
    live = common.written(suffixes.join(repeated, "head").dropDuplicates(["t", "pos"]), "live")
    common.dropped(suffixes, repeated)
    firsts = live.groupBy("head", "whole").agg(F.min(F.struct("t", "pos")).alias("first"), F.count("*").alias("places"))
    wanted = live.groupBy("t").agg(F.count("*").alias("suffixes")).join(counts, "t").select("t", "id")
    texts = common.written(rows.join(wanted, ["t", "id"]).select("t", "text").dropDuplicates(["t"]), "texts")
    chosen = firsts.select("head", "whole", "first.t", "first.pos").groupBy("t").agg(F.collect_list(F.struct("head", "whole", "pos")).alias("s"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = common.text_bytes(batch.column("text"))
            for a, b in common.chunks(np.diff(offsets), CHUNK_BYTES):
                units = kind.units(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                text, (head, whole, pos) = _entries(batch.column("s").slice(a, b - a))
                begin, end = units.first[text] + pos, (units.first + units.size)[text]
                made = [units.context(x, y) for x, y in zip(begin.tolist(), np.minimum(begin + length + window, end).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(whole), pa.array(made, pa.binary())], names=["head", "whole", "context"])

    contexts = common.written(texts.join(chosen, "t").mapInArrow(cut, "head bigint, whole bigint, context binary"), "contexts")
    longest, in_order = _neighbours(contexts, kind.width)
    shared = common.written(firsts.select("head", "whole", "places").join(longest, ["head", "whole"]), "shared")
    places = live.join(shared, ["head", "whole"]).join(counts.select("t", "count"), "t")
    places = common.written(
        places.withColumn("m", F.when((F.col("places") > 1) | (F.col("count") > 1), F.col("reach")).otherwise(F.col("m"))).select("t", "pos", "near", "far", "head", "m", "count"), "places"
    )
    common.dropped(live, contexts, in_order, shared)
    found = _counted(texts.select("t", "text"), places, kind, length)
    shown = places.where(F.col("m") >= length).groupBy("t").agg(F.collect_list(F.struct("pos", "m")).alias("shown"))
    marks = shown.join(found, "t", "full")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, spans, kept = [], [], []
            for text, s, f in zip(*(batch.column(c).to_pylist() for c in ("text", "shown", "found")), strict=True):
                raw, units = np.frombuffer(text.encode(), np.uint8), _alone(kind, text)
                starts = np.array([x["pos"] for x in s or []] + (f or []), np.int64)
                ends = np.array([x["pos"] + x["m"] for x in s or []] + [x + length for x in f or []], np.int64)
                begin, end = units.cut(*_cover(starts, ends))
                keep = np.ones(len(raw), bool)
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    keep[a:b] = False
                gone.append(int((~keep).sum()))
                spans.append(len(begin))
                kept.append(raw[keep].tobytes())
            arrays = [batch.column("t"), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["t", "n_removed", "n_spans", "kept"])

    cuts = common.written(texts.join(marks, "t").mapInArrow(remove, "t bigint, n_removed bigint, n_spans bigint, kept binary"), "cuts")
    common.dropped(texts, places, found)
    return cuts


def digests(docs: DataFrame, length: int = LENGTH, words: int = PASSAGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage) of each row; texts themselves are not shuffled for it.

    ``n_passage`` has nothing to do with what is removed: it counts the bytes in runs of ``words`` words (between blanks)
    that stand at another place too, however few bytes they have.
    """
    narrow = docs.select("doc_id", "text")
    cuts = removals(narrow, length)
    repeated, copied = windows.windows_elsewhere(narrow, words)
    text = F.coalesce("text", F.lit(""))
    spoken = F.octet_length(F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))).cast("long").alias("spoken")
    rows = narrow.select("doc_id", F.xxhash64(text).alias("t"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"), spoken)
    counts = rows.groupBy("t").agg(F.count("*").alias("count"))
    cut = cuts.select("t", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    all_gone = (F.col("count") > 1) & (F.col("n_bytes") >= length)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    per_text = counts.join(cut, "t", "left").join(windows.covered_bytes(repeated, words), "t", "left").join(copied.withColumn("copied", F.lit(True)), "t", "left")
    return rows.join(common.written(per_text, "per-text"), "t").select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, empty).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(F.col("copied"), F.col("spoken")).otherwise(F.coalesce("n_passage", F.lit(0))).alias("n_passage"),
    )


def deduplicate(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """``docs`` with the remaining text in ``text``, all rows and columns kept; a null text stays null.

    With ``words`` units are words, and runs of so many that stand elsewhere too go, however few bytes they have; a
    character of a script without blanks is a word.
    """
    columns = docs.columns
    t, kept_text, twice_t = (common.unused(docs, n) for n in ("t", "kept", "twice"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    whole = F.regexp_count("text", F.lit(WORD)) >= words if words else F.octet_length("text") >= length
    cuts = removals(docs.select("doc_id", "text"), words, WORDS) if words else removals(docs.select("doc_id", "text"), length)
    twice = docs.select(key.alias(t)).groupBy(t).count().where("count > 1").select(t, F.lit(True).alias(twice_t))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [k.decode(errors="replace") for k in batch.column("kept").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(text, pa.string())], names=[t, kept_text])

    kept = cuts.select("t", "kept").mapInArrow(decode, f"`{t}` bigint, `{kept_text}` string")
    joined = docs.withColumn(t, key).join(common.written(kept.join(twice, t, "full"), "per-text"), t, "left")
    text = F.when(F.col(twice_t) & whole, F.lit("")).otherwise(F.coalesce(kept_text, "text"))
    return joined.withColumn("text", text).select(*(F.col(f"`{c}`") for c in columns))
