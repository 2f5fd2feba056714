"""Token-ID output: texts as ids of a public tokenizer, in shards compressed by Re-Pair grammars.

Documents are range-partitioned by id. A task encodes its slice in order, appends the end id to each document and cuts
the stream into shards at document ends. In each shard the most frequent pairs of neighbouring ids are replaced by new
nonterminals, round after round, until no pair is frequent enough. A shard is one row of a Parquet table: rules,
expansion length of each symbol, the compressed sequence, and the documents with their token counts. Lengths let a
reader find the symbols that a range of tokens touches and expand only those.

Texts are encoded word by word, each distinct word once while a worker's table holds it and many of them in one string,
which gives the same ids as the whole text; a text whose blanks could join across words, or that contains a special token's string, is encoded whole.

Cases: a null text counts as empty and is the end id alone; rows with equal doc_id keep the order of their texts' hash;
null ids come first; equal texts have equal ids; an empty table gives an empty file; a text longer than a shard is
a shard of its own.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm import common

END = 0
BLANK, FIRST, BLANKS = "Ġ", "\0", r" [\s\x0B\x1C-\x1F\x{85}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\p{Z}] "
#: Words in a string that is encoded at once.
TOGETHER = 256
SHARD_TOKENS = 1 << 20
#: A pair is replaced if it occurs so often; pairs replaced in one round, the most frequent ones.
LEAST_COUNT, PER_ROUND = 64, 8192
SCHEMA = "slice int, shard int, tokens bigint, vocabulary int, rules binary, lengths binary, sequence binary, doc_ids array<bigint>, counts array<int>"


class Encoder:
    """The ids of texts by one tokenizer file, with a table of words seen."""

    MOST_WORDS = 250_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids whose bytes begin with a blank: of many words in one string, each begins with such an id and has no other.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[:1] == BLANK]] = True
        self._clear()

    def _clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # a word gets its number when it is looked up
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _singly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w[1:] if w[:1] == FIRST else " " + w for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, from strings of many words: no word has white space at an end, so none joins with the next one."""
        strings = [" " + " ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *got])
        at = np.flatnonzero(self.opens[flat])
        if len(at) != len(words) or len(at) and at[0]:  # a tokenizer that marks blanks in another way
            return self._singly(words)
        return flat, np.diff(at, append=len(flat))

    def _learn(self, words: list[str]) -> None:
        """Ids of words that have their numbers."""
        alone = [w for w in words if w[:1] == FIRST or not w or w[-1].isspace()] if not any(" " in s for s in self.special) else words
        rest = sorted(set(words).difference(alone))
        flat, sizes = (np.concatenate(x) for x in zip(self._together(rest), self._singly(alone), strict=True))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.number) > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        which = np.fromiter(map(self.number.__getitem__, chain(rest, alone)), np.int64, len(words))
        self.begin[which], self.size[which] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(flat)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.number) > self.MOST_WORDS:
            self._clear()
        try:
            return self._encode(texts)
        except BaseException:
            self._clear()  # words may have numbers but no ids
            raise

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        # A blank joins another one only next to white space; a word is its blank and what follows.
        odd = pc.match_substring_regex(texts, BLANKS)
        for part in (FIRST, *self.special):
            odd = pc.or_(odd, pc.match_substring(texts, part))
        odd = odd.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(FIRST), texts.filter(pa.array(~odd)), pa.scalar("")), " ")
        words = lists.flatten().dictionary_encode()
        known = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        if len(self.number) > known:
            self._learn(list(islice(reversed(self.number), len(self.number) - known)))
        own = number[words.indices.to_numpy()]
        begin, size = self.begin[own], self.size[own]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        bound = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])]
        plain = iter(np.split(flat, bound[1:-1]))
        return [np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) if whole else next(plain) for i, whole in enumerate(odd.tolist())]


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker: it outlives a task, as the tokenizer's library module does.

    Functions of this package travel by value, so a global of this module would be new in each task.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_encoders_by_path", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * np.uint32(0x9E3779B1) ^ b) * np.uint32(0x85EBCA6B)
    return (mixed >> np.uint32(12)).astype(np.int32)


def compress(sequence: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule k says what pair the symbol ``vocabulary + k`` stands for."""
    seq, rules = sequence.astype(np.uint32), []
    while len(seq) > 1:  # every round shortens the sequence or ends
        # Count by a hash first; only pairs in the fullest buckets are counted for themselves.
        code = _bucket(seq[:-1], seq[1:])
        full = np.bincount(code, minlength=1 << 20)
        high = full[full >= LEAST_COUNT]
        least = np.partition(high, -PER_ROUND)[-PER_ROUND] if len(high) > PER_ROUND else LEAST_COUNT
        near = np.flatnonzero((full >= least)[code])
        key = seq[near].astype(np.uint64) << np.uint64(32) | seq[near + 1]
        pairs, count = np.unique(key, return_counts=True)
        chosen = np.flatnonzero(count >= LEAST_COUNT)
        if not len(chosen):
            break
        chosen = chosen[np.lexsort((pairs[chosen], -count[chosen]))][:PER_ROUND]
        table = np.sort(pairs[chosen])
        first = vocabulary + len(rules)
        rank = np.minimum(np.searchsorted(table, key), len(table) - 1)
        hit = table[rank] == key
        at, rank = near[hit], rank[hit]
        # Of overlapping pairs in a row every second one stays: the first, the third, ...
        run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) if len(at) else np.zeros(0, int)
        place = np.arange(len(at)) - np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])[run - 1] if len(at) else at
        at, rank = at[place % 2 == 0], rank[place % 2 == 0]
        if not len(at):
            break
        seq[at] = first + rank
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules += [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in table]
    return seq, np.array(rules, np.uint32).reshape(-1, 2)


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Tokens that each nonterminal expands to."""
    out = np.zeros(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = sum(1 if s < vocabulary else int(out[s - vocabulary]) for s in (a, b))
    return out


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The tokens of some symbols; every round opens all nonterminals by one level."""
    while len(seq) and (big := seq >= vocabulary).any():
        size = np.where(big, 2, 1)
        out = np.repeat(seq, size)
        second = np.cumsum(size)[big] - 1
        out[second - 1], out[second] = rules[seq[big] - vocabulary].T
        seq = out
    return seq


def read_range(row, begin: int, end: int) -> np.ndarray:
    """Tokens begin .. end - 1 of one shard, expanding only the symbols they touch."""
    seq, rules = np.frombuffer(row["sequence"], np.uint32), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
    vocabulary, own = row["vocabulary"], np.frombuffer(row["lengths"], np.uint32)
    size = np.ones(len(seq), np.int64)
    big = seq >= vocabulary
    size[big] = own[seq[big] - vocabulary]
    until = np.cumsum(size)
    a, b = np.searchsorted(until, begin, side="right"), np.searchsorted(until, end, side="left")
    before = int(until[a - 1]) if a else 0
    return expand(seq[a : b + 1], rules, vocabulary)[begin - before : end - before]


def _shard(slice_no: int, number: int, ids: list, parts: list[np.ndarray], vocabulary: int) -> pa.RecordBatch:
    stream = np.concatenate(parts)
    seq, rules = compress(stream, vocabulary)
    row = {
        "slice": slice_no, "shard": number, "tokens": len(stream), "vocabulary": vocabulary, "rules": rules.tobytes(),
        "lengths": lengths_of(rules, vocabulary).tobytes(), "sequence": seq.tobytes(), "doc_ids": ids, "counts": [len(p) for p in parts],
    }
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode (doc_id, text) and write the shards below ``path``, in ascending doc_id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    slices = common.tasks(docs)
    dealt = rows.repartitionByRange(slices, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt = dealt.withColumn("slice", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, parts, held, number, slice_no = None, [], [], 0, 0, 0
        end = np.array([END], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(tokenizer)
            vocabulary = encoder.tokenizer.get_vocab_size()
            slice_no = batch.column("slice")[0].as_py()
            keys = batch.column("doc_id").to_pylist()
            for at in range(0, len(keys), 512):
                for key, own in zip(keys[at : at + 512], encoder.encode(batch.column("text")[at : at + 512]), strict=True):
                    ids.append(key)
                    parts.append(np.concatenate([own, end]))
                    held += len(own) + 1
                    if held >= SHARD_TOKENS:
                        yield _shard(slice_no, number, ids, parts, vocabulary)
                        ids, parts, held, number = [], [], 0, number + 1
        if parts:
            yield _shard(slice_no, number, ids, parts, vocabulary)

    dealt.mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files, decoded."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    sizes = shards.select("slice", "shard", "tokens")
    # Tokens before a shard: of earlier slices, and of earlier shards of its slice.
    slices = sizes.groupBy("slice").agg(F.sum("tokens").alias("all")).selectExpr("slice", "sum(all) OVER (ORDER BY slice) - all AS before_slice")
    within = sizes.selectExpr("slice", "shard", "sum(tokens) OVER (PARTITION BY slice ORDER BY shard) - tokens AS before_shard")
    offset = within.join(slices, "slice").select("slice", "shard", (F.col("before_slice") + F.col("before_shard")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = expand(np.frombuffer(row["sequence"], np.uint32), np.frombuffer(row["rules"], np.uint32).reshape(-1, 2), row["vocabulary"])
                count = np.array(row["counts"], np.int64)
                bound = np.concatenate([[0], np.cumsum(count)])
                for a in range(0, len(count), 500):
                    b = min(a + 500, len(count))
                    part = ids[bound[a] : bound[b]].astype(np.int32)
                    flat = pa.ListArray.from_arrays(pa.array((bound[a : b + 1] - bound[a]).astype(np.int32)), pa.array(part))
                    arrays = [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(bound[a:b] + row["offset"]), pa.array(count[a:b]), flat]
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])

    return shards.join(offset, ["slice", "shard"]).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def checksums(decoded: DataFrame) -> DataFrame:
    """The ids of each document as the CRC of their little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, bound = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy() - ids.offsets[0].as_py() if len(ids) else [0]
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bound[:-1], bound[1:], strict=True)]
            arrays = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return decoded.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
