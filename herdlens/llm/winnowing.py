"""Document fingerprints by winnowing, in DataFrame functions only.

A text becomes tokens (runs of up to four letters, marks or digits, and single other characters that are no blank);
a k-gram is the last ``K`` tokens at a position, the first ones having less. Of each window of ``W`` k-grams the
smallest hash is kept, the rightmost of equal ones, with its position. So any two texts that share a run of
``K + W - 1`` tokens share a kept hash. Likeness is the Jaccard similarity of two sets of kept hashes.

Cases: a null text counts as empty; a text without tokens keeps nothing, is like another such text by 1 and like any
other by 0; a text with fewer than ``W`` k-grams is one window; equal texts have equal fingerprints; repeated ids are
ordered by the hash of their text; null ids come last; an only document follows itself; an empty table gives an
empty result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from herdlens.llm.common import tasks

K, W = 3, 4
TOKEN = r"[\p{L}\p{M}\p{N}]{1,4}|[^\p{L}\p{M}\p{N}\s]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kept(g: Column, x: Column, j: Column, w: int) -> Column:
    """Whether x = g[j] is the rightmost minimum of some full window; a window beyond an end compares with null."""
    windows = []
    for before in range(w):
        tests = [F.get(g, j - a) >= x for a in range(1, before + 1)] + [F.get(g, j + b) > x for b in range(1, w - before)]
        windows.append(reduce(lambda p, q: p & q, tests))
    return reduce(lambda p, q: p | q, windows)


def marks(text: Column, k: int = K, w: int = W) -> Column:
    """The kept k-grams of a text, ``array<struct<pos: int, hash: bigint>>`` in order of position."""

    def grams(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(*(F.get(h, i - a) for a in range(k - 1, 0, -1)), x))

    def pick(g: Column) -> Column:
        found = F.transform(g, lambda x, j: F.when(_kept(g, x, j, w), F.struct(j.alias("pos"), x.alias("hash"))))
        least = F.array_min(F.transform(g, lambda x, j: F.struct(x.alias("hash"), (-j).alias("back"))))
        alone = F.array(F.struct((-least["back"]).alias("pos"), least["hash"].alias("hash")))
        none = F.filter(alone, lambda m: F.lit(False))
        short = F.when(F.size(g) == 0, none).otherwise(alone)
        return F.when(F.size(g) < w, short).otherwise(F.filter(found, lambda m: m.isNotNull()))

    hashes = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    return _let(hashes, lambda h: _let(grams(h), pick))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def digest(hashes: Column) -> Column:
    """One string for a whole sequence of kept hashes."""
    return F.concat(F.lpad(F.hex(F.xxhash64(hashes)), 16, "0"), F.lpad(F.hex(F.hash(hashes)), 16, "0"))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``marks`` and ``fingerprint``; narrow."""
    made = docs.withColumn("marks", marks(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    return made.withColumn("fingerprint", digest(F.col("marks")["hash"]))


def _ranges(keyed: DataFrame, count: int) -> Column:
    """Ranges of (doc_id, tie) with about as many rows each, numbered upwards from the null ids.

    Ids are cut at mergeable quantiles. An id that is several quantiles has a range of its own, which is cut again into
    so many ranges of the tie, a hash; null ids are cut by the tie alone, as their share of the rows asks.
    """
    quantiles = F.percentile_approx("doc_id", [i / count for i in range(1, count)], 20 * count)
    found, nulls, rows = keyed.agg(quantiles, F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    times = Counter(found or [])
    parts = {c: n for c, n in times.items() if n > 1}
    cuts = sorted({*times, *(c + 1 for c in parts if c < (1 << 63) - 1)})
    sizes = [1 + count * nulls // max(1, rows), 1, *(parts.get(c, 1) for c in cuts)]
    bases = [0, *accumulate(sizes)]
    table, size, base = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (cuts, sizes, bases))

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.shiftright(low + high, 1)
        left, right = F.struct(low.alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), high.alias("high"))
        return F.when(low >= high, state).when(F.get(table, middle) <= F.col("doc_id"), right).otherwise(left)

    # The number of cuts not above the id, by bisection: there are about as many cuts as tasks.
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    at = F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, halve, lambda state: state["low"])
    slot = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at + 1)
    upper = F.shiftright("tie", 32) + F.lit(1 << 31)
    return (F.get(base, slot) + F.shiftright(upper * F.get(size, slot), 32)).cast("int")


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(doc_id, text) rows in ranges of ids and ties, each range with a copy of the row that follows it (``edge``).

    Rows go down in id, and after the last comes the first. Texts are shuffled once; the driver sees one id for
    each range, and the ranges follow the shuffle partitions, not the rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    keyed = keyed.withColumn("range", _ranges(keyed, 8 * tasks(docs)))
    tops = keyed.groupBy("range").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), "tie", "doc_id")).alias("t")).collect()
    tops = sorted(tops, key=lambda r: -r["range"])
    follows = [(tops[n]["range"], tops[(n + 1) % len(tops)]["t"]) for n in range(len(tops))]
    schema = "to int, id bigint, tie bigint"
    values = [(int(to), t["doc_id"], t["tie"]) for to, t in follows]
    small = spark.createDataFrame(values, schema).withColumnRenamed("tie", "t")
    first = keyed.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("t")))
    edges = first.select("doc_id", "text", "tie", F.col("to").alias("range"), F.lit(True).alias("edge"))
    edges = edges.dropDuplicates(["range"])  # rows that repeat an id and a text
    every = keyed.withColumn("edge", F.lit(False)).unionByName(edges)
    return every, Window.partitionBy("range").orderBy("edge", F.desc_nulls_last("doc_id"), F.desc("tie"))


def edited(text: Column, following: Column) -> Column:
    """The last third of the code points replaced by as many of the next text's first."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text and the next document."""
    every, down = with_next(docs)
    paired = every.withColumn("edited", edited(F.col("text"), F.lead("text").over(down)))
    own = paired.select(
        "doc_id", "tie", "range", "edge", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        marks(F.col("text"))["hash"].alias("own"), marks(F.col("edited"))["hash"].alias("other"),
    )
    sets = own.withColumns({"fingerprint": digest(F.col("own")), "edited_fingerprint": digest(F.col("other"))}).withColumns(
        {"own": F.array_distinct("own"), "other": F.array_distinct("other")}
    )
    return (
        sets.withColumn("following", F.lead("own").over(down))
        .where(~F.col("edge"))
        .select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"),
            F.size("own").alias("n_marks"),
        )
    )
