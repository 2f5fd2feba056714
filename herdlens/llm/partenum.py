"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct word shingles. Two texts link when their sets' Jaccard similarity reaches ``percent``.
Sets fall into bands of sizes ``(upper * percent / 100, upper]``; a linked pair lies in one band or in two adjacent
ones, and each set signs for its own band and the one below. Within a band, linked sets differ in at most
``k = upper * (100 - percent) / percent`` shingles. The shingle domain is cut into more than k / 2 parts, so at least one
part holds at most one difference, and each part into three sub-parts, of which one at most is spoiled then: of the
enumerated subsets of two sub-parts one at least is the same in both sets, and its hash is a shared signature. With
``r`` further parts there are r + 1 such parts. A set leaves out its empty subsets, which too many sets share, if at most
r of its parts have any: of r + 1 parts one remains. Where k is 1 or 2, all subsets of the whole
set that lack so many shingles are enumerated instead.

Texts with equal sets are one vertex. Vertices that share signatures form clusters; each is compared with its cluster's
pivot, the vertex that shares most. Of the others, two can only link if their differences from the pivot have enough
in common, so a prefix of either difference finds the pairs to verify; pairs of one component need no comparison. Where
such prefixes would give many pairs, those that meet by them form clusters with pivots of their own first. A signature that is very frequent is found in a sample first and spread over all tasks. Links stay in
tables; components are contracted there.

Cases: extra columns may have any name and stay as they are; null and empty texts, and texts without words, have an empty set, size 0 and are their own component; shorter
texts than the shingle width have one shingle, their whole sequence; rows that repeat a doc_id link each by its own
text; a null doc_id has a null component unless its text links it to others, whom it may link to each other; an empty
table gives an empty result. Keys of sets, shingles and rows are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from herdlens.llm import common, shingles
from herdlens.llm.components import components

#: Sub-parts of a part; a signature has all but one of them.
SUBPARTS = 3
#: Counters in which all shingles of compared texts are counted, as a measure of how common one is.
COUNTERS = 1 << 19
#: Where keys by which vertices meet give more pairs a row, those vertices get pivots of their own.
PAIRS_A_ROW = 32


def row_key() -> Column:
    """What tells rows of (doc_id, text) apart; a null text is an empty one."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _keys(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, vertex, row): the vertex is the hash of the whole set, the row that of doc_id and text."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for begin, n, own, value in shingles.sets(batch.column("text"), width):
                size[begin : begin + n], key[begin : begin + n] = _sizes_and_keys(n, own, value)
            made = [batch.column("doc_id"), pa.array(size), pa.array(key), batch.column("row")]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_shingles", "vertex", "row"])

    return source.mapInArrow(run, "doc_id bigint, n_shingles bigint, vertex bigint, row bigint")


def _sizes_and_keys(n: int, own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(own, minlength=n)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles.mix(value), dtype=np.uint64)])
    end = np.cumsum(size)
    return size, shingles.mix((running[end] - running[end - size]) ^ size.astype(np.uint64)).view(np.int64)


def bands(percent: int, most: int) -> np.ndarray:
    """Upper sizes of the bands, from 1 on, until one covers ``most``."""
    upper, out = 1, [1]
    while upper < most:
        upper = max(upper + 1, upper * 100 // percent)
        out.append(upper)
    return np.array(out, np.int64)


def parts_of(upper: np.ndarray, slack: np.ndarray, percent: int) -> np.ndarray:
    """Parts of the domain in a band: so many that one has at most one difference, and as many again as will have an empty subset."""
    lower, need = np.maximum(1, upper * percent // 100), slack // 2 + 1
    count = need.copy()
    for _ in range(8):
        mean = lower * (SUBPARTS - 1) / (count * SUBPARTS)
        count = np.minimum(need + (1.25 * SUBPARTS * count * np.exp(-mean)).astype(np.int64) + 1, 2 * need)
    return count


def signatures(size: np.ndarray, own: np.ndarray, value: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows of the sets of one chunk."""
    limits = bands(percent, int(size.max(initial=1)))
    slacks = limits * (100 - percent) // percent
    counts = parts_of(limits, slacks, percent)
    # Where few differences are possible all subsets without so many shingles are listed instead.
    listed = (slacks == 1) | ((slacks == 2) & (limits <= 20))
    band = np.searchsorted(limits, size)
    mixed = shingles.mix(value + np.uint64(0x632BE59BD9B4E019))
    spread = shingles.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(20)
    first = np.cumsum(size) - size
    texts, signs = [], []
    for below in (0, 1):
        label = band - below
        known = (label >= 0) & (size > 0)
        at = np.maximum(label, 0)
        for i in np.flatnonzero(known & listed[at]).tolist():
            found = _subsets(mixed[first[i] : first[i] + size[i]], int(slacks[at[i]]))
            texts.append(np.full(len(found), i))
            signs.append(shingles.mix(found ^ np.uint64(label[i] + 1)).view(np.int64))
        n = np.where(known & ~listed[at] & (slacks[at] > 0), counts[at], 0)  # without slack only equal sets link
        base = np.cumsum(n) - n
        use = n[own] > 0
        o = own[use]
        cell = SUBPARTS * base[o] + (spread[use] % np.maximum(1, SUBPARTS * n[o]).astype(np.uint64)).astype(np.int64)
        total, m = SUBPARTS * int(n.sum()), mixed[use]
        low = np.bincount(cell, (m & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
        high = np.bincount(cell, (m >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
        summed = shingles.mix(low + (high << np.uint64(32)) + high).reshape(-1, SUBPARTS)
        held = np.bincount(cell, minlength=total).reshape(-1, SUBPARTS)
        # All subsets of a part's sub-parts that lack one.
        held = held.sum(axis=1, keepdims=True) - held
        sign = summed.sum(axis=1, keepdims=True, dtype=np.uint64) - summed
        owner = np.repeat(np.arange(len(size)), n)
        within = np.arange(len(owner)) - base[owner]
        place = (within[:, None] * SUBPARTS + np.arange(SUBPARTS)) * 131071 + label[owner][:, None]
        sign = shingles.mix(shingles.mix(sign) ^ shingles.mix(place.astype(np.uint64)))
        # A linked pair has more parts with at most one difference than a set has parts with empty subsets, unless it
        # has very many.
        bare = held == 0
        poor = np.bincount(owner, bare.any(axis=1), len(size))
        keep = ~bare | (poor[owner] > (n - slacks[at] // 2 - 1)[owner])[:, None]
        texts.append(np.repeat(owner, keep.sum(axis=1)))
        signs.append(sign[keep].view(np.int64))
    return np.concatenate(texts), np.concatenate(signs)


def _subsets(mixed: np.ndarray, slack: int) -> np.ndarray:
    """Sums of all subsets that lack at most ``slack`` (1 or 2) shingles."""
    whole = mixed.sum(dtype=np.uint64)
    out = [whole[None], whole - mixed]
    if slack == 2:
        i, j = np.triu_indices(len(mixed), 1)
        out.append(whole - mixed[i] - mixed[j])
    return np.unique(np.concatenate(out))


def _signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sign, vertex) rows of all texts."""
    source = docs.select(F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, n, own, value in shingles.sets(batch.column("text"), width):
                size, key = _sizes_and_keys(n, own, value)
                text, sign = signatures(size, own, value, percent)
                for at in range(0, len(sign), 200_000):
                    part = slice(at, at + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(sign[part]), pa.array(key[text[part]])], names=["sign", "vertex"])

    return source.mapInArrow(run, "sign bigint, vertex bigint")


def _members(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Distinct (sign, vertex) rows of signatures that at least two vertices share."""
    spark, one_in = docs.sparkSession, 64
    signed = _signed(docs, width, percent)
    # A signature with more than a twentieth of a task's share of rows: at most 20 * tasks of them, known from a sample.
    sample = _signed(docs.where(F.pmod(row_key(), F.lit(one_in)) == 0), width, percent)
    counts = common.written(sample.groupBy("sign").count(), "frequent")
    total = counts.agg(F.sum("count")).first()[0] or 0
    least = max(16, total // (20 * common.tasks(docs)))
    frequent = spark.createDataFrame([(r["sign"],) for r in counts.where(F.col("count") >= least).collect()], "sign bigint")
    spread = signed.join(F.broadcast(frequent), "sign").distinct()
    rest = signed.join(F.broadcast(frequent), "sign", "left_anti")
    low, high = F.expr("min(vertex) OVER (PARTITION BY sign)"), F.expr("max(vertex) OVER (PARTITION BY sign)")
    shared = rest.select("sign", "vertex", low.alias("low"), high.alias("high")).where("low < high").select("sign", "vertex").distinct()
    members = common.written(shared.union(spread), "members")
    common.dropped(counts)
    return members


def _commonness(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all texts fall on each counter, from 0 to 255 on a logarithmic scale.

    It orders shingles, rare ones first, and nothing depends on it but the number of pairs to verify. A task counts
    into one array, and arrays are added in slices, so that neither tasks nor the driver hold more than COUNTERS numbers.
    """
    slices = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, _, value in shingles.sets(batch.column("text"), width):
                total += np.bincount((value >> np.uint64(45)).astype(np.int64), minlength=COUNTERS)
        cut = np.minimum(total, 65_535).astype("<u2").reshape(slices, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices)), pa.array([c.tobytes() for c in cut], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = 0, np.zeros(COUNTERS // slices, np.int64)
        for batch in batches:
            for number, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total += np.frombuffer(counts, "<u2")
        scaled = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([scaled.tobytes()], pa.binary())], names=["slice", "scaled"])

    parts = texts.select("text").mapInArrow(count, "slice bigint, counts binary")
    rows = parts.groupBy("slice").applyInArrow(add, "slice bigint, scaled binary").collect()  # COUNTERS bytes
    out = np.zeros((slices, COUNTERS // slices), np.uint8)
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["scaled"], np.uint8)
    return out.ravel()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("vertex").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("vertex").alias("b"), F.col("text").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) pairs of vertices whose sets are similar enough, counted exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(_sets(batch.column("x"), width), _sets(batch.column("y"), width), strict=True)
            keep = pa.array([_linked(x, y, percent) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return _with_texts(pairs, texts).mapInArrow(run, "a bigint, b bigint")


def _against_pivot(pairs: DataFrame, texts: DataFrame, width: int, percent: int, commonness: np.ndarray) -> DataFrame:
    """Each vertex a against its pivot b: linked, distance, slack, and the first shingles of their difference.

    ``slack`` bounds the distance of the vertex from anything it links with. Differences are ordered by whether the
    pivot has the shingle (what it lacks comes first, being rarer); what it lacks by how common it is in all texts, rare
    ones first, and what it has the other way round, as few texts lack a common shingle; then by hash. That is one order
    for all its vertices, in which what many of them share comes last.
    """

    def ordered(values: np.ndarray, rare_first: bool) -> np.ndarray:
        common_ = commonness[(values >> np.uint64(45)).astype(np.int64)].astype(np.int64)
        return values[np.lexsort((values, common_ if rare_first else -common_))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, distance, slack, first = [], [], [], []
            for x, y in zip(_sets(batch.column("x"), width), _sets(batch.column("y"), width), strict=True):
                added, lacking = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                linked.append(_linked(x, y, percent))
                distance.append(len(added) + len(lacking))
                slack.append(len(x) * (100 - percent) // percent)
                first.append(np.concatenate([ordered(added, True), ordered(lacking, False)])[: slack[-1] + 1].view(np.int64))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            made = [pa.array(v, k) for v, k in zip((linked, distance, slack, first), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *made], names=["a", "b", "linked", "distance", "slack", "first"])

    return _with_texts(pairs, texts).mapInArrow(run, "a bigint, b bigint, linked boolean, distance bigint, slack bigint, first array<bigint>")


#: The columns by which vertices of one pivot meet.
KEYS = ["b", "kind", "element"]


def _met(compared: DataFrame, places: DataFrame) -> DataFrame:
    """(b, kind, element, a, distance, slack, place, root) rows by which vertices of one pivot, but of several roots, meet.

    Linked a and b with distances p <= q from the pivot have differences with at least (p + q - slack) / 2 shingles in
    common. So they share one of the first slack / 2 + 1 of a's and the first slack + 1 of b's, or need none in common. The
    first that they share has place i of a's and j of b's, and no more than p - i and q - j follow from there, so that
    2 i <= slack + p - q and 2 j <= slack + q - p.
    """
    # Without a common shingle only the nearest fit: of vertices linked with the pivot those near enough to one that is not.
    apart = compared.where("NOT linked").groupBy("b").agg(F.min("distance").alias("apart"))
    close = compared.where("distance <= slack").join(apart, "b").where("NOT linked OR distance + apart <= slack")
    none = close.select("b", F.lit(True).alias("kind"), F.lit(0).cast("bigint").alias("element"), "a", "distance", "slack", F.lit(0).alias("place"))
    own = compared.select("b", F.lit(False).alias("kind"), "a", "distance", "slack", F.posexplode("first").alias("place", "element"))
    rooted = own.select(*none.columns).union(none).join(places.withColumnRenamed("vertex", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    several = rooted.groupBy(*KEYS).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.expr("2 * place - slack")).alias("near"))
    return common.written(rooted.join(several.where("low < high AND near <= 0").select(*KEYS), KEYS), "met")


def _candidates(met: DataFrame) -> DataFrame:
    """(a, b) pairs of vertices that meet, may be linked, and are not known to be of one component."""
    near = met.where("2 * place <= slack").select(*KEYS, F.col("a").alias("u"), F.col("root").alias("ru"), F.col("distance").alias("du"), F.col("slack").alias("su"), F.col("place").alias("i"))
    far = met.select(*KEYS, F.col("a").alias("v"), F.col("root").alias("rv"), F.col("distance").alias("dv"), F.col("slack").alias("sv"), F.col("place").alias("j"))
    fits = (
        "ru <> rv AND (du < dv OR du = dv AND u < v) AND dv - du <= least(su, sv) AND (NOT kind OR du + dv <= least(su, sv))"
        " AND 2 * i <= least(su, sv) + du - dv AND 2 * j <= least(su, sv) + dv - du"
    )
    return near.join(far, KEYS).where(fits).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def _shares(members: DataFrame) -> DataFrame:
    """(vertex, shares): how many signatures a vertex shares, each counted as often as vertices have it."""
    groups = members.groupBy("sign").agg(F.count("*").alias("shared"))
    return members.join(groups, "sign").groupBy("vertex").agg(F.sum("shared").alias("shares"))


def _pivots(members: DataFrame, shares: DataFrame) -> DataFrame:
    """(a, b) of each vertex a and its pivot b: (sign, vertex) rows make clusters, each around the vertex that shares most."""
    lowest = members.groupBy("sign").agg(F.min("vertex").alias("b"))
    clusters = components(members.join(lowest, "sign").where("vertex <> b").select(F.col("vertex").alias("a"), "b"))
    pivots = clusters.join(shares, "vertex").groupBy("root").agg(F.max(F.struct("shares", "vertex")).alias("pivot")).select("root", F.col("pivot.vertex").alias("b"))
    made = common.written(clusters.join(pivots, "root").where("vertex <> b").select(F.col("vertex").alias("a"), "b"), "pivots")
    common.dropped(clusters)
    return made


def _contracted(pairs: DataFrame, shares: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(vertex, root) of linked vertices, given each vertex and its pivot.

    A chain of shared signatures may run through many texts that have little to do with its pivot, and a group of near
    copies among them would meet in all its pairs. So those that meet form clusters with pivots of their own, as long
    as that spares half of the pairs; what is left is compared in full.
    """
    commonness, made, last = _commonness(texts, width), [], None
    while True:
        made.append(common.written(_against_pivot(pairs, texts, width, percent, commonness), "compared"))
        links = reduce(DataFrame.union, made).where("linked").select("a", "b")
        places = components(links)
        met = _met(made[-1], places)
        sizes = met.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.count(F.when(F.expr("2 * place <= slack"), 1)).alias("near"))
        rows, most = sizes.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("near"))).first()
        if last is not None and most > last:  # the pivots before were better ones
            common.dropped(met)
            met = _met(made[-2], places)
        if not rows or most <= PAIRS_A_ROW * rows or last is not None and 2 * most > last:
            break
        last = most
        pairs = _pivots(met.select(F.xxhash64(*KEYS).alias("sign"), F.col("a").alias("vertex")), shares)
        common.dropped(met, places)
    more = common.written(_verified(_candidates(met), texts, width, percent), "links")
    if not more.isEmpty():
        common.dropped(places)
        places = components(links.union(more))
    common.dropped(met, more, *made)
    return places


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, n, own, value in shingles.sets(texts, width):
        out += np.split(value, np.searchsorted(own, np.arange(1, n)))
    return out


def _placed(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, vertex, row) of each row, (vertex, first_id, row) of each vertex, (vertex, root) of linked ones."""
    keys = common.written(_keys(docs, width), "keys")
    classes = keys.where("n_shingles > 0").groupBy("vertex").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("row"))
    members = _members(docs, width, percent)
    common.swept(docs.sparkSession)
    # One text of each vertex that shares a signature, found by its row: an id may be null or have other texts too.
    chosen = members.select("vertex").distinct().join(classes, "vertex").select("vertex", "row")
    rows = docs.where("text IS NOT NULL").select(row_key().alias("row"), "text")
    texts = common.written(rows.join(chosen, "row").select("vertex", "text").dropDuplicates(["vertex"]), "texts")
    shares = common.written(_shares(members), "shares")
    pairs = _pivots(members, shares)
    common.dropped(members)
    places = _contracted(pairs, shares, texts, width, percent)
    common.dropped(texts, shares, pairs)
    return keys, classes, places


def join(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, the smallest doc_id reachable by links."""
    keys, classes, places = _placed(docs, width, percent)
    named = places.join(classes, "vertex").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_vertex = classes.join(places, "vertex", "left").join(named, "root", "left").select("vertex", F.coalesce("component_id", "first_id").alias("component_id"))
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    return keys.join(of_vertex, "vertex", "left").select("doc_id", "n_shingles", own)


def drop_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null is the largest), then of the least hash.

    Ids do not matter otherwise: each row goes or stays by its own text. Rows without words all stay. Of rows that
    agree in doc_id and text any one stays.
    """
    keys, _, places = _placed(docs.select("doc_id", "text"), width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = keys.where("n_shingles > 0").groupBy("vertex").agg(F.min(order).alias("first"))
    rooted = common.written(first.join(places, "vertex", "left").select("vertex", "first", F.coalesce("root", "vertex").alias("root")), "rooted")
    best = common.written(rooted.groupBy("root").agg(F.min("first").alias("best")).select("root", F.col("best.row").alias("row")), "best")
    mark, stays = common.unused(docs, "row"), common.unused(docs, "stays")
    rows = keys.where("n_shingles > 0").groupBy(F.col("row").alias(mark)).agg(F.count("*").alias("times"))
    counted = rows.join(best.select(F.col("row").alias(mark), F.lit(True).alias(stays)), mark, "left")
    # Few rows as a rule: those that go, and those that stay once though they occur more often.
    moved = common.written(counted.where(F.col(stays).isNull() | (F.col("times") > 1)).select(mark, stays), "copies")
    twice = common.written(moved.where(stays).select(mark), "twice")
    common.dropped(rooted, best)
    own = docs.withColumn(mark, row_key())
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = own.join(twice, mark).groupBy(mark).agg(F.first(F.struct(*columns)).alias("one")).select("one.*")
    return own.join(moved.select(mark), mark, "left_anti").select(*columns).union(one)
