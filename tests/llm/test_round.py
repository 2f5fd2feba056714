"""Fill-in-middle, whitening and substring dedup against brute force: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from herdlens.llm import common, decontaminate, language, middle, partenum, pieces, queries, suffixes, tokens, toxicity, whitening, windows, winnowing
from tests.llm.test_operators import prose

SCHEMA = "doc_id bigint, text string, lang string, n string, form string, __t__ int, x int, code int"


def rows_of(texts, ids=None):
    return [(i if ids is None else ids[k], t, "en", "kept?", "clash", 1, 2, 3) for k, (i, t) in enumerate(enumerate(texts))]


def sha(text) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle -----------------------------------------------------------------------------------


def fim_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


FIM_TEXTS = [None, "", "a", "é", "𝒳", "<", "<P", "a <P> b", "x<S>", "<M>", "S>", "<<<>>>", "ab12ÄÖ日本語 text\n\ttail", "ünï çødé 日本語 𝒳𝒴 text " * 40,
             "x" * 50_000, "日" * 9_000, prose(5, 30_000), "\u0000nul", "KKelvin ſ long s", "P><S", "é" * 30, "🎉<" * 200]


def test_fim_cuts_and_reads_back_as_by_hand(spark):
    texts = [t for _ in range(8) for t in FIM_TEXTS]
    ids = [None if i % 17 == 5 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(3)
    got = middle.rearrange(df).withColumn("back", middle.original("output", "form")).collect()
    assert len(got) == len(texts) and {r["__t__"] for r in got} == {1} and {r.lang for r in got} == {"en"}
    seen = set()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
        seen.add(r.form)
    assert seen == {"plain", "psm", "spm"}
    assert middle.rearrange(df.limit(0)).count() == 0


def test_the_exception_index_converts_both_ways():
    text = "aé日b𝒳c" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    index = middle.Exceptions(raw)
    place = np.cumsum([0] + [len(c.encode()) for c in text])
    assert index.to_chars(place).tolist() == list(range(len(text) + 1))
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == place.tolist()
    assert len(index.place) == 3 * 50


# --- whitening ----------------------------------------------------------------------------------------


def spread(n, d, seed=0):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(n, d)) @ np.diag(np.linspace(2, 0.1, d)) @ draw.normal(size=(d, d)) + 3


VECTORS = "vec_id bigint, embedding array<double>, x string, n int"


def whitened_by_hand(vectors):
    x = np.floor(256 * np.array(vectors))
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    cov = (fit - mean).T @ (fit - mean) / len(fit)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:4], basis[:, ::-1][:, :4]
    return fit, (x - mean) @ basis / np.sqrt(values), values / np.trace(cov), x


def test_whitening_agrees_with_a_dense_solver(spark):
    v = spread(300, 12).tolist()
    v += v[:40] + [v[0]] * 60
    bad = [None, [], [1.0] * 3, [float("nan")] + [0.0] * 11, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [1e300] + [0.0] * 11]
    rows = [(i, e, "clash", 7) for i, e in enumerate(v)] + [(None, e, "bad", 7) for e in bad]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    fit, white, explained, x = whitened_by_hand(v)
    n, sums = len(fit), fit.sum(axis=0).astype(int)
    assert len(got) == 4 * len(v) and {r.n for r in got} == {n} and {r.identity_error < 1e-9 for r in got} == {True}
    mine = np.zeros((len(v), 4))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-10)
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
    sign = np.sign((mine * white).sum(axis=0))
    assert np.allclose(mine * sign, white, atol=1e-9)


def test_whitening_of_few_equal_and_no_vectors(spark):
    frame = lambda v: spark.createDataFrame([(i, e, "", 0) for i, e in enumerate(v)], VECTORS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([None, []])).count() == 0
    assert whitening.whiten(frame([[1.0, 2.0]] * 5)).count() == 0
    got = whitening.whiten(frame([[1.0, 2.0], [3.0, 2.0], [3.0, 2.0]])).collect()
    assert [(r.component, abs(r.whitened), r.explained) for r in got] == [(1, pytest.approx(1.0), pytest.approx(1.0))] * 3
    # Two lengths equally frequent: the longer one; entries whose squares leave a long have no deviation.
    got = whitening.whiten(frame([[1.0], [2.0], [1e15, 0.0], [0.0, 1e15]])).collect()
    assert {r.vec_id for r in got} == {2, 3} and {r.deviation for r in got} == {None}


def test_leading_eigenvectors_of_clusters_and_split_matrices():
    draw = np.random.default_rng(3)
    q, _ = np.linalg.qr(draw.normal(size=(40, 40)))
    for values in (np.r_[5, 5, 5, 5 - 1e-13, np.linspace(1, 0, 36)], np.r_[9, 1e-3, 1e-6, 1e-9, np.zeros(36)], np.ones(40), np.arange(40, 0, -1)):
        for a in (q @ np.diag(values) @ q.T, np.diag(values.astype(float))):
            a = (a + a.T) / 2
            found, vectors = whitening.leading(a, 4)
            want = np.linalg.eigvalsh(a)[::-1][: len(found)]
            assert np.allclose(found, want, rtol=0, atol=1e-13 * np.abs(values).max())
            assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
            assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-12 * np.abs(values).max()


# --- substring dedup ----------------------------------------------------------------------------------


def removed_by_hand(rows, words):
    large = float("inf")
    split = [(large if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = defaultdict(lambda: large + 1)
    for i, w in split:
        for p in range(len(w) - words + 1):
            key = tuple(w[p : p + words])
            least[key] = min(least[key], i)
    out = []
    for i, w in split:
        gone = set()
        for p in range(len(w) - words + 1):
            if least[tuple(w[p : p + words])] < i:
                gone |= set(range(p, p + words))
        out.append((len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


@pytest.mark.parametrize(("words", "halvings"), [(50, 1), (50, 2), (7, 1), (1, 1)])
def test_substring_dedup_equals_brute_force(spark, words, halvings):
    passage, base = prose(3, 90), prose(1, 160)
    edited = base.split()
    edited[80] = "edited"
    texts = [base, base, " ".join(edited), base.upper(), None, "", " \t\n", "one", "one", base.replace(" ", "\n\x0b "), "ünï çødé 日本語 text " * 30]
    texts += [f"{prose(10 + i, 30)} {passage} {prose(40 + i, 20)} {passage[:200]}" for i in range(5)]
    texts += ["ab " * 400, "ab " * 60, "x" * 300_000, prose(7, 20_000), prose(7, 20_000) + " more", prose(8, 49), prose(8, 50), prose(8, 51), "a b " * 80, "a b " * 80]
    texts += [base, passage, passage, prose(9, 70), prose(9, 70), prose(11, 70), prose(11, 70)]
    ids = [100 - k for k in range(len(texts))]
    ids[-7:] = [None, None, 5, 7, 7, None, None]
    df = spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(4)
    got = sorted((r.n_words, r.n_removed, r.kept_sha256, r.doc_id or 0) for r in windows.digests(df, words, halvings).collect())
    want = sorted((*r, i or 0) for r, i in zip(removed_by_hand(list(zip(ids, texts, strict=True)), words), ids, strict=True))
    assert got == want


def test_substring_dedup_keeps_texts_and_empty_tables(spark):
    df = spark.createDataFrame(rows_of([prose(1, 60), prose(1, 60), "  few words "]), SCHEMA)
    got = {r.doc_id: r for r in windows.deduplicate(df).collect()}
    assert got[0].text == prose(1, 60) and (got[1].text, got[1].n_removed) == ("", 60) and got[2].text == "  few words "
    assert windows.digests(df.limit(0)).count() == 0 and windows.deduplicate(df.where(F.col("doc_id") > 9)).count() == 0


@pytest.mark.parametrize("words", [51, 9])
def test_passages_of_few_bytes_show_in_their_own_column(spark, words):
    short, passage = "a b c d e f g h i j " * 6, prose(3, 60)
    texts = [f"{prose(1, 40)} {short}{prose(2, 9)}", f"{short} z", f"{prose(4, 30)} {passage}", f" {passage}  {prose(5, 20)}\n", prose(6, 70), prose(6, 70), None, "", prose(8, 49) + " x y", "few", "few"]
    texts += [f"{prose(9, 51)} q {prose(9, 51)}", "x" * 500, f"  {prose(12, 55)} ", f"  {prose(12, 55)} "]
    df = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = {r.doc_id: r for r in suffixes.digests(df, 400, words).collect()}
    spans = [[m.span() for m in re.finditer("[^\x20\x09-\x0d]+", t or "")] for t in texts]
    seen = defaultdict(int)
    for t, s in zip(texts, spans, strict=True):
        for p in range(len(s) - words + 1):
            seen[tuple(t[a:b] for a, b in s[p : p + words])] += 1
    for i, (t, s) in enumerate(zip(texts, spans, strict=True)):
        gone = set()
        for p in range(len(s) - words + 1):
            if seen[tuple(t[a:b] for a, b in s[p : p + words])] > 1:
                gone |= set(range(s[p][0], s[p + words - 1][1]))
        assert got[i].n_passage == len(gone), i


def test_levels_double_at_most():
    for words in range(1, 300):
        for halvings in range(6):
            steps = windows.levels(words, halvings)
            assert steps[-1] == words and all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


# --- earlier operators: names that clash, grammars to their end, one class of many ------------------------


def test_columns_of_any_name_stay_as_they_are(spark):
    rows = [(i, t, 10 + i, "a", "b", 20 + i, 30 + i, True) for i, t in enumerate([prose(1, 60), prose(1, 60), prose(2, 60), None])]
    schema = "doc_id bigint, text string, `__row__` int, `__text__` string, `__key__` string, `__t__` int, `count` int, `stays` boolean"
    df = spark.createDataFrame(rows, schema)
    kept = partenum.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["__row__"], r["__t__"], r["count"]) for r in kept.collect()) == [(i, 10 + i, 20 + i, 30 + i) for i in (0, 2, 3)]
    kept = suffixes.deduplicate(df)
    assert sorted((r["doc_id"], r["__row__"], r["__t__"]) for r in kept.collect()) == [(i, 10 + i, 20 + i) for i in range(4)]
    judged = toxicity.score(df, toxicity.train(["bad words", "good words"] * 5, [1, 0] * 5)).collect()
    assert sorted((r["doc_id"], r["__text__"], r["__key__"]) for r in judged) == [(i, "a", "b") for i in range(4)]


def test_grammars_go_on_until_no_pair_is_frequent():
    for stream in (np.full(65_536, 7), np.tile(np.arange(100, 164), 1024), np.random.default_rng(1).integers(0, 30, 50_000)):
        seq, rules = tokens.compress(stream.astype(np.uint32), 1000)
        assert (tokens.expand(seq, rules, 1000) == stream).all()
        pairs, count = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
        assert count.max(initial=0) < tokens.LEAST_COUNT


def test_every_language_can_be_learned_and_training_rows_are_bounded(spark, monkeypatch):
    letters = [chr(0x0430 + i) for i in range(30)] + [chr(0x0561 + i) for i in range(30)]
    rows = [(i * 60 + k, f"{c * 3} {c * 5} {c * 2}{k}", f"l{k}") for k, c in enumerate(letters) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(language.fit(df).langs) == len(letters)
    monkeypatch.setattr(common, "MOST_ROWS", 120)
    sample = common.sample_per_class(df, "doc_id", "lang", 600).collect()
    assert len(sample) <= 240 and sorted(sample) == sorted(common.sample_per_class(df.repartition(7), "doc_id", "lang", 600).collect())


def test_one_labelled_id_on_many_rows_gives_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(k, f"other {k}") for k in range(2, 40)] + [(60, "x" * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] * 2 + [(60, 1)], "doc_id bigint, toxic int")
    seen: list = []
    train, toxicity.train = toxicity.train, lambda texts, label, seed=11: seen.append(texts) or train(texts, label)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = train
    assert len(seen[0]) <= 39 and max(map(len, seen[0])) < 100 and sum(t.startswith("text ") for t in seen[0]) <= 1


# --- decontamination against a scan of all alignments ------------------------------------------------------


def test_overlaps_are_those_of_a_scan_of_all_alignments(spark):
    """Every reported overlap is the best stretch of its pair, and every pair with 11 equal tokens in a row is reported."""
    draw, word = np.random.default_rng(21), [f"w{i}" for i in range(400)]
    items = [[word[i] for i in draw.integers(0, 400, n)] for n in (14, 20, 35, 60, 60, 25)]
    docs = []
    for k in range(60):
        text = [word[i] for i in draw.integers(0, 400, int(draw.integers(5, 120)))]
        for _ in range(k % 3):
            item = items[int(draw.integers(0, len(items)))]
            a = int(draw.integers(0, max(1, len(item) - 12)))
            part = [w if draw.random() > 0.07 else f"n{draw.integers(0, 99)}" for w in item[a : a + int(draw.integers(8, 60))]]
            at = int(draw.integers(0, len(text) + 1))
            text[at:at] = part
        docs.append(text)
    left = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string")
    right = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.overlaps(left, right).collect()}
    best, sure = {}, set()
    for i, t in enumerate(docs):
        for j, w in enumerate(items):
            for shift in range(1 - len(w), len(t)):
                first, last = max(shift, 0), min(shift + len(w), len(t))
                same = np.array([t[p] == w[p - shift] for p in range(first, last)])
                running = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
                gain = running - np.minimum.accumulate(running)
                end = int(gain.argmax())
                matches = int(same[int(running[: end + 1].argmin()) : end].sum())
                if matches >= decontaminate.needed(len(w)):
                    best[i, j] = max(best.get((i, j), 0), matches)
                    rows = np.diff(np.flatnonzero(np.concatenate([[True], ~same, [True]]))) - 1
                    if rows.max(initial=0) >= 11:
                        sure.add((i, j))
    assert len(sure) > 20 and sure <= set(got) <= set(best)
    assert all(got[pair] == best[pair] for pair in sure)
    assert len(got) >= 0.95 * len(best)


def test_hot_copies_and_repeated_items_come_back_by_id(many_slices):
    """A third of all rows is one leaking text, under null, equal and own ids; items repeat, one lies across parts of a text."""
    spark, item, other = many_slices, prose(81, 30), prose(82, 20)
    hot = f"{prose(83, 40)} {item} {prose(84, 40)}"
    across = " ".join([*["filler"] * (decontaminate.PART_TOKENS - 9), other, *["filler"] * 50, item])
    rows = [(i if i % 3 else None, hot) for i in range(60)] + [(500, hot)] * 5 + [(1000 + i, prose(200 + i, 60)) for i in range(100)] + [(2000, across), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "row", 1) for i, t in rows], "doc_id bigint, text string, code string, item bigint").repartition(5)
    items = spark.createDataFrame([(1, item), (1, item), (2, item), (3, other), (None, other), (4, None), (5, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matches, r.item_tokens, r.span) for r in decontaminate.overlaps(docs, items).collect()}
    ids = {i for i, t in rows if t == hot} | {2000}
    want = {(i, k): (30, 30, 30) for i in ids for k in (1, 2)} | {(2000, k): (20, 20, 20) for k in (3, None)}
    assert got == want
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 102 and kept.where("text IS NULL").count() == 1


def test_the_filter_keeps_every_seed_of_an_item(spark):
    words = decontaminate._item_words(spark.createDataFrame([(k, prose(k, 5 + k)) for k in range(30)], "item_id bigint, text string"))
    item_seeds = decontaminate._item_seeds(words)
    marked = decontaminate.seed_filter(item_seeds)
    places = {r.code & (decontaminate.FILTER_BITS - 1) for r in item_seeds.collect()}
    assert all(int(marked[p >> 6]) >> (p & 63) & 1 for p in places)
    assert sum(int(m).bit_count() for m in marked[marked > 0]) == len(places)
    assert not decontaminate.seed_filter(item_seeds.limit(0)).any()


# --- the next document where ids are null or repeated ------------------------------------------------------


def test_the_next_document_with_hot_and_null_ids_as_by_hand(many_slices):
    spark, top = many_slices, (1 << 63) - 1
    ids = [None] * 300 + [77] * 300 + [top] * 40 + [-(1 << 63)] + list(range(300, 559)) + [9, 9]
    rows = [(i, f"text {k} {prose(k % 50, 12)}") for k, i in enumerate(ids)] + [(77, "again"), (77, "again"), (None, "again"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in winnowing.edit_likeness(docs).collect())
    keyed = docs.selectExpr("doc_id", "coalesce(text, '') AS text").withColumn("tie", F.xxhash64("text"))
    order = sorted(keyed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, r.tie), reverse=True)
    want = Counter()
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        third = len(r.text) // 3
        want[r.doc_id, len(r.text), sha(r.text[: len(r.text) - third] + following.text[:third])] += 1
    assert got == want
    ranges = keyed.withColumn("range", winnowing._ranges(keyed, 64)).groupBy("range").agg(F.count("*").alias("n"), F.max("doc_id").alias("id"))
    sizes = [r.n for r in ranges.collect()]
    assert max(sizes) <= len(rows) / 20 and len(sizes) > 40


# --- what is left of a lattice -----------------------------------------------------------------------------


def all_paths(t, unit):
    out, stack = {}, [((), 0.0, int(t["root"][unit]))]
    while stack:
        path, log, node = stack.pop()
        edge = int(t["edge_begin"][node])
        if edge < 0:
            out[path] = log
            continue
        while True:
            stack.append(((*path, edge), log + float(t["log"][edge]), int(t["next"][edge])))
            if t["cum"][edge] > 1.5:
                break
            edge += 1
    return out


def test_segmentations_left_over_are_drawn_by_their_probability():
    lattices = pieces.Lattices(queries.tokenizer_path("piece_bpe_32k.model"))
    (units,) = lattices.units(["national"])
    unit = int(units[0])
    paths = all_paths(lattices.tab, unit)
    assert len(paths) > 100 and np.exp(list(paths.values())).sum() == pytest.approx(1)
    search = pieces.Search(lattices, [units], np.zeros(1, np.uint64), 2)
    rank = sorted(paths, key=paths.get, reverse=True)
    as_bytes = lambda p: np.array(p, np.int64).tobytes()
    for taken in (rank[:1], rank[:90], rank[1:]):
        left = {p: np.exp(paths[p]) for p in paths if p not in set(taken)}
        total, n = sum(left.values()), 2000 if len(left) > 1 else 20
        seen = defaultdict(int)
        for k in range(n):
            path, log = search._left(unit, {as_bytes(p) for p in taken}, np.uint64(k * 7919), 1)
            assert log == pytest.approx(paths[tuple(path.tolist())])
            seen[tuple(path.tolist())] += 1
        assert set(seen) <= set(left)
        common_ = [p for p in left if n * left[p] / total >= 10]
        rest = n - sum(seen[p] for p in common_)
        expected = [n * left[p] / total for p in common_]
        chi = sum((seen[p] - e) ** 2 / e for p, e in zip(common_, expected, strict=True)) + (rest - (n - sum(expected))) ** 2 / max(1.0, n - sum(expected))
        assert chi < len(common_) + 1 + 5 * np.sqrt(2 * (len(common_) + 1))
    assert search._left(unit, {as_bytes(p) for p in paths}, np.uint64(1), 1) is None


def test_segmentations_come_out_until_next_to_nothing_is_left():
    lattices = pieces.Lattices(queries.tokenizer_path("piece_bpe_32k.model"))
    (units,) = lattices.units(["notation"])
    paths = all_paths(lattices.tab, int(units[0]))
    (found,) = pieces.Search(lattices, [units], np.array([5], np.uint64), len(paths) + 3).run()
    seen = {tuple(e.tolist()) for e, *_ in found}
    assert len(seen) == len(found) > 60 and sum(np.exp(log) for p, log in paths.items() if p not in seen) < 2e-12
    assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))


def test_tables_of_lattices_stay_bounded_and_decide_nothing(monkeypatch):
    texts = [" ".join(f"{chr(97 + k % 26)}{i * 31 + k}wort" for k in range(60)) for i in range(40)] + ["schluß \n", "名前 \U0001f600  x ", "a▁b", " a", "b\n"]
    keys = np.arange(len(texts)).astype(np.uint64)

    def sampled(lattices):
        found = []
        for a in range(0, len(texts), 5):
            units = lattices.units(texts[a : a + 5])
            search, own = pieces.Search(lattices, units, keys[a : a + 5], 3), lattices.tab
            for u, rows in zip(units, search.run(), strict=True):
                mine = [i for x in u.tolist() for i in own["own"][own["own_begin"][x] :][: own["own_size"][x]].tolist()]
                found.append((mine, [(lattices.ids(edges)[0].tolist(), log, value) for edges, log, value in rows]))
        return found

    path = queries.tokenizer_path("piece_bpe_32k.model")
    lattices = pieces.Lattices(path)
    once, most = sampled(lattices), lattices.edges
    assert all(own == lattices.model.encode(t) for t, (own, _) in zip(texts, once, strict=True))
    assert all(len({tuple(ids) for ids, *_ in rows}) == len(rows) for _, rows in once)
    monkeypatch.setattr(pieces.Lattices, "MOST_EDGES", most // 4)
    bounded = pieces.Lattices(path)
    assert sampled(bounded) == once
    assert bounded.edges < most / 2 and sum(len(v) * v.itemsize for v in bounded.tab.values()) < 0.5 * sum(len(v) * v.itemsize for v in lattices.tab.values())


def test_a_blank_before_the_last_line_end_loses_nothing(spark):
    docs = spark.createDataFrame([(1, "ende \n"), (2, "ende\n"), (3, "a  b \n "), (4, "a"), (5, "")], "doc_id bigint, text string")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = pieces.Lattices(path).model
    for row in pieces.encode(docs, path).collect():
        assert row.exact and row.ids == library.encode({1: "ende \n", 2: "ende\n", 3: "a  b \n ", 4: "a", 5: ""}[row.doc_id])


def test_chunks_of_suffixes_are_small_and_decide_nothing():
    draw = np.random.default_rng(3)
    texts = [draw.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 500, 1200, 90, 3000)]
    offsets = np.cumsum([0, *map(len, texts)])
    together = suffixes.sampled(suffixes.Bytes(np.frombuffer(b"".join(texts), np.uint8), offsets), suffixes.BYTES, 100)
    for i, text in enumerate(texts):
        alone = suffixes.sampled(suffixes.Bytes(np.frombuffer(text, np.uint8), np.array([0, len(text)])), suffixes.BYTES, 100)
        assert all((x[together[0] == i] == y).all() for x, y in zip(together[1:], alone[1:], strict=True))
    assert suffixes.CHUNK_BYTES <= 1 << 18 and windows.CHUNK_BYTES <= 1 << 18


def test_open_places_of_many_texts_at_once(spark):
    draw, length, rows = np.random.default_rng(4), 20, []
    for t in range(40):
        for pos in sorted(draw.choice(np.arange(12, 300), 15, replace=False).tolist()):
            far = int(draw.integers(0, 12))
            rows.append((t, pos, int(draw.integers(0, far + 1)), far, t * 1000 + pos, int(draw.integers(5, 40)), 1))
    got = suffixes._open(spark.createDataFrame(rows, "t bigint, pos bigint, near bigint, far bigint, head bigint, m bigint, count bigint"), length).collect()
    expected = set()
    for t, pos, near, far, head, m, _ in rows:
        covered = {x for u, p, *_, k, _ in rows if u == t and k >= length for x in range(p, p + k - length + 1)}
        left = [x for x in range(pos - far, min(pos - near, pos - length + m) + 1)]
        while left and left[0] in covered:
            left.pop(0)
        while left and left[-1] in covered:
            left.pop()
        if left:
            expected.add((head, t, pos, pos - left[-1], pos - left[0]))
    assert expected and {tuple(r) for r in got} == expected


def test_near_copies_around_an_unrelated_pivot_do_not_meet_in_all_pairs(spark, monkeypatch):
    """A chain of signatures may give a group of near copies a pivot that has nothing in common with them."""
    draw, base = np.random.default_rng(8), prose(77, 80).split()
    texts = ["\u0000 ".join(prose(78, 80).split())]
    for i in range(300):
        w = list(base)
        for at in draw.integers(0, len(w), i % 5):
            w[at] = f"new{i}x{at}"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    verify, compared = partenum._verified, []

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(partenum, "_verified", counted)
    monkeypatch.setattr(partenum, "PAIRS_A_ROW", 2)
    table = common.written(spark.createDataFrame(list(enumerate(texts)), "vertex bigint, text string"), "texts")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "a bigint, b bigint")
    shares = spark.createDataFrame([(i, 80 - t.count("new")) for i, t in enumerate(texts)], "vertex bigint, shares bigint")
    got = {r.vertex: r.root for r in partenum._contracted(pairs, shares, table, 3, 80).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    place = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and place[i] != place[j]:
                place = [place[j] if p == place[i] else p for p in place]
    roots = [got.get(i, -1 - i) for i in range(len(texts))]
    assert len(set(zip(roots, place, strict=True))) == len(set(roots)) == len(set(place)) > 1
    assert sum(compared) < 3 * len(texts)


def test_distinct_words_are_encoded_in_few_strings():
    encoder = tokens.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    library, strings = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            strings.append(len(texts))
            return library.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            return library.encode(text, **more)

    encoder.tokenizer = Counting()
    odd = ["", " ", "a\n", "a\n\n", "\n b", "a\u00a0 b", "a \u3000b", "a\x85 b", "a\x1c b", "x\u00a0", "a\tb c", "\x00a b", " lead", "trail ", "two  blanks", "<|endoftext|> x", "it's we'll", "é 漢字 🙂 Ġa Ġ"]
    texts = [*odd, *(prose(900 + i, 200) + f" only{i} w{i}'s {i}" for i in range(300)), *odd]
    got = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(strings) < len(encoder.number) / 2
    assert [x.tolist() for x in encoder.encode(pa.array(texts[:5]))] == [x.tolist() for x in got[:5]]
    assert encoder.encode(pa.array([], pa.string())) == []


def test_lattices_are_learned_by_one_thread(monkeypatch):
    """The library starts threads for a list of texts otherwise, whose work a task of one core pays for."""
    lattices = pieces.Lattices(queries.tokenizer_path("piece_bpe_32k.model"))
    encode, threads = lattices.model.encode, []
    monkeypatch.setattr(lattices.model, "encode", lambda texts, **more: threads.append(more.get("num_threads")) or encode(texts, **more))
    units = lattices.units(["one two  three", "two four"])
    assert threads == [1] and [len(u) for u in units] == [3, 2]
