"""The corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from herdlens.llm import common, decontaminate, language, partenum, pieces, quality, queries, suffixes, tokens, toxicity, urls, winnowing
from herdlens.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri", "su", "ta") for b in ("n", "r", "st", "ve", "mo", "le")]


def prose(seed: int, words: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in draw.integers(0, len(WORDS), words))


@pytest.fixture(scope="module")
def texts() -> list:
    base = prose(1, 160)
    near = base.split()
    near[80] = "edited"
    passage = prose(3, 90)
    rows = [base, base, " ".join(near), base.upper(), None, "", " \t\n", "one", "one", "two words", "ünï çødé 日本語 text"]
    rows += [f"{prose(10 + i, 30)} {passage} {prose(40 + i, 20)}" for i in range(4)]
    rows += ["ab " * 400, "x" * 3000, prose(7, 3000), prose(8, 5), "a  b", " lead", "trail ", "<|endoftext|> special"]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- urls -------------------------------------------------------------------------------------------


def by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "no scheme", "http://A.EXAMPLE.net/en/1?x", "https://b.net", "https://b.net/#f", "http://x.example.com/de/5", "http://example.com/dex",
        "http://s.org/fr/", "http://notnet/", "http://Ünicode.NET/ä", "a://b://c/d", "http://", "http://blog.casino-win.example.org/en/3?q", "http://www.library.example.org/en/3"]


def test_urls_are_split_and_ruled_as_by_hand(spark):
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS * 2)], "page_id bigint, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(df, urls.fit(urls.labelled(spark))).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        host, path = by_hand(u)
        assert (got[i].host, got[i].path) == (host, path)
        fits = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[1]), default=None)
        assert got[i].rule == (best[1] if best else None)
        if best:
            assert got[i].verdict == best[0]
    assert got[0].verdict == "allow" and got[13].verdict == "block" and got[14].verdict == "allow"


def test_urls_of_an_empty_table_and_a_model_without_classes(spark):
    df = spark.createDataFrame([], "page_id bigint, url string")
    model = urls.fit(spark.createDataFrame([("http://a/b", 1)], "url string, label int"))
    assert urls.judge(df, model).count() == 0
    assert urls.judge(spark.createDataFrame([(1, "http://casino.test/x")], "page_id bigint, url string"), model).first().verdict == "allow"


# --- fingerprints -----------------------------------------------------------------------------------


def test_winnowing_keeps_the_rightmost_minimum_of_each_window(spark, docs, texts):
    rows = docs.withColumn("h", F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(winnowing.TOKEN), F.lit(0)), lambda t: F.xxhash64(t)))
    grams = F.transform("h", lambda x, i: F.xxhash64(F.get("h", i - 2), F.get("h", i - 1), x))
    for r in winnowing.fingerprints(rows.withColumn("g", grams)).collect():
        g, want = r.g, set()
        for a in range(max(0, len(g) - winnowing.W + 1) if len(g) >= winnowing.W else min(1, len(g))):
            window = range(a, min(a + winnowing.W, len(g)))
            want.add(min(window, key=lambda j: (g[j], -j)))
        assert [m.pos for m in r.marks] == sorted(want)
        assert all(m.hash == g[m.pos] for m in r.marks)


def test_edited_texts_and_likeness(spark, docs, texts):
    got = {r.doc_id: r for r in winnowing.edit_likeness(docs).collect()}
    n = len(texts)
    assert len(got) == n
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i - 1) % n] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1.0
    assert len({got[i].fingerprint for i in (4, 5, 6)}) == 1
    assert got[0].fingerprint != got[2].fingerprint and 0.5 < got[2].near_next < 1


def test_fingerprints_of_one_row_repeated_ids_and_none(spark, empty):
    assert winnowing.edit_likeness(empty).count() == 0
    one = spark.createDataFrame([(None, "some words here", None, None, None)], SCHEMA)
    assert winnowing.edit_likeness(one).first().near_next == 1.0
    same = spark.createDataFrame([(1, "a", None, None, 0), (1, "b", None, None, 0), (1, "a", None, None, 0)], SCHEMA)
    assert winnowing.edit_likeness(same).count() == 3


# --- Jaccard join -----------------------------------------------------------------------------------


def linked_by_hand(texts, width, percent):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    place = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    place[i] = place[j] = min(place[i], place[j])
    return [len(s) for s in sets], place


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_join_finds_the_components_of_brute_force(spark, docs, texts, width, percent):
    sizes, place = linked_by_hand(texts, width, percent)
    got = {r.doc_id: r for r in partenum.join(docs, width, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == place


def test_join_of_a_large_group_of_near_copies(spark):
    """A cloud around one text: some within reach of it, some of each other only, most of none."""
    draw, base = np.random.default_rng(5), prose(99, 60).split()
    texts = [" ".join(base)]
    for i in range(60):
        w = list(base)
        for at in draw.integers(0, len(w), 1 + i % 6):
            w[at] = f"new{draw.integers(0, 40)}"
        texts.append(" ".join(w))
    texts += [t.replace("new1", "old1") for t in texts[40:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    _, place = linked_by_hand(texts, 3, 80)
    got = {r.doc_id: r.component_id for r in partenum.join(df, 3, 80).collect()}
    assert [got[i] for i in range(len(texts))] == place
    assert 1 < len(set(place)) < len(texts)


def test_join_of_empty_tables_and_null_ids(spark, empty):
    assert partenum.join(empty).count() == 0
    rows = [(None, "a b c d e f", None, None, 0), (3, "a b c d e f", None, None, 0), (None, "other", None, None, 0)]
    got = sorted((r.component_id or -1) for r in partenum.join(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [-1, 3, 3]


def test_join_takes_each_text_by_its_row_not_by_its_id(spark):
    """Vertices without any id, pivots among them, and different texts under one id, against brute force."""
    rows = []
    for g in range(8):
        base = prose(300 + g, 60).split()
        near = [list(base) for _ in range(3)]
        for k, w in enumerate(near):
            w[15 * k + 5] = f"edit{k}"
        rows += [(None, " ".join(base)), *((10 * g + k + 1, " ".join(w)) for k, w in enumerate(near))]
        rows += [(1000 + g % 2, " ".join(near[0][:-1])), (1000 + g % 2, prose(400 + g, 50))]
    texts = [t for _, t in rows]
    _, place = linked_by_hand(texts, 3, 80)
    smallest: dict = {}
    for (i, _), at in zip(rows, place, strict=True):
        smallest[at] = min((x for x in (smallest.get(at), i) if x is not None), default=None)
    want = Counter((i, smallest[at]) for (i, _), at in zip(rows, place, strict=True))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = Counter((r.doc_id, r.component_id) for r in partenum.join(df, 3, 80).collect())
    assert got == want and want[(None, 1)] == 1


def test_signatures_are_shared_by_all_similar_sets():
    draw = np.random.default_rng(2)
    for size in (1, 3, 9, 12, 40, 200):
        for percent in (80, 90):
            a = np.unique(draw.integers(0, 1 << 62, size).astype(np.uint64))
            drop = int(len(a) * (100 - percent) / (100 + percent))
            b = np.unique(np.concatenate([a[drop:], draw.integers(0, 1 << 62, drop).astype(np.uint64)]))
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inter < percent * union or len(a) == inter == len(b):
                continue
            text, sign = partenum.signatures(np.array([len(a), len(b)]), np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), percent)
            assert set(sign[text == 0]) & set(sign[text == 1])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(100, 140)} == {100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- suffix-array dedup -----------------------------------------------------------------------------


def cut_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        keep = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                keep[i : i + length] = False
        spans = int((np.diff(np.concatenate([[0], (~keep).astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[keep].tobytes()
        out.append((len(b), int((~keep).sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_repeats_are_cut_as_by_brute_force(spark, docs, texts, length):
    want = cut_by_hand(texts, length)
    got = {r.doc_id: r for r in suffixes.digests(docs, length).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == [w[:4] for w in want]
    kept = {r.doc_id: r.text for r in suffixes.deduplicate(docs, length).collect()}
    assert [kept[i] for i in range(len(texts))] == [None if t is None else w[4].decode(errors="replace") for t, w in zip(texts, want)]


def test_repeats_of_near_copies_with_many_edits(spark):
    draw, base = np.random.default_rng(9), prose(50, 120).split()
    texts = []
    for i in range(14):
        w = list(base)
        for at in draw.integers(0, len(w), i % 5):
            w[at] = f"z{draw.integers(0, 3)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    want = cut_by_hand(texts, 100)
    got = {r.doc_id: r for r in suffixes.digests(df, 100).collect()}
    assert [(got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == [w[1:4] for w in want]


def test_repeats_of_empty_tables_and_repeated_rows(spark, empty):
    assert suffixes.digests(empty).count() == 0
    assert suffixes.deduplicate(empty).columns == empty.columns
    rows = [(None, "q" + prose(1, 100), None, None, 0)] * 2 + [(5, None, None, None, None)]
    got = suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text or "" for r in got) == ["", "", ""] and sum(r.text is None for r in got) == 1


def test_passages_of_short_words_are_cut_and_those_of_few_words_stay(spark, tmp_path):
    import corpus_pipeline

    draw = np.random.default_rng(8)
    short = " ".join("abcdefghij"[i] for i in draw.integers(0, 10, 51))
    few, han = " ".join(f"{w}{'x' * 12}" for w in prose(81, 50).split()), "".join(chr(0x4E00 + i) for i in draw.integers(0, 3000, 60))
    twice, own = prose(82, 70), [prose(90 + i, 25) for i in range(9)]
    texts = [f"{own[0]} {short} {own[1]}", f"{own[2]} {short}", f"{own[3]} {few} q", f"{own[4]} {few} r", f"{own[5]} {han}", f"{han} {own[6]}", twice, twice, f"{own[7]} {twice}", few, few, None]
    want = [f"{own[0]}  {own[1]}", f"{own[2]} ", texts[2], texts[3], f"{own[5]} ", f" {own[6]}", "", "", f"{own[7]} ", few, few, None]
    docs = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert len(short) == 101 and len(few) > 250
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_multikey_order_is_the_order_of_bytes():
    draw = np.random.default_rng(3)
    rows = [bytes(draw.integers(97, 99, draw.integers(0, 40)).astype(np.uint8)) for _ in range(500)]
    assert [rows[i] for i in suffixes.multikey_order(rows)] == sorted(rows)
    assert suffixes.common_prefix(b"abcd", b"abxd") == 2 and suffixes.common_prefix(b"", b"a") == 0


# --- decontamination --------------------------------------------------------------------------------


def test_overlaps_survive_substitutions(spark):
    item, short = prose(70, 40), prose(71, 9)
    w = item.split()
    w[5], w[17], w[30] = "changed", "altered", "replaced"
    rows = [(1, f"{prose(5, 50)} {item.upper()}. {prose(6, 9)}"), (2, f"{prose(7, 9)}, {' '.join(w)}"), (3, " ".join(item.split()[10:24])), (4, prose(8, 400)),
            (5, short), (6, None), (7, ""), (1, item)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, item), (11, short), (12, None), (13, "too short")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(1, 10): 40, (2, 10): 37, (3, 10): 14, (5, 11): 9}
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [4, 6, 7]
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0 and decontaminate.clean(docs, items.limit(0)).count() == len(rows)


def test_short_items_and_scripts_without_blanks_are_sought(spark):
    chinese, thai = "春天的花园里有许多五颜六色的花朵在阳光下开放", "ดอกไม้หลากสีบานสะพรั่งในสวน"
    edited = chinese[:9] + "无" + chinese[10:]
    items, rows, want = [(1, chinese), (2, thai), (3, "quaint zebra"), (4, "solitary")], [], set()
    rows = [(1, f"前言。{edited}。后记"), (2, f"คำนำ{thai}จบ"), (3, "a Quaint, zebra ran"), (4, "quaint old zebra"), (5, "so solitary!"), (6, "全く関係のない文章です")]
    want = {(1, 1), (2, 2), (3, 3), (5, 4)}
    for n in range(4, 11):
        w = [f"t{n}x{k}" for k in range(n)]
        items.append((100 + n, " ".join(w)))
        spoiled = n - int(np.ceil(0.8 * n))
        for a in range(n):
            for b in range(a, n):
                own = [f"new{k}" if k in (a, b) else x for k, x in enumerate(w)]
                rows.append((len(rows) + 1, " ".join(["before", *own, "after"])))
                if len({a, b}) <= spoiled:
                    want.add((len(rows), 100 + n))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_leaks_and_copies_go_by_row_not_by_id(spark, tmp_path):
    import corpus_pipeline

    item, a, b, c, d = prose(70, 40), prose(71, 60), prose(72, 60), prose(73, 60), prose(74, 60)
    near = " ".join([*a.split()[:-1], "edited"])
    rows = [(None, f"{item} x"), (None, a), (7, item), (7, b), (8, near), (9, c), (9, c), (9, b), (None, d), (None, d), (None, None), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], SCHEMA).repartition(3)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    kept = Counter((r.doc_id, r.text) for r in decontaminate.clean(docs, items).collect())
    assert kept == Counter(r for r in rows if item not in (r[1] or ""))
    left = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert left.columns == docs.columns
    want = Counter([(7, item), (7, b), (8, near), (9, c), (None, d), (None, None), (None, None), (3, ""), (3, "")])
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want


# --- tokens and pieces ------------------------------------------------------------------------------


def test_token_files_hold_the_ids_of_the_library(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tokens.write(docs, path, f"{tmp_path}/out")
    got = {r.doc_id: r for r in tokens.checksums(tokens.read(spark, f"{tmp_path}/out")).collect()}
    library, start = Tokenizer.from_file(path), 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    row = spark.read.parquet(f"{tmp_path}/out").orderBy("slice", "shard").first()
    whole = tokens.read_range(row, 0, row.tokens)
    assert (tokens.read_range(row, 3, 40) == whole[3:40]).all()
    tokens.write(empty, path, f"{tmp_path}/none")
    assert tokens.read(spark, f"{tmp_path}/none").count() == 0


def test_grammar_compression_is_exact_and_shortens():
    draw = np.random.default_rng(1)
    stream = np.concatenate([np.tile([5, 6, 7, 8], 4000), np.full(999, 3), draw.integers(0, 50, 5000)]).astype(np.uint32)
    seq, rules = tokens.compress(stream, 100)
    assert len(seq) < len(stream) / 2 and (tokens.expand(seq, rules, 100) == stream).all()
    assert tokens.lengths_of(rules, 100).max() >= 4
    for few in ([], [7], [7, 7]):
        seq, rules = tokens.compress(np.array(few, np.uint32), 100)
        assert seq.tolist() == few and len(rules) == 0


def test_pieces_equal_the_library_and_samples_decode(spark, docs, texts, empty):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode(docs, path, top=3).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or "") and got[i].exact
        samples = got[i].samples
        assert len({tuple(s.ids) for s in samples}) == len(samples)
        assert [s.perturbed for s in samples] == sorted((s.perturbed for s in samples), reverse=True)
        assert all(0 <= s.inclusion <= 1 for s in samples)
    assert len(got[4].samples) == len(got[5].samples) == 1 and len(got[0].samples) == 3
    again = {r.doc_id: r for r in pieces.encode(docs.repartition(5), path, top=3).collect()}
    assert again == got  # seeded by the row key
    assert pieces.encode(empty, path).count() == 0


def test_sampling_is_without_replacement_and_in_proportion():
    lattices = pieces.Lattices(queries.tokenizer_path("piece_bpe_32k.model"))
    unit, n = lattices.units(["no"]), 20_000
    found = pieces.Search(lattices, unit * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 9).run()
    assert len({len(r) for r in found}) == 1  # all segmentations there are
    chance = {r[0].tobytes(): np.exp(r[1]) for r in found[0]}
    assert abs(sum(chance.values()) - 1) < 1e-9
    first = Counter(r[0][0].tobytes() for r in found)
    second = Counter((r[0][0].tobytes(), r[1][0].tobytes()) for r in found)
    for a, p in chance.items():
        assert abs(first[a] / n - p) < 0.015
        for b, q in chance.items():
            if a != b:
                assert abs(second[a, b] / n - p * q / (1 - p)) < 0.015


# --- classifiers ------------------------------------------------------------------------------------


def corpus(kind: str):
    rows = []
    for i in range(150):
        text = prose(1000 + i, 40)
        bad = i % 3 == 0
        if bad and kind == "toxic":
            words = text.split()
            words[i % 40] = ("grumblefool", "grumblefools", "ogrumblefool", "grumblefoo")[i % 4]
            text = " ".join(words)
        if not bad and kind == "quality":
            text = text.upper().replace(" ", "!! ")
        rows.append((i, text, int(bad)))
    return rows


def test_toxicity_catches_words_it_has_not_seen(spark):
    rows = corpus("toxic")
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(900, None, "s"), (901, "", "s")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows] + [(902, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(right) > 0.9 and got[900] == got[901] < 0.5
    assert model.score(pa.array([prose(1, 30) + " ungrumblefooled " + prose(2, 300)]))[0] > 0.5
    assert toxicity.train([], []).score(pa.array(["x"]))[0] < 0.5 and toxicity.train(["a"], [1]).score(pa.array(["x"]))[0] > 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_scores_separate_and_calibrate(spark):
    rows = corpus("quality")
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id bigint, text string, score int")
    stats = common.written(quality.with_statistics(docs).drop("text"), "quality-test")
    labels = spark.createDataFrame([(i, b) for i, _, b in rows], "doc_id bigint, quality int")
    got = {r.doc_id: r.score for r in quality.score(stats, quality.fit(stats, labels)).collect()}
    held = [(got[i] >= 0.3) == bool(b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.9 and got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    none = quality.fit(stats, labels.limit(0))
    assert {r.score for r in quality.score(stats, none).collect()} == {0.5}
    assert quality.score(stats.limit(0), none).count() == 0
    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 3.0, 1.0])).tolist() == [0.25, 0.25, 2.0]


def test_language_is_learned_and_rejected(spark):
    few = {"xx": "the and with that this have from", "yy": "der und nicht eine mit sich auch"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(few[k].split(), 12)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    rows += [(500, None, "xx"), (501, "123 --", "yy"), (502, "", None), (503, "the und", None)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], "doc_id bigint, text string, lang string, lang_pred string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert np.mean([got[i].lang_pred == k for i, _, k in rows[:120]]) > 0.98
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (500, 501, 502))
    assert got[503].lang_pred in ("xx", "yy") and 0 <= got[503].score <= 1
    assert language.identify(docs, language.train([], [])).first().lang_pred == "und"
    assert language.identify(docs.limit(0), model).count() == 0


# --- the registered queries and the pipeline --------------------------------------------------------


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages_keep_columns_and_drop_what_they_should(spark, tmp_path):
    import corpus_pipeline

    passage = prose(3, 90)
    item = prose(70, 40)
    rows = [(i, t) for i, t, _ in corpus("toxic")]
    rows += [(200, prose(60, 80)), (201, prose(60, 80)), (202, f"{prose(61, 30)} {passage}"), (203, f"{passage} {prose(62, 30)}"), (204, f"{prose(63, 30)} {item}"), (205, None), (206, "")]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], columns)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, b) for i, _, b in corpus("toxic")], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, folder), f"test-{name}")
        kept[name] = at.collect()
        if name != "pieces":
            assert at.columns == docs.columns
    ids = {n: {r.doc_id for r in k} for n, k in kept.items()}
    clean = {i for i, _, b in corpus("toxic") if not b} | set(range(200, 207))
    assert len(clean - ids["toxicity"]) <= 3 and len(ids["toxicity"] - clean) <= 5
    assert ids["toxicity"] - ids["near_copies"] == {201}
    assert ids["repeats"] == ids["near_copies"]
    cut = {r.doc_id: r for r in kept["repeats"]}
    assert passage not in cut[202].text and passage not in cut[203].text and cut[202].n_chars == len(cut[202].text)
    assert cut[205].text is None and cut[206].text == ""
    assert ids["repeats"] - ids["leaks"] == {204}
    assert ids["pieces"] == ids["leaks"] and all(r.exact for r in kept["pieces"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "leaks", "pieces"]


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    empty.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
