"""Every operator on small hand-made tables: nulls, empty and long texts, ties, repeated rows,
empty tables and columns whose names clash with an operator's own."""

import gzip
import hashlib
import io
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe.llm import (ann, common, components, decontamination, jaccard_join, language_id, line_dedup,
                          packing, pii, pii_rules, sharding, token_counts, warc, words)

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_list(text):
    return WORD.findall((text or "").translate(TO_LOWER))


def docs_of(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in extra.split():
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


CLASHES = "row pos key h1 n_lines kept_text dropped bucket index spot shard slot class keys links group n_words hits part before"


# ---- line dedup

def brute_lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    blanks = " \t\n\x0b\x0c\r"
    def key(line):
        return line.strip(blanks).translate(TO_LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        def stays(line):
            h = holders.get(key(line), set())
            return len(h) < min_docs or i == max(h, key=lambda x: (x is not None, x or 0))
        kept = [x for x in lines if stays(x)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def line_rows():
    common = "The Same Long Line That Many Documents Share, Él " + "x" * 10
    rng = np.random.default_rng(0)
    rows = [(i, f"{prose(rng, 12)}\n{common if i % 2 else common.lower()} \t\nshort\n{prose(rng, 3)}\n{common}") for i in range(30)]
    four = "found in four documents only, so that it has to stay put"
    rows += [(100 + i, four) for i in range(4)]
    five = "found in five documents, of which the last one keeps the line"
    rows += [(200 + i, f"{five}\n{five}\n\n") for i in range(5)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, ("y" * 30 + "\n") * 3000), (None, five), (204, five), (7, rows[7][1])]
    return rows


def test_line_dedup_matches_brute_force(spark, line_rows):
    out = line_dedup.dedup_lines(docs_of(spark, line_rows, "pos key dropped"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_text or "") for r in out.collect())
    want = sorted((i is None, i or 0, a, b, t) for i, a, b, t in brute_lines(line_rows))
    assert got == want


def test_line_dedup_splits_a_hot_line(spark):
    hot = "one line that every document of the whole table holds somewhere"
    rows = [(i, f"{hot}\nown line number {i} of the table, long enough to count") for i in range(3000)]
    out = line_dedup.dedup_lines(docs_of(spark, rows))
    assert out.where("n_dropped = 1").count() == 2999
    assert out.where("n_dropped = 0").first().doc_id == 2999


def test_line_dedup_bitmap_is_runs(spark):
    line = "a line that is long enough to have a key of its own, number "
    rows = [(i, "\n".join([line + "1", "x", line + "2", line + "3"])) for i in range(6)]
    maps = line_dedup.keep_bitmaps(docs_of(spark, rows)).where("doc_id = 0").first()
    assert [(r.start, r.length) for r in maps.dropped] == [(0, 1), (2, 2)]


def test_line_dedup_empty_table(spark):
    assert line_dedup.dedup_lines(docs_of(spark, [])).collect() == []


# ---- packing

@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


ODD_TEXTS = [None, "", " ", "\n\t", "don't 'S we'LL x'", "<|startoftext|>a <|endoftext|>B", "a\x0bb\x0cc\x1cd",
             "é́ ñ…! 12.5%", "İstanbul ΣΑΣ ﬁ ½ ² ⅷ", "a b c", "日本語 text。 éa", "'''a''b 5'6' x's'", "😀!? ok😀a",
             "Ｗide Ǆ ǆ", "a" * 3000, "?" * 500 + "'s", "A‍b", "x y " * 3000]


def test_packing_round_trip(spark, tokenizer_path):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, "twice the same row")] * 2 + [(None, "no id")]
    pieces = packing.pack(docs_of(spark, rows, "part before ids"), tokenizer_path, length=64).collect()
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_place = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    place, got, now = 0, [], []
    for p in by_place:
        assert p.sequence_id * 64 + p.offset == place and p.length * 4 == len(p.ids) and p.length > 0
        place += p.length
        if p.start == 0:
            now = []
        assert p.start == len(now)
        now += np.frombuffer(bytes(p.ids), "<u4").tolist()
        if len(now) == p.doc_tokens:
            got.append((p.doc_id, tuple(now)))
    assert Counter(got) == want


def test_packing_sequences_and_empty_table(spark, tokenizer_path):
    pieces = packing.pack(docs_of(spark, [(1, "some words to pack"), (2, None)]), tokenizer_path, length=4)
    rows = sorted(packing.sequences(pieces, 4).collect())
    assert [len(r.ids) for r in rows] == [4] * len(rows) and sum(r.n_tokens for r in rows) == 4 + 1 + 1
    assert packing.pack(docs_of(spark, []), tokenizer_path).collect() == []


def test_packing_cuts_long_texts_alike(tokenizer_path, monkeypatch):
    encoder = packing.UnitEncoder(tokenizer_path)
    text = ("Some words, don't they? " * 500).encode()
    whole = encoder.whole(text).tolist()
    monkeypatch.setattr(packing, "CHUNK", 100)
    monkeypatch.setattr(packing, "TABLE_LIMIT", 3)
    assert [x.tolist() for x in encoder.encode([text, b"", text], True)] == [whole, [], whole]


# ---- words

def test_scan_pieces_cover_every_run_once():
    rng = np.random.default_rng(1)
    texts = [prose(rng, n).encode() for n in (0, 1, 5, 300, 2000)] + [None, b"...", "Élan É1 été".encode()]
    seen = Counter()
    for w in words.scan(texts, 12, chunk=500):
        ok = w.within(13)
        for i in np.flatnonzero(ok):
            seen[(int(w.text[i]), int(w.index[i]), w.phrase(int(i), 13))] += 1
    want = Counter()
    for i, t in enumerate(texts):
        x = word_list((t or b"").decode())
        for j in range(len(x) - 12):
            want[(i, j, " ".join(x[j:j + 13]))] += 1
    assert seen == want


# ---- decontamination

def brute_contamination(rows, items, n=13, share=20):
    windows = defaultdict(set)
    for i, t in items:
        x = word_list(t)
        size = min(len(x), n)
        for j in range(len(x) - size + 1 if x else 0):
            windows[tuple(x[j:j + size])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        x, hit, found = word_list(t), set(), set()
        for size in sizes:
            for j in range(len(x) - size + 1):
                who = windows.get(tuple(x[j:j + size]))
                if who is not None:
                    hit.update(range(j, j + size))
                    found |= who
        out.append((i, len(x), len(hit), sorted(str(f) for f in found if f is not None), len(hit) > 0 and share * len(hit) >= len(x)))
    return out


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [(i, prose(rng, int(n))) for i, n in enumerate(rng.integers(1, 40, 25))]
    items += [(100, None), (101, ""), (102, "..."), (103, items[3][1]), (None, items[4][1]), (3, items[3][1])]
    rows = []
    for i in range(60):
        t = prose(rng, int(rng.integers(1, 200)))
        if i % 3 == 0:
            t = t[:len(t) // 2] + " " + (items[i % 25][1] or "").upper() + "! " + t[len(t) // 2:]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "?!"), (5, rows[5][1]), (None, items[7][1]), (203, " ".join(t for _, t in rows if t) * 30)]
    for block in (1 << 21, 7):
        out = decontamination.decontaminate(docs_of(spark, rows, "row n_words hits"),
                                            spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1)),
                                            block=block)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in out.collect())
        want = sorted((i is None, i or 0, *rest) for i, *rest in brute_contamination(rows, items))
        assert got == want


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.decontaminate(docs_of(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in out) == [(1, 3, 0, False), (2, 0, 0, False)]
    assert decontamination.decontaminate(docs_of(spark, []), none).collect() == []


# ---- Jaccard join

def brute_jaccard(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        x = word_list(t)
        sets.append(frozenset(tuple(x[j:j + n]) for j in range(max(1, len(x) - n + 1))) if x else frozenset())
    distinct = sorted({s for s in sets if s}, key=sorted)
    links = {s: {o for o in distinct if o != s and len(s & o) >= threshold * len(s | o)} for s in distinct}
    parent = {s: s for s in distinct}
    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s
    for s in distinct:
        for o in links[s]:
            parent[find(s)] = find(o)
    members = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        if s:
            members[find(s)].append(i)
    out = []
    for (i, _), s in zip(rows, sets):
        if not s:
            out.append((i, i, 0, 1))
            continue
        named = [m for m in members[find(s)] if m is not None]
        out.append((i, min(named) if named else None, len(links[s]), sets.count(s)))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = prose(rng, 150).split()
        for c in range(int(rng.integers(1, 9))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(0, 150))] = f"z{int(rng.integers(0, 99))}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "!!"), (503, ""), (504, "two words"), (505, "Two, words"), (506, "two words more"),
             (0, rows[0][1]), (None, rows[1][1]), (None, "only without id"), (507, prose(rng, 30000))]
    return rows


@pytest.mark.parametrize("block,block_grams", [(256, 1 << 20), (3, 1 << 20), (256, 300)])
def test_jaccard_matches_brute_force(spark, near_rows, block, block_grams):
    out = jaccard_join.jaccard_classes(docs_of(spark, near_rows, "class keys group links n"), block=block, block_grams=block_grams)
    def name(i):
        return (i is None, i or 0)
    got = sorted((name(r.doc_id), name(r.class_id), r.n_links, r.n_copies) for r in out.collect())
    want = sorted((name(i), name(c), k, m) for i, c, k, m in brute_jaccard(near_rows))
    assert got == want


def test_jaccard_counts_texts_that_share_a_set(spark):
    base = prose(np.random.default_rng(9), 150)
    near = base.rsplit(" ", 1)[0] + " other"
    texts = [base, near, near.upper(), near.replace(" ", ", "), near + "!", near]
    out = jaccard_join.jaccard_classes(docs_of(spark, list(enumerate(texts)) + [(9, "alone"), (10, "!")])).collect()
    assert {r.doc_id: (r.n_links, r.n_copies, r.n_texts) for r in out} == {
        0: (1, 1, 4), **{i: (1, 5, 4) for i in range(1, 6)}, 9: (0, 1, 0), 10: (0, 1, 0)}


def test_tasks_hold_texts_of_bounded_size(monkeypatch):
    """What is made of a batch at once is bounded in bytes of text, not only in rows."""
    texts = [b"a" * 300, None, b"", b"b" * 900, b"c" * 2500, *[b"d e f g h i j"] * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["i", "text"])
    parts = list(common.slices([batch, batch.slice(0, 0)], 1, 1000))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert max(sum(len(t or b"") for t in p.column(1).to_pylist()[:-1]) for p in parts if p.num_rows) <= 1000
    whole = jaccard_join.gram_sets(texts, 5)
    sizes = []

    def seen(texts, overlap, chunk, scan=jaccard_join.scan):
        for w in scan(texts, overlap, chunk):
            sizes.append(len(w.low))
            yield w

    monkeypatch.setattr(jaccard_join, "scan", seen)
    monkeypatch.setattr(jaccard_join, "SCAN_BYTES", 500)
    cut = jaccard_join.gram_sets(texts, 5)
    assert cut.keys() == whole.keys() and all((cut[i] == whole[i]).all() for i in whole)
    assert len(sizes) > 10 and sorted(sizes)[-3] <= 1000


def test_tasks_give_memory_back(spark, near_rows, monkeypatch):
    """A task that has ended or was stopped early gives back what it took, on platforms that can;
    the operators of the pipeline make use of that."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["i"])
    calls = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: type("C", (), {"malloc_trim": staticmethod(calls.append)}))
    assert list(common.released(lambda batches: (b.slice(1) for b in batches))(iter([batch]))) == [batch.slice(1)]
    assert calls == [0]
    begun = common.released(iter)([batch, batch])
    next(begun)
    assert calls == [0]
    begun.close()
    assert calls == [0, 0]
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: object())
    assert list(common.released(iter)([batch])) == [batch]

    docs, ran = docs_of(spark, near_rows), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, *rest: ran.append(f.__qualname__) or plain(df, f, *rest))
    jaccard_join.signatures(docs, 5, 2, 2)
    language_id.predict(docs, None)
    assert len(ran) == 2 and all(name.startswith("released.") for name in ran)


def test_keep_one_of_each_class(spark, near_rows):
    docs = docs_of(spark, near_rows, "class group keeper")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {c for (i, t), (_, c, _, _) in zip(near_rows, brute_jaccard(near_rows)) if word_list(t)}
    worded = [r.doc_id for r in kept.collect() if word_list(r.text)]
    assert len(worded) == len(classes) and {i for i in worded} == classes
    assert kept.where("doc_id in (500, 501, 502, 503)").count() == 4


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_classes(docs_of(spark, [])).collect() == []


def test_band_plan_reaches_recall():
    for s in (0.5, 0.8, 0.95):
        bands, rows = jaccard_join.band_plan(s, 0.9999, 512)
        assert 1 - (1 - s ** rows) ** bands >= 0.9999 and bands * rows <= 512


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7)]
    out = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    roots = {r.node: r.root for r in out}
    assert len(out) == len(roots) == 64
    assert {roots[i] for i in range(61)} == {0} and {roots[i] for i in (100, 101, 103)} == {100}


# ---- sharding

def test_sharding_law_rows(spark):
    rows = [(i, f"text {i}") for i in range(997)] + [(5, "text 5")] * 400 + [(None, None), (9000, ""), (9001, "é" * 50000)]
    out = sharding.shard(docs_of(spark, rows, "bucket spot"), n_shards=16).cache()
    sizes = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1
    places = out.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("s")).collect()
    assert all(list(r.s) == list(range(len(r.s))) for r in places)
    got = Counter((r.record.doc_id, r.record.text) for r in out.collect())
    assert got == Counter(rows)
    order = [r.record.doc_id for r in out.orderBy("shard", "slot").collect() if r.record.doc_id is not None]
    assert abs(np.corrcoef(order[:997], range(len(order[:997])))[0, 1]) < 0.2
    out.unpersist()


def test_sharding_more_shards_than_rows_and_empty(spark, tmp_path):
    few = sharding.shard(docs_of(spark, [(1, "a"), (2, "b")]), n_shards=16)
    assert sorted(r.slot for r in few.collect()) == [0, 0]
    assert sharding.shard(docs_of(spark, [])).collect() == []
    sharding.write_shards(few, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


# ---- nearest neighbours

def test_cross_polytope_rotation_keeps_lengths():
    polytope = ann.CrossPolytope(48, 2)
    x = np.random.default_rng(4).normal(size=(20, 48)).astype(np.float32)
    assert np.allclose(np.linalg.norm(polytope.rotate(x, 1), axis=1), 1, atol=1e-5)
    near = polytope.buckets(x, 1)
    assert near.shape == (20, 2) and (near[:, 1] >= 128).all()
    deep = ann.CrossPolytope(48, 1, depth=2)
    best = deep.buckets(x, 1)[:, 0]
    both = [np.concatenate([y, -y], axis=1) for y in (deep.rotate(x, 0), deep.rotate(x, 1))]
    assert (best == both[0].argmax(1) * 128 + both[1].argmax(1)).all()
    assert all(b in p for b, p in zip(best, deep.buckets(x, 9).tolist()))


def brute_nearest(rows, k, asked):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v is not None
            and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, v in good:
        if asked(i):
            out[i] = sorted((-float(np.sum(v * w)), j) for j, w in good if j != i)[:k]
    return out


@pytest.mark.parametrize("block", [2048, 10])
def test_nearest_recall_and_ties(spark, block):
    rng = np.random.default_rng(5)
    rows = [(i, (lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist())(rng.normal(size=16))) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # equal vectors
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2010, [0.0] * 16), (2020, [nan] * 16), (2030, [inf] + [0.0] * 15), (2040, [None] + [1.0] * 15),
             (2050, [1.0] * 5), (None, rows[0][1]), (2060, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit(1)).withColumn("bucket", F.lit(2))
    out = ann.nearest(df, F.col("vec_id") % 10 == 0, k=20, plan=ann.Plan(1, 8, 32, 1, 1), block=block)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    want = brute_nearest(rows, 20, lambda i: i % 10 == 0)
    assert set(got) == set(want)
    for q, found in got.items():  # all axes probed: exact, ties included
        assert [v for _, v in found] == [v for _, v in want[q]]
        assert np.allclose([s for s, _ in found], [s for s, _ in want[q]], atol=1e-12)
    for probes, depth in ((6, 1), (120, 2)):
        part = ann.nearest(df, F.col("vec_id") % 10 == 0, k=20, plan=ann.Plan(depth, 8, probes, 1, 1), block=block).collect()
        hits = sum((r.vec_id in [v for _, v in want[r.query_id]]) for r in part)
        assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_few_candidates_and_empty(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(none, F.col("vec_id") == 0).collect() == []


def recall_of(rows, out, asked, k=20):
    """Exact neighbours found, as a share of each query's, and the lists' lengths."""
    got = defaultdict(list)
    for r in out.collect():
        got[r.query_id].append(r.vec_id)
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=float)
    shares, lengths = [], []
    for at, i in enumerate(ids.tolist()):
        if asked(i):
            score = v @ v[at]
            score[at] = -np.inf
            want = ids[np.argsort(-score, kind="stable")[:min(k, len(ids) - 1)]]
            shares.append(np.isin(want, got[i]).mean())
            lengths.append(len(got[i]))
    return np.array(shares), lengths


@pytest.mark.parametrize("block", [2048, 300])
def test_nearest_outliers_beside_a_cluster_get_whole_lists(spark, block):
    rng = np.random.default_rng(6)
    spread, centre = rng.normal(size=(30, 64)), rng.normal(size=64)
    tight = centre / np.linalg.norm(centre) + 0.01 * rng.normal(size=(3000, 64)) / 8
    v = np.concatenate([spread, tight])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shares, lengths = recall_of(rows, ann.nearest(df, F.col("vec_id") < 30, block=block), lambda i: i < 30)
    assert lengths == [20] * 30
    assert shares.mean() >= 0.9
    few = rows[:21]
    shares, lengths = recall_of(few, ann.nearest(df.where("vec_id < 21"), F.lit(True)), lambda i: True)
    assert lengths == [20] * 21 and (shares == 1).all()


def test_nearest_repeated_ids_lose_no_neighbour(spark):
    rng = np.random.default_rng(16)
    x = [1.0, 0.5, 0.25, 0.0]
    rows = [(0, x)] * 25 + [(i, x) for i in range(1, 6)] + [(i, rng.normal(size=4).tolist()) for i in range(10, 60)]
    # one id in many classes that lie nearer to it than anything else
    rows += [(100, [5.0, 0.0, 0.0, i / 1000]) for i in range(40)] + [(101, x), (101, x), (120, x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    v = {}
    for q in (0, 20, 40, 100, 120):
        own = [i for i, (j, _) in enumerate(rows) if j == q]
        want = Counter()
        for o in own:
            ranked = sorted((-float(np.sum(np.array(rows[o][1]) * np.array(w))), j) for j, w in rows if j != q)[:20]
            want.update((n + 1, j, -s) for n, (s, j) in enumerate(ranked))
        assert Counter(got[q]) == want, q


@pytest.mark.parametrize("dimension, clustered", [(128, False), (256, True), (768, False)])
def test_nearest_reaches_its_recall_in_many_dimensions(spark, dimension, clustered):
    rng = np.random.default_rng(dimension)
    n = 2500
    v = rng.normal(size=(n, dimension))
    if clustered:
        v = rng.normal(size=(60, dimension))[rng.integers(0, 60, n)] + 0.5 * v
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shares, lengths = recall_of(rows, ann.nearest(df, F.col("vec_id") % 20 == 0), lambda i: i % 20 == 0)
    assert set(lengths) == {20}
    assert shares.mean() >= 0.9


def test_plans_follow_the_structure_of_the_vectors():
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(2000, 64))

    def plan(noise, depths):
        rows = centres + noise * rng.normal(size=(2000, 64))
        asked = np.arange(0, 2000, 25)
        near = [centres[[i]] + noise * rng.normal(size=(20, 64)) for i in asked]
        return ann.choose(rows[asked], near, rows[:500], 10**7, 0.95, depths)

    tight, loose = plan(0.05, (1, 2)), plan(1.0, (1, 2))
    assert tight.recall >= 0.95 and loose.recall >= 0.95
    assert tight.depth == 2 and tight.visited < 0.01 < loose.visited


def test_nearest_finds_long_vectors_at_an_angle(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(3000, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) * np.exp(rng.normal(size=(3000, 1)))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shares, lengths = recall_of(rows, ann.nearest(df, F.col("vec_id") % 20 == 0, target=0.995), lambda i: i % 20 == 0)
    assert set(lengths) == {20}
    assert shares.mean() >= 0.98 and shares.min() >= 0.9


def test_nearest_searches_every_dimension_in_doubles(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 16))
    v[30:] = v[:30] * (1 + 1e-10)  # equal as floats
    far = 1e60 * rng.normal(size=(25, 8))  # beyond floats
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(100 + i, x.tolist()) for i, x in enumerate(far)]
    df = spark.createDataFrame(rows + [(500, [1.0] * 17)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows}
    for group, first in ((v, 0), (far, 100)):
        for at, x in enumerate(group):
            want = sorted((-float(np.sum(x * y)), first + j) for j, y in enumerate(group) if j != at)[:20]
            assert got[first + at] == [(j, -s) for s, j in want]


# ---- language id

TRAIN = [("the quick brown fox jumps over the lazy dog and the cat", "en"), ("der schnelle braune fuchs springt über den faulen hund", "de"),
         ("le renard brun saute par-dessus le chien paresseux été", "fr")]


def brute_code_length(train_texts, text):
    """PPM, method C without exclusions, symbol by symbol."""
    trees = [defaultdict(Counter) for _ in range(language_id.ORDER + 1)]
    for t in train_texts:
        b = b"\0\0\0" + t.encode().translate(language_id.LOWER)
        for i in range(3, len(b)):
            for o in range(language_id.ORDER + 1):
                trees[o][b[i - o:i]][b[i]] += 1
    b = b"\0\0\0" + text.encode().translate(language_id.LOWER)
    bits = 0.0
    for i in range(3, len(b)):
        for o in range(language_id.ORDER, -1, -1):
            seen = trees[o].get(b[i - o:i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if b[i] in seen:
                bits -= math.log2(seen[b[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_ppm_code_lengths_are_exact(spark, monkeypatch):
    rows = spark.createDataFrame(TRAIN * 3 + [(None, "en"), ("untagged", None)], "text string, lang string")
    model = language_id.train(rows, sample_docs=10**6)
    assert model.languages == ["de", "en", "fr"]
    texts = ["the lazy fox", "Über den Hund", "été 日本 \x00 ~~", "x", "zzqqxxyyzz" * 20]
    for chunk in (language_id.CHUNK, 5):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        got = model.lengths([t.encode() for t in texts])
        for j, lang in enumerate(model.languages):
            mine = [t for t, g in TRAIN * 3 if g == lang]
            assert np.allclose(got[:, j], [brute_code_length(mine, t) for t in texts], rtol=1e-5)


def test_language_id_cases(spark):
    rows = spark.createDataFrame(TRAIN, "text string, lang string")
    model = language_id.train(rows)
    docs = docs_of(spark, [(1, "the dog"), (2, None), (3, ""), (4, "123 !?"), (5, "der hund " * 50000), (None, "le chien"), (1, "the dog")], "score rest")
    got = sorted(((r.doc_id or 0), r.lang_pred, 0 <= r.score <= 1) for r in language_id.predict(docs, model).collect())
    assert got == [(0, "fr", True), (1, "en", True), (1, "en", True), (2, "und", True), (3, "und", True), (4, "und", True), (5, "de", True)]
    empty = language_id.train(rows.where("false"))
    assert [r.lang_pred for r in language_id.predict(docs.limit(1), empty).collect()] == ["und"]
    assert language_id.predict(docs_of(spark, []), model).collect() == []


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~out).select("text", "lang"))
    r = language_id.predict(docs.where(out), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 0.98


# ---- personal data

def brute_pii(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)
    def luhn(s):
        x = [int(c) for c in s]
        return (sum(x[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in x[-2::-2])) % 10 == 0
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_rules_match_the_plain_patterns():
    rng = np.random.default_rng(6)
    letters = list("0123456789" * 3 + "..@@++-- ()ab%_é\n")
    for n in (5, 30, 200):
        for _ in range(1500):
            t = "".join(rng.choice(letters, n))
            assert pii_rules.base_spans(t) == brute_pii(t), t
    fixed = "a.b@c.d.e x@y mail 1.2.3.4.5 300.1.1.1 4111 1111 1111 1111 +49 (30) 1234-5678. +1 2"
    assert pii_rules.base_spans(fixed) == brute_pii(fixed)


def test_crf_gradient_and_decoding():
    rng = np.random.default_rng(7)
    tagger = pii.Tagger(hidden=4, seed=1)
    x, y = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    for k in tagger.w:
        tagger.w[k] = tagger.w[k].astype(np.float64)
    _, g = tagger._gradients(x, y)
    for name in tagger.w:
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        keep, eps = tagger.w[name][at], 1e-4
        losses = []
        for step in (eps, -eps):
            tagger.w[name][at] = keep + step
            losses.append(tagger._gradients(x, y)[0])
        tagger.w[name][at] = keep
        assert abs((losses[0] - losses[1]) / (2 * eps) - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))
    some = [rng.normal(size=(n, pii.TAGS)) for n in (1, 4, 9)]
    paths = [tags for tags, _ in tagger.decode(some)]
    ok = pii.allowed()
    trans, start = tagger._constraints()
    import itertools
    short = [p for p in itertools.product(range(pii.TAGS), repeat=4)]
    scores = np.array([start[p[0]] + sum(some[1][t, p[t]] for t in range(4)) + sum(trans[p[t], p[t + 1]] for t in range(3)) for p in short])
    assert short[int(scores.argmax())] == tuple(paths[1])
    weights = np.exp(scores - scores.max())
    marginal = [sum(w for p, w in zip(short, weights) if p[t] == paths[1][t]) / weights.sum() for t in range(4)]
    assert np.allclose(tagger.decode(some)[1][1], marginal, atol=1e-6)
    assert all(ok[a, b] for p in paths for a, b in zip(p[:-1], p[1:])) and [len(p) for p in paths] == [1, 4, 9]


def test_pii_windows_skip_only_what_cannot_matter():
    for text in ("", "no trigger at all", "x" * 200 + "@" + "y" * 300, "1" * 1000, "a" * 64 + "5"):
        want = [s for s in range(0, max(1, len(text)), pii.STRIDE) if pii_rules.TRIGGER.search(text[s:s + pii.WINDOW])]
        assert pii.live_windows(text) == want


def test_pii_operator_cases(spark):
    rows = [(i, f"write to ann.{i}@mail{i % 7}.example.com or call +49 30 {1000000 + i * 37} today") for i in range(300)]
    rows += [(900, None), (901, ""), (902, "plain words " * 20000 + "10.0.0.1"), (None, "a@b.cc"), (3, rows[3][1])]
    docs = docs_of(spark, rows, "base spans n_email")
    tagger = pii.train(docs.select("doc_id", "text"), max_windows=600, epochs=12)
    out = pii.find(docs, tagger).collect()
    assert len(out) == len(rows)
    texts = dict(rows)
    for r in out:
        base = pii_rules.joined(brute_pii(texts[r.doc_id] or ""))
        assert r.base == base and (not base or set(base.split(",")) <= set(r.spans.split(",")))
    assert pii.find(docs_of(spark, []), tagger).collect() == []
    assert not pii.train(docs_of(spark, [])).trained
    # the model alone finds most of what it was taught, on rows it was not shown
    fresh = [f"see bob_{i}@site{i}.example.org for details, or call +49 30 {2000000 + i * 91} today" for i in range(40)]
    found = pii.model_spans(fresh, tagger)
    hit = sum(b in f for f, t in zip(found, fresh) for b in brute_pii(t))
    assert hit >= 0.5 * sum(len(brute_pii(t)) for t in fresh)
    # and it adds spellings that the rules cannot read
    odd = [f"write to ann.{i} @ mail{i % 7}.example.com or call today" for i in range(40)]
    assert not any(brute_pii(t) for t in odd)
    added = [pii.all_spans([t], tagger)[0][1] for t in odd]
    assert sum(bool(a) for a in added) >= 20


def test_pii_variants_move_labels():
    part = "mail a@b.cc or +49 30 1234567 now"
    spans = brute_pii(part)
    seen = set()
    for seed in range(40):
        new, moved = pii.variant(part, spans, np.random.default_rng(seed))
        (s, k, e), (a, j, b) = moved
        assert (k, j) == (0, 3) and "@" in new[s:e] and new[s:e].replace(" ", "") == "a@b.cc"
        assert new[a:b] in ("+49 30 1234567", "0049 30 1234567")
        seen.add((new[s:e], new[a:b]))
    assert len({m for m, _ in seen}) == 4 and len({p for _, p in seen}) == 2
    assert pii.variant("plain", [], np.random.default_rng(1)) == ("plain", [])


# ---- WARC

def test_loser_tree_merges():
    rng = np.random.default_rng(8)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted(rng.integers(0, 50, int(rng.integers(1, 30))).tolist()) for _ in range(k)]
        keys = [x for r in runs for x in r]
        ends = np.cumsum([0, *map(len, runs)]).tolist()
        order = list(warc.LoserTree(list(zip(ends[:-1], ends[1:])), keys))
        assert sorted(order) == list(range(len(keys))) and [keys[i] for i in order] == sorted(keys)


def test_warc_round_trip_and_index(spark, tmp_path):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\nnot a header\r\n\r\n\r\n"
    rows = [(i, f"https://www.Example{i % 5}.com:80/a/{i % 3}?q={i}", f"<p>{i % 20}</p>\r\n") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "not a url\r\nX: y", tricky), (103, "http://a.b/", tricky), (None, "http://a.b/", tricky),
             (104, "http://a.b/", "é" * 300000), (5, rows[5][1], rows[5][2])]
    pages = (spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
             .withColumn("captured", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) % 7)).withColumn("payload", F.lit(1)).withColumn("n", F.lit(2)))
    path = str(tmp_path / "archives")
    mark = warc.write_archives(pages, path)
    back = warc.read_archives(spark, path, mark).cache()
    assert back.count() == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    import base64
    def key(r):
        return tuple((v is None, v if v is not None else 0) for v in r)
    want = sorted(((i, len((t or "").encode()), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode(),
                    *(("revisit", first[t or ""]) if i is not None and first[t or ""] < i else ("response", None))) for i, _, t in rows), key=key)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()), key=key)
    assert got == want
    texts = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.record_type == "response" and r.page_id is not None}
    assert texts[102] == tricky and texts[104] == "é" * 300000 and texts[100] == ""
    index = warc.merge_runs(warc.sorted_runs(back)).collect()
    order = [(r.url_key, r.time, r.page_id is not None, r.page_id or 0) for r in index]
    assert len(order) == len(rows) and order == sorted(order)
    assert "com,example0,www)/a/0?q=0" in {r.url_key for r in index}
    back.unpersist()


def test_warc_detects_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "payload")], "page_id long, url string, html string").withColumn("captured", F.current_timestamp())
    path = str(tmp_path / "a")
    mark = warc.write_archives(pages, path)
    file, = [f for f in (tmp_path / "a").glob("part-*") if f.stat().st_size]
    data, end = file.read_bytes(), mark.encode("latin-1")
    assert data.endswith(end) and len(list(warc.warc_records(io.BytesIO(data)))) == 1
    record = gzip.decompress(data)

    def written(to, member):
        (tmp_path / to).mkdir()
        (tmp_path / to / "part-0.txt").write_bytes(member + end)
        return warc.read_archives(spark, str(tmp_path / to), mark)

    assert [bytes(r.payload) for r in written("same", gzip.compress(record)).collect()] == [b"payload"]
    with pytest.raises(Exception, match="wrong payload digest"):
        written("b", gzip.compress(record.replace(b"payload\r\n", b"pAyload\r\n"))).collect()
    for to, member in {"c": gzip.compress(record.replace(b"payload\r\n", b"pay\r\n")), "d": gzip.compress(record)[:-9],
                       "e": gzip.compress(record)[:40] + b"???" + gzip.compress(record)[43:]}.items():
        with pytest.raises(Exception, match="damaged record"):
            written(to, member).collect()


def test_warc_min_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string").withColumn("captured", F.lit(None).cast("timestamp"))
    got = sorted((r.page_id, r.record_type) for r in warc.archive_and_index(pages, min_bytes=3).collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archive_and_index(pages.where("false")).collect() == []


# ---- token counts

def brute_edits(text, edits):
    for _, start, length, new in sorted(edits, key=lambda e: tuple((v is not None, v) for v in e)):
        start = min(max(start or 0, 0), len(text))
        text = text[:start] + (new or "") + text[start + max(length or 0, 0):]
    return text


def test_token_counts_follow_edits(spark, tokenizer_path, monkeypatch):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path)
    def count(t):
        return len(tokenizer.encode(t, add_special_tokens=False).ids)
    rng = np.random.default_rng(9)
    rows = [(i, prose(rng, int(rng.integers(0, 400))).replace(" w1", "\n w1")) for i in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, rows[3][1]), (3, "another text with the same id"), (None, "no id")]
    pieces = [None, "", " ", "x", "two words", "'s", "é", "<|endoftext|>", "\n\n", "a" * 900, prose(rng, 600)]
    edits = [(int(i), int(s), int(a), int(b), pieces[int(p)]) for i, s, a, b, p in zip(
        rng.integers(0, 120, 900), rng.integers(0, 30, 900), rng.integers(-5, 900, 900), rng.integers(-1, 60, 900), rng.integers(0, len(pieces), 900))]
    edits += [(7, 100 + k, 0, 10**6 if k % 5 == 0 else 3, "new start of it " * (k % 4)) for k in range(60)]
    edits += [(1, None, None, None, None), (None, 1, 0, 5, "x"), (9999, 1, 0, 5, "x")]
    log = spark.createDataFrame(edits, "doc_id long, seq int, start int, length int, replacement string")
    docs = docs_of(spark, rows, "chars tokens edits")
    trees = token_counts.build_trees(docs, tokenizer_path)
    out = token_counts.apply_edits(docs, trees, log, tokenizer_path).collect()
    def last(i, t):
        mine = [e[1:] for e in edits if e[0] == i and i is not None]
        return (i is None, i or 0, count(t or ""), len(mine), count(brute_edits(t or "", mine)), len(brute_edits(t or "", mine)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_edits, r.n_tokens_edited, r.n_chars_edited) for r in out)
    assert got == sorted(last(i, t) for i, t in rows)
    for r in out:  # the trees that come back are whole and sum up
        assert sum(r.tokens) == r.n_tokens_edited and sum(r.chars) == r.n_chars_edited and len(r.chars) == len(r.tokens)
    assert all(r.chars_reencoded == 0 for r in out if not r.n_edits)
    long = [r for r in out if r.n_edits == 1 and r.n_chars_edited > 1500]
    assert all(r.chars_reencoded < 0.7 * r.n_chars_edited + 5000 for r in long)


def test_segment_tree_sums():
    tree = token_counts.SegmentTree("aa bbb c dd", [3, 4, 2, 2], [1, 1, 1, 1])
    assert tree.locate(0) == (0, 0) and tree.locate(3) == (1, 0) and tree.locate(11) == (3, 2)
    tree.put(1, "", 0)
    tree.put(2, "new text ", 2)
    assert tree.chars[1] == 3 + 9 + 2 and tree.tokens[1] == 4 and tree.leaves() == ([3, 9, 2], [1, 2, 1])
    assert all(t[i] == t[2 * i] + t[2 * i + 1] for t in (tree.chars, tree.tokens) for i in range(1, 4))


def test_one_small_edit_encodes_one_region(spark, tokenizer_path):
    docs = docs_of(spark, [(1, "some words here " * 20000)])
    trees = token_counts.build_trees(docs, tokenizer_path)
    log = spark.createDataFrame([(1, 1, 160001, 3, "new")], "doc_id long, seq int, start int, length int, replacement string")
    r = token_counts.apply_edits(docs, trees, log, tokenizer_path).first()
    assert r.n_chars_edited == 320000 and 0 < r.chars_reencoded < 600


def test_token_counts_empty_tables(spark, tokenizer_path):
    log = spark.createDataFrame([], "doc_id long, seq int, start int, length int, replacement string")
    for rows in ([], [(1, "text"), (2, None)]):
        docs = docs_of(spark, rows)
        trees = token_counts.build_trees(docs, tokenizer_path)
        out = token_counts.apply_edits(docs, trees, log, tokenizer_path).collect()
        assert len(out) == len(rows) and all(r.n_tokens == r.n_tokens_edited for r in out)
