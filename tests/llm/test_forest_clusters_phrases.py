"""The LSH forest, the centroid clusters and the phrases against brute-force versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, forest, ngram_join, phrases
from tessera.llm.common import Scratch
from tests.llm.test_text_operators import LOWER, corpus, shingle_sets, texts


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def linked(rows, percent=85):
    sets = shingle_sets([r for r in rows if r[0] is not None])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(seed, n, size, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(60)}"
        rows.append((i, " ".join(words)))
    return rows


def rows_of(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect() if r.doc_id is not None}


@pytest.mark.parametrize("seed", [3, 5])
def test_forest_is_brute_force(spark, scratch, seed):
    rows = corpus(seed)
    got = forest.near_duplicates(texts(spark, rows), scratch)
    assert rows_of(got) == linked(rows) and got.count() == len(rows)
    assert [(r.component_id, r.kept) for r in got.where("doc_id is null").collect()] == [(None, True)]


def test_forest_families_around_the_threshold(spark, scratch):
    """Edits on both sides of the threshold, in one family of long texts and one of short ones; trees cut into many partitions."""
    rows = family(8, 70, 220, [1, 2, 3, 4, 5, 6]) + [(100 + i, t) for i, t in family(9, 60, 14, [0, 0, 1])] + [(200 + i, t) for i, t in family(10, 40, 400, [4, 7, 9])]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert rows_of(forest.near_duplicates(texts(spark, rows), scratch)) == linked(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_forest_repeated_rows_and_empty_table(spark, scratch):
    assert forest.near_duplicates(texts(spark, []), scratch).count() == 0
    got = forest.near_duplicates(texts(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, ""), (5, "a b")]), scratch).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True)]


def test_forest_joins_the_texts_of_one_id(spark, scratch):
    """Rows of one id are one document, whichever of its texts have copies, near copies or neither."""
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (3, text("a")), (9, text("b")), (9, text("b")), (4, text("b") + " more"), (8, text("c")), (8, text("d")), (7, text("d"))]
    got = forest.near_duplicates(texts(spark, rows), scratch).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 3) for i in (3, 4, 5, 9)} | {(7, 7), (8, 7)} and len(got) == len(rows)


def test_neighbours_are_those_of_each_sorted_tree(spark, scratch):
    rng = random.Random(2)
    rows = [(t, rng.randrange(4), rng.randrange(6) << 32, i) for i in range(40) for t in range(3)]
    want = collections.Counter()
    for one, two in zip(sorted(rows), sorted(rows)[1:]):
        if one[:2] == two[:2]:
            want[*one[:2], one[3], two[3], 8 if one[2] == two[2] else 6] += 1
    frame = spark.createDataFrame(rows, "tree int, key bigint, deep bigint, doc_id bigint")
    for partitions in (1, 7, 60):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = forest._neighbours(frame, scratch).collect()
        # Across two partitions only what must be shared is known to be.
        assert {(r.tree, r.key, r.a, r.b) for r in got} == {w[:4] for w in want} and len(got) == len(want)
        assert all((r.tree, r.key, r.a, r.b, r.depth) in want or r.depth == forest.BASE for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_few_similar_pairs_miss_the_forest():
    assert forest.missed(0.85) <= 1e-5 and forest.missed(0.85) <= forest.missed(0.8) < 0.01 and forest.missed(0.2) > 0.99
    rng = np.random.default_rng(3)
    met = []
    for _ in range(200):
        pool = np.sort(rng.integers(0, 2**64, 180, np.uint64))
        pick = rng.permutation(180)
        a, b = np.sort(pool[pick[:165]]), np.sort(pool[pick[12:]])  # 153 of 180
        values = forest.minhashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        key, _ = forest.labels(values)
        met.append(int((key[:, 0] == key[:, 1]).sum()))
    assert min(met) >= forest.MEETINGS and abs(np.mean(met) - forest.TREES * 0.85**forest.BASE) < 3


def clusters(rows, k, rounds, dims, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        by = collections.defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        for i, vs in by.items():
            centres[i] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    return sorted(((i, near(v)[1], d if (d := near(v)[0]) < 1 << 63 else None) for i, v in kept), key=str), centres


@pytest.mark.parametrize("size", [1.0, 3e3, 1e6, 1e30])
def test_clusters_are_brute_force(spark, scratch, size):
    size = float(np.float32(size))
    rng = random.Random(int(size) % 97)
    vector = lambda: [float(np.float32(rng.choice([rng.gauss(0, 1), 0.0, 1.0, -1.0]) * size)) for _ in range(5)]
    rows = [(i, vector()) for i in range(150)] + [(200 + i, [size] * 5) for i in range(60)] + [(7, vector()), (7, vector()), (None, vector()), (300, None), (301, []), (302, [1.0] * 4), (303, [1.0] * 6)]
    rows += [(304, [1.0, None, 1.0, 1.0, 1.0]), (305, [1.0, math.nan, 1.0, 1.0, 1.0]), (306, [1.0, math.inf, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"v": F.lit("clash"), "cluster": F.lit("clash")}).repartition(3)
    got, centres = centroids.cluster(frame, scratch, k=12, rounds=3, dims=5)
    want, theirs = clusters(rows, 12, 3, 5)
    assert centres == theirs and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_annulus_compares_few_and_ties_on_its_boundary():
    search = centroids.Annulus([[i * 100, 0] for i in range(40)])
    number, far = search.nearest(np.array([[150.0, 0.0], [149.0, 0.0], [-7.0, 0.0], [10**5, 0.0], [0.0, 50.0]]))
    assert number.tolist() == [1, 1, 0, 39, 0] and far.tolist() == [2500, 2401, 49, (10**5 - 3900) ** 2, 2500] and search.compared < 20
    # Equal centroids, and several at equal distance and equal norm.
    number, _ = centroids.Annulus([[5, 5], [0, 3], [3, 0], [0, 3], [0, -3]]).nearest(np.array([[0.0, 0.0], [0.0, 3.0]]))
    assert number.tolist() == [1, 1]


def test_clusters_of_nothing(spark, scratch):
    none = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    got, centres = centroids.cluster(none, scratch)
    assert got.count() == 0 and centres == [] and got.columns == ["vec_id", "cluster", "distance"]
    one, centres = centroids.cluster(spark.createDataFrame([(1, [0.5] * 64)] * 2, "vec_id bigint, embedding array<double>"), scratch)
    assert [tuple(r) for r in one.collect()] == [(1, 0, 0)] * 2 and centres == [[128] * 64] * 2


def phrases_by_hand(rows, longest, support, within):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, w), a in often.items():
        inside = lambda x: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))  # noqa: B023, E731
        if any(o == lang and len(x) > len(w) and 100 * b >= within * a and inside(x) for (o, x), b in often.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize(("within", "sent", "block"), [(100, phrases.SENT, phrases.BLOCK), (70, 0, 300)])
def test_phrases_are_brute_force(spark, scratch, monkeypatch, within, sent, block):
    monkeypatch.setattr(phrases, "SENT", sent)
    monkeypatch.setattr(phrases, "BLOCK", block)
    rng = random.Random(6)
    idioms = ["new york city hall", "of the same", "as far as", "as far as I know", "der die das", "É É É", "a a a a a a a"]
    rows = []
    for _ in range(300):
        words = [rng.choice([rng.choice("abcdefgh"), rng.choice(idioms), "\U0001f600", "Éa", "x" * 90]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ? "]) for w in words)))
    rows += [("en", None), ("en", ""), ("fr", "."), ("en", " \t ")]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("row", "words", "phrase", "n", "of", "id")}).repartition(3)
    got = phrases.mine(frame, scratch, support=8, within=within)
    want = phrases_by_hand(rows, 5, 8, within)
    assert len(want) > 60 and sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect()) == want
    first = collections.defaultdict(list)
    for p in sorted(want, key=lambda p: (-p[6], -p[2], p[1].encode())):
        first[p[0]].append(p[1])
    ranked = phrases.top(got, 7).collect()
    assert {(r.lang, r["rank"], r.phrase) for r in ranked} == {(lang, i + 1, p) for lang, ps in first.items() for i, p in enumerate(ps[:7])}


def test_phrases_of_nothing_and_scores_beyond_64_bits(spark, scratch):
    frame = lambda rows: spark.createDataFrame(rows, "lang string, text string")
    assert phrases.top(phrases.mine(frame([]), scratch)).count() == 0 and phrases.mine(frame([("en", None)]), scratch).count() == 0
    a, n, left, right = 10**13 + 7, 10**17 - 3, 10**14 + 1, 10**15 + 9
    counts = spark.createDataFrame([(a, n, left, right)], "a bigint, n bigint, l bigint, r bigint")
    assert counts.select(phrases._score(*map(F.col, "anlr"))).first()[0] == 1000 * a * n // (left * right)


def shuffled(spark):
    """Bytes of shuffle files that the session's stages have written so far."""
    gateway = spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rare_pairs_of_frequent_words_take_few_bytes(spark, scratch):
    """All words are frequent and nearly all pairs are rare, each of which is counted. As a row of three longs a pair took 5.8 bytes here."""
    rng = random.Random(4)
    rows = [("en", " ".join(f"w{rng.randrange(400)}" for _ in range(1000))) for _ in range(100)]
    pairs = sum(len({*zip(t.split(), t.split()[1:])}) for _, t in rows)
    before = shuffled(spark)
    assert phrases.mine(spark.createDataFrame(rows, "lang string, text string").repartition(2), scratch, longest=2, support=20).count() == 0
    assert shuffled(spark) - before - sum(len(t) for _, t in rows) < 5 * pairs


@pytest.mark.parametrize(("held", "buckets"), [(50, 7), (10**6, 1), (300, 200)])
def test_pairs_are_counted_over_buckets_and_parts(spark, monkeypatch, held, buckets):
    monkeypatch.setattr(phrases, "HELD", held)
    rng = np.random.default_rng(5)
    seqs = [np.minimum(rng.geometric(0.1, 400) - 2, 40) for _ in range(6)]  # -1 is a gap
    want = collections.Counter(p for s in seqs for p in zip(s.tolist(), s.tolist()[1:], strict=False) if min(p) >= 0)
    rows = [(i, phrases._packed(np.diff(np.arange(41), prepend=0)), phrases._packed(s + 1)) for i, s in enumerate(seqs)]
    got = phrases._often(spark.createDataFrame(rows, phrases._ROWS).repartition(2), 41, buckets, 3).collect()
    assert {(r.left, r.right): r.f for r in got} == {p: f for p, f in want.items() if f >= 3} and len(got) == len({r[:2] for r in got})
