"""Hand-computed values and edge cases of the operators."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import nuisance
from tessera.operators import survival as S
from tessera.operators.estimation import cox_fit, cox_hazard_ratio, cox_restricted_mean, irls
from tessera.operators.order import as_of, rank_within
from tessera.operators.ranking import at_k, ranked
from tessera.plans.cohort import feature
from tessera.plans.discrimination import concordance
from tessera.plans.estimation import effect_table, with_outcome
from tessera.plans.graph import both_ways, coprime, negatives, numbered, starts, walks


def one(df):
    return df.collect()[0]


def test_restricted_mean_without_censoring_is_the_capped_mean(spark):
    times = [1, 2, 3.5, 7, 9, 11, 4.25]
    d = spark.createDataFrame([("a", float(t), True, 8.0) for t in times], "k string, t double, e boolean, h double")
    steps = S.curve(d, ["k", "h"], "t", "e")
    assert one(S.restricted_mean(steps, ["k", "h"], "h")).rmst == pytest.approx(sum(min(t, 8) for t in times) / 7)


def test_median_and_no_median(spark):
    d = spark.createDataFrame([("a", float(t), True) for t in (1, 2, 3, 4)] + [("b", float(t), False) for t in (1, 2)], "k string, t double, e boolean")
    got = {r.k: r.median for r in S.median_time(S.curve(d, ["k"], "t", "e"), ["k"]).collect()}
    assert got == {"a": 2.0, "b": None}


def test_survival_before_the_first_step_is_one(spark):
    d = spark.createDataFrame([("a", 5.0, True)], "k string, t double, e boolean")
    assert one(S.survival_at(S.curve(d, ["k"], "t", "e"), ["k"], F.lit(1.0))).survival == 1.0


def test_e_value(spark):
    d = spark.createDataFrame([(1.87, 1.62, 2.16), (1 / 1.87, 1 / 2.16, 1 / 1.62), (1.1, 0.9, 1.3), (0.0, 0.5, 0.7)], "r double, lo double, hi double")
    got = d.select(S.e_value(F.col("r")).alias("p"), S.e_value_limit(F.col("r"), F.col("lo"), F.col("hi")).alias("l")).collect()
    assert got[0].p == pytest.approx(3.1455, abs=1e-4) and got[1].p == pytest.approx(got[0].p)
    assert got[2].l == 1.0 and math.isnan(got[3].p)


def test_ranking_metrics(spark):
    rel = [3.0, 0.0, 2.0, -1.0, 1.0]
    d = spark.createDataFrame([("q", f"i{i}", float(-i), r) for i, r in enumerate(rel)] + [("none", "x", 1.0, 0.0)], "q string, item string, score double, rel double")
    got = {r.q: r for r in at_k(ranked(d, "q", "score", "item"), "q", "rel", 3).collect()}
    assert got["q"].hits == pytest.approx(2 / 3) and got["q"].ndcg == pytest.approx(0.840008, abs=1e-6)
    assert (got["none"].hits, got["none"].ndcg, got["none"].recall, got["none"].average_precision) == (0, 0, 0, 0)


def test_ties_rank_by_name(spark):
    d = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0)], "q string, item string, score double")
    assert [r.item for r in ranked(d, "q", "score", "item").orderBy("rank").collect()] == ["a", "b"]


def test_cox_known_value(spark):
    x = [0.4, -1.2, 0.8, 0.1, -0.5, 1.5, -0.9, 0.3]
    d = spark.createDataFrame([(float(i + 1), True, float(v)) for i, v in enumerate(x)], "t double, e boolean, x double")
    assert math.exp(cox_hazard_ratio(d, "t", "e", "x")[0]) == pytest.approx(0.94204, abs=1e-3)


def test_irls_solves_its_equations():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(40), rng.normal(size=(40, 3))]
    n = rng.integers(1, 9, 40).astype(float)
    hits = rng.binomial(n.astype(int), 0.4).astype(float)
    b = irls(x, hits, n)
    gradient = x.T @ (hits - n / (1 + np.exp(-x @ b))) - np.r_[0, b[1:]]
    assert np.abs(gradient).max() < 1e-6


def test_concordance_counts_pairs_of_near_times_and_scores(spark):
    rng = np.random.default_rng(4)
    rows = [("a", float(rng.integers(100, 140)) / 100, float(rng.integers(0, 30)) / 100, bool(rng.integers(0, 2))) for _ in range(120)]
    rows += [("b", 1.0, 0.02, True), ("b", 1.01, 0.01, False), ("c", 1.0, 0.5, True), ("d", None, 0.5, True), ("d", 1.0, None, True)]
    want = {}
    for k, t, s, e in rows:
        for k2, t2, s2, _ in rows:
            if k == k2 and e and None not in (t, s, t2, s2) and t2 > t:
                p, a = want.get(k, (0, 0.0))
                want[k] = (p + 1, a + (s > s2) + (s == s2) / 2)
    got = concordance(spark.createDataFrame(rows, "k string, t double, s double, event boolean"), ["k"]).collect()
    assert {r.k: (r.pairs, r.c_index) for r in got} == {k: (p, round(a / p, 6)) for k, (p, a) in want.items()}
    assert want["b"] == (1, 1.0) and want.keys() == {"a", "b"}


def test_slide_feature_weights_the_first_four(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 50.0]), (2, []), (3, None), (4, [1.0, 2.0])], "i int, e array<float>")
    got = {r.i: r.x for r in d.select("i", feature(F.col("e")).alias("x")).collect()}
    assert got == pytest.approx({1: -0.9 + 0.4 + 1.8 + 0.8, 2: 0.0, 3: 0.0, 4: -0.5})


def test_rank_within_is_row_number(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(n), i) for i, (g, n) in enumerate(zip(rng.choice(3, 500, p=[0.9, 0.05, 0.05]), rng.choice([5, 7, 10**12, 10**12 + 3, -4], 500), strict=True))]
    got = {r.i: r["rank"] for r in rank_within(spark.createDataFrame(rows, "g int, n bigint, i int"), ["g"], "n", "i").collect()}
    want = {i: k for g in range(3) for k, (_, i) in enumerate(sorted((n, i) for x, n, i in rows if x == g), 1)}
    assert got == want
    assert rank_within(spark.createDataFrame([], "g int, n bigint, i int"), ["g"], "n", "i").count() == 0


def test_as_of(spark):
    steps = spark.createDataFrame([("a", 1.0, 0.9), ("a", 3.0, 0.5), ("b", 2.0, 0.4)], "k string, t double, v double")
    points = spark.createDataFrame([("a", x) for x in (0.5, 1.0, 2.9, 3.0, 9.0)] * 2 + [("b", 1.9), ("c", 5.0)], "k string, at double")
    got = sorted((r.k, r["at"], r.g) for r in as_of(points, steps, ["k"], "at", "t", "v", F.lit(1.0), "g").collect())
    assert got == sorted([("a", 0.5, 1.0), ("a", 1.0, 0.9), ("a", 2.9, 0.9), ("a", 3.0, 0.5), ("a", 9.0, 0.5)] * 2 + [("b", 1.9, 1.0), ("c", 5.0, 1.0)])


def test_numbered_and_walks(spark):
    names = [f"n{i:03d}" for i in range(300)]
    assert {r.node: r.number for r in numbered(spark.createDataFrame([(n,) for n in reversed(names)], "node string").repartition(5), "node").collect()} == {n: i for i, n in enumerate(names)}
    e = spark.createDataFrame([("a", "r", "x"), ("b", "r", "x"), ("a", "r", "y"), ("x", "s", "z"), ("y", "s", "z")], "head string, relation string, tail string")
    assert {(r.start, r.end): r.n for r in walks(e, ("r", "s")).collect()} == {("a", "z"): 2, ("b", "z"): 1}
    assert {(r.start, r.end): r.n for r in walks(e, ("r", "~r")).collect()} == {("a", "a"): 2, ("a", "b"): 1, ("b", "a"): 1, ("b", "b"): 1}


def test_cox_of_several_covariates_is_brute_force(spark):
    """Coefficients at which the whole-sample score is zero, and the baseline and restricted mean that go with them."""
    rng = np.random.default_rng(2)
    n = 300
    x = np.c_[rng.integers(0, 2, n), rng.integers(0, 3, n)].astype(float)
    t = np.round(rng.exponential(3 / np.exp(x @ [0.5, -0.4])), 1) + 0.1
    e = rng.random(n) < 0.7
    d = spark.createDataFrame([(float(a), bool(b), *map(float, c)) for a, b, c in zip(t, e, x, strict=True)], "t double, e boolean, p double, q double")
    beta, info, baseline = cox_fit(d, "t", "e", ["p", "q"], ridge=0.5)
    score = -0.5 * beta
    steps = {}
    for i in np.flatnonzero(e):
        w = np.exp(x @ beta) * (t >= t[i])
        score = score + x[i] - w @ x / w.sum()
        steps[t[i]] = steps.get(t[i], 0.0) + 1 / w.sum()
    assert np.abs(score).max() < 1e-6 and info.shape == (2, 2)
    knots = sorted(steps)
    hazard = np.cumsum([steps[k] for k in knots])
    assert [r.hazard for r in baseline.orderBy("t").collect()] == pytest.approx(hazard.tolist())
    point = spark.createDataFrame([(1.0, 2.0, 4.0)], "p double, q double, h double")
    got = cox_restricted_mean(point, baseline, F.lit(float(beta[0])) * F.col("p") + F.lit(float(beta[1])) * F.col("q"), "h", ["p", "q"]).first().rmst
    curve = lambda u: math.exp(-sum(steps[k] for k in knots if k <= u) * math.exp(np.array([1.0, 2.0]) @ beta))
    edges = [0.0, *[k for k in knots if k < 4], 4.0]
    assert got == pytest.approx(sum((b - a) * curve(a) for a, b in zip(edges, edges[1:], strict=False)))


def test_effect_under_censoring_is_the_closed_form(spark):
    """Exponential times with a known effect, a confounder and heavy censoring: the estimate is near the truth, the naive outcome isn't."""
    rng = np.random.default_rng(7)
    n, h = 60_000, 6.5
    ecog, prior, site, segment, fold = (rng.integers(0, k, n) for k in (2, 3, 4, 2, 5))
    exposed = rng.random(n) < 0.25 + 0.35 * ecog
    rate = np.where(ecog == 1, 0.25, 0.15) * np.where(exposed, 0.7, 1.0)
    died, lost = rng.exponential(1 / rate), rng.exponential(1 / np.where(ecog == 1, 0.18, 0.08))
    follow = np.ceil(np.minimum(died, lost) * 100) / 100
    rows = list(zip(range(n), fold.tolist(), [f"s{s}" for s in site], ecog.tolist(), prior.tolist(), [f"m{m}" for m in segment], follow.tolist(), (died <= lost).tolist(), strict=True))
    d = spark.createDataFrame(rows, "decision_id bigint, fold int, site string, ecog int, prior_bucket int, c_mktsegment string, follow_up_months double, event boolean").withColumn("horizon_months", F.lit(h))
    x = spark.createDataFrame([(int(i), "c") for i in np.flatnonzero(exposed)], "decision_id bigint, candidate string")
    mean = lambda r: (1 - np.exp(-r * h)) / r
    truth = np.mean([mean(0.7 * r) - mean(r) for r in np.where(ecog == 1, 0.25, 0.15)])
    got = effect_table(with_outcome(d), x).first()
    naive = effect_table(d.withColumn("y", F.least("follow_up_months", "horizon_months")), x).first()
    assert abs(got.tau - truth) < 0.07 < abs(naive.tau - truth) and got.trimmed == 0 and got.exposed == int(exposed.sum())
    # The augmented outcome has the same mean, and the same effect within its error.
    more = effect_table(with_outcome(d, augment=True), x).first()
    assert abs(more.tau - truth) < 2.5 * more.se and abs(more.tau - got.tau) < 2 * more.se
    plain, augmented = (with_outcome(d, a).agg(F.avg("y")).first()[0] for a in (False, True))
    whole = np.mean([mean(r) for r in rate])
    assert abs(plain - whole) < 0.06 and abs(augmented - whole) < 0.06
    # And of rows of continuous covariates, by the batched models.
    rows = nuisance.rows_of(with_outcome(d, augment=True), x, ["ecog", "prior_bucket"])
    batched = nuisance.effects(rows, nuisance.fit(rows, nuisance.catalogue(x), 5), 0.05, 10).first()
    assert abs(batched.tau - truth) < 2.5 * batched.se


def test_rank_within_ranges_follow_the_rows_not_the_width(spark):
    """One outlier, ties and a group of nearly all rows: places are as ever, and no range holds most of the rows."""
    rows = [("big", i // 2, i) for i in range(4000)] + [("big", 10**15, 4000), ("small", 7, 1), (None, 5, 1), (None, 4, 2)]
    frame = spark.createDataFrame(rows, "g string, n bigint, i int")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = {(r.g, r.i): r["rank"] for r in rank_within(frame, ["g"], "n", "i").collect()}
        parts = frame.repartitionByRange(8, "g", "n", "i").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {**{("big", i): i + 1 for i in range(4001)}, ("small", 1): 1, (None, 2): 1, (None, 1): 2} and parts < 1500


def test_as_of_before_leaves_out_the_step_itself(spark):
    steps = spark.createDataFrame([("a", 1.0, 0.9), ("a", 2.0, 0.5)], "k string, t double, v double")
    points = spark.createDataFrame([("a", x) for x in (0.5, 1.0, 1.5, 2.0, 2.5)] + [("b", 2.0)], "k string, x double")
    read = lambda before: [r.g for r in as_of(points, steps, ["k"], "x", "t", "v", F.lit(1.0), "g", before).orderBy("k", "x").collect()]
    assert read(False) == [1.0, 0.9, 0.9, 0.5, 0.5, 1.0] and read(True) == [1.0, 1.0, 0.9, 0.9, 0.5, 1.0]


def test_strides_share_no_factor(spark):
    assert [coprime(7919, m) for m in (10, 7919, 2 * 7919)] == [7919, 7920, 7921] and all(math.gcd(coprime(7919, m), m) == 1 for m in (7919 * 7920, 7919 * 7921))


def test_negatives_of_a_hub(spark):
    """A head that is linked to nearly all nodes goes on until its draw is whole; what it draws is free, distinct and in stride order."""
    names = [f"n{i:04d}" for i in range(900)]
    edges = [("n0000", "r", x) for x in names[1:880]] + [(x, "r", "n0000") for x in names[1:40]] + [(x, "s", "n0001") for x in names[880:]]
    got = {}
    for r in negatives(spark.createDataFrame(edges, "head string, relation string, tail string")).orderBy("place").collect():
        got.setdefault((r["head"], r["tail"]), []).append((r["place"], r["negative"]))
    links = {(h, t) for h, _, t in edges}
    assert sum(h == "n0000" for h, _ in got) > 100 and any(h != "n0000" for h, _ in got)
    by = coprime(7919, 900)
    for (h, t), drawn in got.items():
        walk = [names[(names.index(h) * 31 + names.index(t) * 17 + k * by) % 900] for k in range(900)]
        assert drawn == list(enumerate([x for x in walk if x != h and (h, x) not in links][:12], 1))


def test_motifs_of_any_order_are_matrix_products(spark):
    """Walks by start and pattern, from products of the relations' 0/1 matrices; patterns without a walk don't occur."""
    rng = np.random.default_rng(3)
    names, relations = [f"v{i}" for i in range(12)], ["r", "s", "t"]
    edges = sorted({(names[rng.integers(12)], relations[rng.integers(3)], names[rng.integers(12)]) for _ in range(30)})
    e = both_ways(spark.createDataFrame(edges, "head string, relation string, tail string"))
    matrix = {r: np.zeros((12, 12), int) for r in relations}
    for h, r, t in edges:
        matrix[r][names.index(h), names.index(t)] = 1
    matrix |= {f"~{r}": matrix[r].T for r in relations}
    want = {}
    for k in (1, 2, 3):
        for m in itertools.product(matrix, repeat=k):
            for i, n in enumerate(np.linalg.multi_dot([np.eye(12, dtype=int), np.eye(12, dtype=int), *[matrix[r] for r in m]]).sum(1)):
                if n:
                    want[names[i], ">".join(m), k] = n
    got = {(r.node, r.motif, r["order"]): r.n for r in starts(e, 3).collect()}
    assert got == want and max(k for *_, k in want) == 3
    some = (("r",), ("~s", "t"), ("r", "s", "~t"), ("none", "r"))
    assert {(r.node, r.motif, r["order"]): r.n for r in starts(e, 3, some).collect()} == {k: n for k, n in want.items() if k[1] in {">".join(m) for m in some}}


def test_draws_are_counted_from_a_place_and_none_is_shuffled(spark):
    from tessera.operators.resampling import DRAW, replicates, times_drawn

    for n in (1, 6, 32767, 32768, 50001):
        draw = eval(DRAW, {"k": np.arange(n)[:, None], "rep": np.arange(3), "n": n})
        assert (times_drawn(np.arange(n), n, 3) == np.stack([np.bincount(draw[:, r], minlength=n) for r in range(3)], 1)).all()
    rows = spark.range(40000).select((F.col("id") % 7 == 0).cast("int").alias("g"), "id", (F.col("id") * 31 % 1000).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = replicates(rows, "g", "id", {"s": F.sum(F.col("v") * F.col("times")), "n": F.sum("times")}, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\([^)]*\bk#", plan)
        values = {g: [i * 31 % 1000 for i in range(40000) if (i % 7 == 0) == g] for g in (0, 1)}
        want = {r: sum(sum(v[eval(DRAW, {"k": k, "rep": r, "n": len(v)})] for k in range(len(v))) for v in values.values()) for r in range(3)}
        assert {r.rep: (r.s, r.n) for r in got.collect()} == {r: (s, 40000) for r, s in want.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hits_are_resampled_with_replacement_as_often_as_the_protocol_says(spark):
    """An interval has the width that the values' spread asks for; draws that visit each row once leave it without any."""
    from tessera.plans.ranking import _metrics
    from tessera.plans.readouts import RESAMPLES, bootstrap_hits

    small = "/root/testdata/sf0.001"
    got = bootstrap_hits(spark, small).first()
    assert got.reps == RESAMPLES == 400 and got.lower < got.point < got.upper
    spread = _metrics(spark, small).agg(F.stddev_samp("hits") / F.sqrt(F.count("*"))).first()[0]
    assert 0.85 < (got.upper - got.lower) / (2 * 1.959964 * spread) < 1.15


@pytest.mark.parametrize("block", [4, 64, 1 << 15])
def test_resampled_rows_are_those_of_its_draws_in_sql_and_by_hand(spark, block):
    import duckdb

    from tessera.operators.resampling import _HIGH, _INSIDE, _LOW, _NEXT, _PRIME, _SALT, _STRIDE, draws_sql, resampled

    # A stratum without a name, one of a single row, one that is a row more than blocks of 4 and 64; numbers below zero and beyond 32 bits.
    rows = [(g, (i - 20) * 7919 * (1 if i % 2 else 1 << 33), i % 5 if i % 11 else None) for g, n in ((None, 30), ("a", 1), ("b", 65), ("c", 130)) for i in range(n)]
    reps, mixed = 7, lambda x: pow(x, 5, _PRIME)
    key = lambda i: mixed(((i & _PRIME) * _LOW + (i >> 31 & _PRIME) * _HIGH + _SALT) % _PRIME)
    drawn = {r: [] for r in range(reps)}
    for g in (None, "a", "b", "c"):
        own = sorted((i, v) for h, i, v in rows if h == g)
        for r in range(reps):
            blocks = Counter(mixed((key(i) + r * _NEXT) % _PRIME) * len(own) // 2**31 // block * block for i, _ in own)
            for at, n in blocks.items():
                start = mixed((key(own[at][0]) + r * _NEXT + _INSIDE) % _PRIME)
                step = 1 + mixed((start + _STRIDE) % _PRIME) % (_PRIME - 1)
                drawn[r] += [(g, own[at + mixed((start + j * step) % _PRIME) * min(block, len(own) - at) // 2**31][1]) for j in range(n)]
    want = {(r, sum(v or 0 for _, v in d), sum(g is None for g, _ in d), len(d)) for r, d in drawn.items()}
    assert {n for *_, n in want} == {len(rows)} and len({s for _, s, *_ in want}) > 1
    df = spark.createDataFrame(rows, "g string, id long, v int").repartition(3)
    none = F.when(F.col("g").isNull(), F.col("times"))
    assert {tuple(r) for r in resampled(df, "g", "id", {"s": F.sum(F.col("v") * F.col("times")), "none": F.sum(none), "n": F.sum("times")}, reps, block).collect()} == want
    assert resampled(df.where("id is null"), "g", "id", {"n": F.sum("times")}, reps, block).count() == 0
    values = ", ".join(f"({'NULL' if g is None else repr(g)}, CAST({i} AS BIGINT), {'NULL' if v is None else v})" for g, i, v in rows)
    sql = f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS k, COUNT(*) OVER (PARTITION BY g) AS n FROM (VALUES {values}) AS t(g, id, v)), {draws_sql('g', 'id', reps, block)}
SELECT rep, CAST(SUM(v) AS BIGINT), COUNT(*) FILTER (v.g IS NULL), COUNT(*) FROM dr JOIN v ON dr.g IS NOT DISTINCT FROM v.g AND dr.k = v.k GROUP BY 1"""
    assert set(duckdb.connect().execute(sql).fetchall()) == want


def test_a_tasks_share_of_scored_pairs_is_bounded_by_rows_and_dealt_once(spark, monkeypatch):
    from tessera.sources import stored
    from tessera.sources.model import scored

    monkeypatch.setattr(stored, "SHARE", 500)
    pairs = ranked(scored(spark, "/root/testdata/sf0.001"), "decision_id", "propensity", "candidate")
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1000
    assert len(re.findall(r"hashpartitioning\(decision_id#", pairs._jdf.queryExecution().executedPlan().toString())) == 1


def test_concordance_deals_its_counts_to_tasks_by_their_number(spark, monkeypatch):
    from tessera.sources import stored

    rows = spark.range(2000).select(F.lit("a").alias("k"), (F.col("id") * 7 % 500).cast("double").alias("t"), (F.col("id") * 13 % 97).cast("double").alias("s"), (F.col("id") % 3 == 0).alias("event"))
    want = [tuple(r) for r in concordance(rows, ["k"]).collect()]
    monkeypatch.setattr(stored, "SHARE", 1000)
    got = concordance(rows, ["k"])
    # 2,000 distinct pairs of 9 bits: 18 shares and a rest, and of the tasks that write these a quarter.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(k#\w+, bit#\w+, above#\w+, 19\)", plan) and re.search(r"hashpartitioning\(k#\w+, t#\w+, s#\w+, 5\)", plan)
    assert [tuple(r) for r in got.collect()] == want
