"""Measures, clustering and similarities against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessella.operators import affinity, congruity, metrics, scoring, similarity
from tessella.sources.readers import with_ord

PAIRS = "model string, true string, pred string"


def measure(spark, true, pred):
    r = metrics.measures(spark.createDataFrame([("m", t, p) for t, p in zip(true, pred)], PAIRS)).first()
    return r.asDict()


def brute(true, pred):
    same = [(a == b, c == d) for (a, c), (b, d) in itertools.combinations(zip(true, pred), 2)]
    tp, fn, fp, tn = (sum(x == y for x in same) for y in ((True, True), (True, False), (False, True), (False, False)))
    n = tp + fn + fp + tn
    expected = (tp + fn) * (tp + fp) / n
    most = ((tp + fn) + (tp + fp)) / 2
    return {"rand": (tp + tn) / n, "adjusted_rand": (tp - expected) / (most - expected), "fowlkes_mallows": tp / math.sqrt((tp + fn) * (tp + fp))}


def test_measures_against_pair_counts(spark):
    rng = random.Random(3)
    true = [rng.choice("abcd") for _ in range(60)]
    pred = [t if rng.random() < 0.6 else rng.choice("abcde") for t in true]
    got = measure(spark, true, pred)
    for k, v in brute(true, pred).items():
        assert got[k] == pytest.approx(v)
    again = measure(spark, true, [{"a": "z", "b": "y", "c": "x", "d": "w", "e": "v"}[p] for p in pred])
    assert {k: again[k] for k in metrics.MEASURES} == pytest.approx({k: got[k] for k in metrics.MEASURES})


def test_expected_information_against_shuffles():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    cells = lambda x, y: np.array([[((x == i) & (y == j)).sum() for j in range(4)] for i in range(3)])

    def mi(t):
        n = t.sum()
        return sum(t[i, j] / n * math.log(n * t[i, j] / (t[i].sum() * t[:, j].sum())) for i in range(3) for j in range(4) if t[i, j])

    t = cells(a, b)
    exact = sum(metrics.expected_term(int(x), int(y), 40) for x in t.sum(1) for y in t.sum(0))
    assert exact == pytest.approx(np.mean([mi(cells(a, rng.permutation(b))) for _ in range(3000)]), abs=0.004)
    assert metrics.log_gamma(np.array([1.0, 2.5, 50.0, 1e6])) == pytest.approx([math.lgamma(x) for x in (1.0, 2.5, 50.0, 1e6)])


def test_degenerate_labelings(spark):
    assert all(v == 1.0 for k, v in measure(spark, "aaaa", "xxxx").items() if k in metrics.MEASURES)
    assert all(measure(spark, "abcd", "wxyz")[m] == pytest.approx(1.0) for m in metrics.MEASURES if m not in ("fowlkes_mallows",))
    one = measure(spark, "aaaa", "wxyz")
    assert one["homogeneity"] == 1.0 and one["completeness"] == 0.0 and one["adjusted_rand"] == 0.0
    assert measure(spark, "a", "x")["rand"] == 1.0
    assert measure(spark, [None, None, "b"], ["x", "x", "y"])["v_measure"] == pytest.approx(1.0)
    assert metrics.measures(spark.createDataFrame([("m", "a", None)], PAIRS)).count() == 0


def test_random_baseline_is_near_chance(spark):
    data = [("m", str(i % 4), str(i % 5)) for i in range(200)]
    r = metrics.random_baseline(spark.createDataFrame(data, PAIRS), runs=20).first()
    assert abs(r.adjusted_rand) < 0.02 and abs(r.ami) < 0.03
    again = metrics.random_baseline(spark.createDataFrame(data, PAIRS), runs=20).first()
    assert r.rand == pytest.approx(again.rand, abs=0.02)


def test_pmi_golden(spark):
    scores = spark.createDataFrame([(None, 0, -2.0), (None, 1, -3.0), (0, 0, -1.0), (0, 1, -2.0), (1, 0, -1.5), (1, 1, -0.5)], "cond_ord bigint, ord bigint, logp double")
    assert rows(congruity.pmi(scores)) == [(0, 0, 1.0), (0, 1, 0.5), (1, 0, 1.0), (1, 1, 2.5)]
    assert rows(congruity.pmi(scores, symmetric=True)) == [(0, 0, 1.0), (0, 1, 0.75), (1, 0, 0.75), (1, 1, 2.5)]
    assert rows(congruity.conditionals(scores)) == [(0, 0, -1.0), (0, 1, -1.5), (1, 0, -2.0), (1, 1, -0.5)]
    soft = congruity.log_softmax(scores).groupBy("cond_ord").agg(F.sum(F.exp("logp")).alias("t")).collect()
    assert all(r.t == pytest.approx(1.0) for r in soft)


def test_query_likelihood_against_formula(spark):
    texts = ["a b b c", "b c d", "", "A e"]
    got = {(r.cond_ord, r.ord): r.logp for r in scoring.query_likelihood(spark.createDataFrame(list(enumerate(texts)), "ord bigint, text string"), 4).collect()}
    toks = [t.lower().split() for t in texts]
    whole = [w for t in toks for w in t]
    p = lambda w: whole.count(w) / len(whole)
    assert len(got) == 20
    for i, c in enumerate(toks):
        assert got[None, i] == pytest.approx(sum(math.log(p(w)) for w in c))
        for j, t in enumerate(toks):
            assert got[i, j] == pytest.approx(sum(math.log(0.5 * (c.count(w) / len(c) if c else 0) + 0.5 * p(w)) for w in t))


def test_external_scorer(spark):
    prompts = spark.createDataFrame([(None, 0, "c", "xy"), (0, 0, "cc", "x")], "cond_ord bigint, ord bigint, context string, text string")
    got = scoring.external(prompts, lambda: lambda c, t: [-len(a) - len(b) for a, b in zip(c, t)], batch=1)
    assert rows(got) == [(0, 0, -3.0), (None, 0, -3.0)]
    with pytest.raises(ValueError):
        scoring.external(prompts, lambda: None, batch=0)


def test_similarity_with_zero_and_equal_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (5, [0.0, 2.0])], "ord bigint, embedding array<float>")
    cos = {(r.i, r.k): r.s for r in similarity.similarity(v, 6).collect()}
    assert cos[0, 1] == 0 and cos[0, 2] == -1 and cos[2, 2] == -1 and cos[0, 5] == -1
    euc = {(r.i, r.k): r.s for r in similarity.similarity(v, 6, "euclidean").collect()}
    assert euc[0, 5] == pytest.approx(-math.sqrt(5)) and euc[5, 5] == 0
    with pytest.raises(ValueError):
        similarity.similarity(v, 6, "manhattan")


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 7, [1e-300, 1.0, 1e300], list(np.random.default_rng(0).normal(size=999)), [0.1] * 500 + [0.2] * 500])
def test_exact_middle(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "s double")
    assert similarity.middle(df, "s") == pytest.approx(float(np.median(values)), rel=1e-12)


def _blobs(n=24):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    return np.concatenate([c + rng.normal(scale=0.5, size=(n // 3, 2)) for c in centres])


def test_clusters_of_blobs(spark):
    x = _blobs()
    s = -((x[:, None] - x[None]) ** 2).sum(-1)
    edges = spark.createDataFrame([(int(i), int(k), float(s[i, k])) for i in range(len(x)) for k in range(len(x))], "i bigint, k bigint, s double")
    pref = similarity.preference(edges)
    found = {r.ord: r.exemplar for r in affinity.search(edges, len(x)).collect()}
    assert len(set(found.values())) == 3 and all(found[e] == e for e in found.values())
    assert len({found[i] for i in range(8)}) == 1
    order = np.random.default_rng(1).permutation(len(x))
    m = s[np.ix_(order, order)].copy()
    np.fill_diagonal(m, pref)
    _, to, ok, _ = affinity.run_kernel(m, 0.5)
    assert ok and {frozenset(order[to == e]) for e in set(to)} == {frozenset(i for i in found if found[i] == e) for e in set(found.values())}


def test_plan_and_kernel_agree(spark):
    x = _blobs(9)
    s = -((x[:, None] - x[None]) ** 2).sum(-1)
    edges = spark.createDataFrame([(int(i), int(k), float(s[i, k])) for i in range(9) for k in range(9)], "i bigint, k bigint, s double")
    by_plan = affinity.propagate(edges, -50.0, 0.5, max_iterations=25, patience=3)
    m = s.copy()
    np.fill_diagonal(m, -50.0)
    _, to, ok, _ = affinity.run_kernel(m, 0.5)
    assert ok and {r.ord: r.exemplar for r in by_plan.collect()} == dict(enumerate(to))


def test_all_alike_by_plan_and_kernel(spark):
    """Equal similarities: the preference decides, and both ways of clustering agree."""
    edges = spark.createDataFrame([(i, k, -1.0) for i in range(5) for k in range(5)], "i bigint, k bigint, s double")
    for p, want in ((-1.0, {i: 0 for i in range(5)}), (-0.5, {i: i for i in range(5)})):
        assert {r.ord: r.exemplar for r in affinity.propagate(affinity.broken_ties(edges), p, 0.5).collect()} == want
    assert {r.ord: r.exemplar for r in affinity.search(edges, 5).collect()} == {i: 0 for i in range(5)}
    assert {r.ord: r.exemplar for r in affinity.search_by_plan(edges)[0].collect()} == {i: 0 for i in range(5)}


def test_large_groups_go_by_plan(spark, monkeypatch):
    monkeypatch.setattr(affinity, "KERNEL", 8)
    monkeypatch.setattr(affinity, "PATIENCE", 3)
    x = _blobs(9)
    s = -((x[:, None] - x[None]) ** 2).sum(-1)
    data = [("big", int(i), int(k), float(s[i, k])) for i in range(9) for k in range(9)] + [("small", i, k, -1.0 * (i != k)) for i in (1, 2) for k in (1, 2)]
    got = affinity.search_groups(spark.createDataFrame(data, "grp string, i bigint, k bigint, s double")).collect()
    assert {r.ord for r in got if r.grp == "big"} == set(range(9)) and len({r.exemplar for r in got if r.grp == "big"}) == 3
    assert len([r for r in got if r.grp == "small"]) == 2


def test_similarities_within_groups(spark):
    rng = np.random.default_rng(4)
    v = {i: rng.normal(size=4).astype(np.float32) for i in range(40)}
    members = [("g" if i % 3 else "h", i) for i in v] + [("h", 4)]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "ord bigint, embedding array<float>")
    got = {(r.grp, r.i, r.k): r.s for r in similarity.within(spark.createDataFrame(members, "grp string, ord bigint"), vectors).collect()}
    unit = {i: x / np.linalg.norm(x) for i, x in v.items()}
    want = {(g, i, k): float(unit[i] @ unit[k]) - 1 for g, i in members for h, k in members if g == h}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-6) for e in want)


def test_next_words(spark):
    prompts = spark.createDataFrame([(0, "b b c"), (1, ""), (2, "zzz")], "ord bigint, context string")
    background = spark.createDataFrame([("a", 5), ("b", 2), ("c", 2), ("d", 1)], "w string, cf bigint")
    got = {(r.ord, r["rank"]): (r.w, r.logp) for r in scoring.next_tokens(prompts, background, top_k=2).collect()}
    assert got[0, 1] == ("b", pytest.approx(math.log(0.5 * 2 / 3 + 0.1))) and got[0, 2][0] == "c"
    assert got[1, 1] == got[2, 1] == ("a", pytest.approx(math.log(0.25))) and got[1, 2][0] == "b"
    own = spark.createDataFrame([("d",), ("c",), ("unknown",)], "w string")
    assert [r.w for r in scoring.next_tokens(prompts, background, own).orderBy("ord").collect()] == ["c", "c", "c"]
    assert scoring.next_tokens(prompts.limit(0), background).count() == 0


def test_text_vectors_leave_the_context_out(spark):
    df = spark.createDataFrame([(0, "x", "one two"), (1, "other words", "two one"), (2, "x", "")], "ord bigint, context string, text string")
    got = {r.ord: r.embedding for r in scoring.encode(df, 16).collect()}
    assert got[0] == got[1] and sum(map(abs, got[0])) == pytest.approx(1.0) and got[2] == [0.0] * 16


def test_small_groups(spark):
    edges = spark.createDataFrame([("one", 4, 4, 0.0)] + [("two", i, k, -1.0 if i != k else 0.0) for i in (1, 2) for k in (1, 2)], "grp string, i bigint, k bigint, s double")
    got = rows(affinity.search_groups(edges).select("grp", "ord", "exemplar"))
    assert ("one", 4, 4) in got and len([r for r in got if r[0] == "two"]) == 2
    assert len(affinity.dampings()) == 10


def test_dense_positions(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(100)], "k bigint, v string")
    got = with_ord(df.repartition(5), "k").orderBy("k").collect()
    assert [r.ord for r in got] == list(range(100))
    assert with_ord(df.limit(0), "k").count() == 0
