"""Copies and near-duplicates against plain comparison of all pairs."""

import itertools
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessella.llm import canonical as C
from tessella.llm import ledger as L
from tessella.llm import near as N

BANK = "ord bigint, question struct<stem: string, choices: array<struct<label: string, text: string>>>"


def bank(spark, questions):
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], BANK)


def copies(spark, df):
    keyed = C.canonical_questions(df)
    return rows(L.copy_pairs(keyed, L.count_copies(L.in_batches(keyed), spark)))


def test_what_is_disregarded(spark):
    one = ("Is  it -5.5, or “7”?", [("a", "Yes."), ("b", "no")])
    qs = [one, ("is it -5.5 or 7", [("B", "NO!"), ("A", "yes")]), ("iѕ it －5.5 or 7", [("x", "no"), ("y", "yes")]), ("Is it 5.5, or 7?", one[1]), ("Is it -55, or 7?", one[1]), ("Is it -5.5, or 7?", [("a", "yes"), ("b", "no"), ("c", "no")]), None, one, (None, None), (None, [])]
    assert copies(spark, bank(spark, qs)) == [(0, 1), (0, 2), (0, 7), (1, 2), (1, 7), (2, 7), (8, 9)]


def test_ledger_over_batches(spark):
    keyed = spark.createDataFrame([(i, f"k{i % 7}") for i in range(50)] + [(99, None)], "ord bigint, key string")
    at_once = rows(L.count_copies([keyed], spark).read())
    assert rows(L.count_copies(L.in_batches(keyed, 3), spark).read()) == at_once
    assert {(r[0], r[1], r[2]) for r in at_once} == {(f"k{m}", len(range(m, 50, 7)), m) for m in range(7)}
    led = L.Ledger(spark)
    led.add(keyed.where("ord >= 25")).add(keyed.where("ord < 25"))
    assert rows(led.read()) == at_once  # the earliest representative, whatever came first
    assert rows(led.add(keyed.limit(0)).read()) == at_once
    again = L.Ledger(spark, led.path)
    assert rows(again.read()) == at_once
    again.add(spark.createDataFrame([(100, "k3")], "ord bigint, key string"))
    assert dict((r[0], r[1]) for r in rows(again.read()))["k3"] == 8


def test_ledger_grows_and_drops_old_versions(spark, monkeypatch, tmp_path):
    """Buckets double as keys come; only versions that hold a bucket stay on disk."""
    import os

    monkeypatch.setattr(L, "PER_BUCKET", 4)
    keyed = spark.createDataFrame([(i, f"k{i % 90}") for i in range(300)], "ord bigint, key string")
    led = L.Ledger(spark, f"file://{tmp_path}/led", buckets=4)
    for part in L.in_batches(keyed, 3):
        led.add(part)
    want = sorted(((f"k{m}", len(range(m, 300, 90)), m) for m in range(90)), key=repr)
    assert sorted(((r[0], r[1], r[2]) for r in led.read().collect()), key=repr) == want and led.buckets >= 23
    assert {int(d[1:]) for d in os.listdir(f"{tmp_path}/led") if d[0] == "v"} == {v for v, _ in led.where.values()}
    again = L.Ledger(spark, led.path)
    assert again.buckets == led.buckets and rows(again.read()) == rows(led.read())
    again.add(spark.createDataFrame([(999, "new")], "ord bigint, key string"))
    assert len({v for v, _ in again.where.values()}) == 2  # one bucket is written anew, no other


def test_large_group_in_cells(spark, monkeypatch):
    monkeypatch.setattr(L.blocked, "__defaults__", (16,))
    keyed = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(150)], "ord bigint, key string")
    got = rows(L.copy_pairs(keyed, L.count_copies([keyed], spark)))
    assert got == sorted(itertools.combinations([i for i in range(150) if i % 3], 2), key=repr)


def test_empty_bank(spark):
    assert copies(spark, bank(spark, []).limit(0)) == []
    assert rows(N.near_pairs(C.canonical_questions(bank(spark, []).limit(0), words=True))) == []


def _random_questions(n=240, seed=2):
    rng = random.Random(seed)
    common = [f"tmpl{c}" for c in "abcdefghijklmnopqrst"]
    rare = ["".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(rare + common)
            if rng.random() < 0.3:
                rng.shuffle(words)
        else:
            words = [rng.choice(common) for _ in range(12)] + [rng.choice(rare) for _ in range(14)]
        out.append(" ".join(words))
    return [(t, None) for t in out] + [("", None), ("...", []), ("tmpla", None), ("Tmpla!", None)]


@pytest.mark.parametrize("hot,block,threshold", [(16384, 4096, 0.7), (20, 16, 0.7), (5, 8, 0.8), (20, 16, 0.5)])
def test_near_pairs_are_whole(spark, monkeypatch, hot, block, threshold):
    """No link is lost, also where values are hot and lists are cut into blocks."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", block)
    can = C.canonical_questions(bank(spark, _random_questions()), words=True)
    sets = {r.ord: (r.key, set(r.words)) for r in can.collect()}
    want = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a][0] != sets[b][0] and sets[a][1] | sets[b][1] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1]) - 1e-9]
    got = rows(N.near_pairs(can, threshold))
    assert got == sorted(want, key=repr) and len(got) > 20


def test_copies_of_near_ones_are_expanded(spark):
    base = " ".join(f"word{c}" for c in "abcdefghijklmnopqrst")
    qs = [(base, None)] * 30 + [(base + " extra", None)] * 3
    got = rows(N.near_pairs(C.canonical_questions(bank(spark, qs), words=True)))
    assert len(got) == 0 or got == sorted(((a, b) for a in range(30) for b in range(30, 33)), key=repr)
    letters = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    qs = [(letters, None)] * 30 + [(letters + " lambda", None)] * 3
    assert rows(N.near_pairs(C.canonical_questions(bank(spark, qs), words=True))) == sorted(((a, b) for a in range(30) for b in range(30, 33)), key=repr)


def test_words():
    import regex

    found = lambda t: regex.findall(C.WORD, t)
    assert found("at -5.5, 7. u5m -x 3-4 .5") == ["at", "-5.5", "7", "u", "5", "m", "x", "3", "4", ".5"]


def test_components_of_chains_and_stars(spark):
    from tessella.llm.groups import components

    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(41, 40), (40, 41), (42, 42)]
    got = rows(components(spark.createDataFrame(links, "a bigint, b bigint")))
    assert got == sorted([(i, 100) for i in range(100, 161)] + [(i, 0) for i in range(40)] + [(40, 40), (41, 40)], key=repr)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_against_brute_force(spark):
    can = C.canonical_questions(bank(spark, _random_questions(120) * 2), words=True)
    sets = {r.ord: (r.key, set(r.words)) for r in can.collect()}
    near = lambda a, b: sets[a][0] != sets[b][0] and sets[a][1] | sets[b][1] and len(sets[a][1] & sets[b][1]) >= 0.7 * len(sets[a][1] | sets[b][1]) - 1e-9
    up = {o: o for o in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a][0] == sets[b][0] or near(a, b):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    want = [(o, top(o), sum(bool(near(o, p)) for p in sets if p != o), sum(sets[p][0] == sets[o][0] for p in sets)) for o in sets]
    assert rows(N.near_groups(can)) == sorted((w for w in want if w[2] or w[3] > 1), key=repr)


@pytest.mark.parametrize("hot,block", [(1, 4), (2, 4), (5, 8)])
def test_small_and_hot_sets_are_whole(spark, monkeypatch, hot, block):
    """Sets of one word and sets of hot words alone, under keys of their own."""
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "BLOCK", block)
    words = ["what", "is", "this", "one"]
    sets = [(f"a{i}", ["what"]) for i in range(5)] + [(f"b{i}", sorted(words[:3])) for i in range(3)] + [(f"c{i}", sorted(words)) for i in range(4)] + [("d", ["is"]), ("e", ["is"]), ("f", [])]
    df = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(sets)], "ord bigint, key string, words array<string>")
    similar = lambda a, b: a and b and len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b)) - 1e-9
    want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if similar(sets[i][1], sets[j][1])]
    assert rows(N.near_pairs(df, 0.7)) == sorted(want, key=repr)


def test_hot_lookup_is_salted(spark, monkeypatch):
    """A key that most rows carry is dealt out and nothing is lost or doubled."""
    from tessella import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    big = spark.createDataFrame([(i, "hot" if i % 4 else f"k{i % 8}") for i in range(200)] + [(999, None)], "i bigint, k string")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    want = sorted([(r.k, r.i, sum((q % 4 != 0) == (r.i % 4 != 0) and (r.i % 4 != 0 or q % 8 == r.i % 8) for q in range(200))) for r in big.where("k is not null").collect()], key=repr)
    for given in ("n", None):
        assert rows(joins.lookup(big, small, ["k"], "i", rows=given).select("k", "i", "n")) == want
    assert joins.lookup(big, small, ["k"], "i", "left", rows="n").count() == 201


def test_one_hot_word_is_enough_for_small_sets(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    sets = [("a", ["the"]), ("b", ["the"]), ("c", ["cat", "the"])] + [(f"x{i}", sorted(["the", f"p{i}", f"q{i}"])) for i in range(8)]
    df = spark.createDataFrame([(i, k, w) for i, (k, w) in enumerate(sets)], "ord bigint, key string, words array<string>")
    assert rows(N.near_pairs(df, 0.7)) == [(0, 1)]
    assert rows(N.near_pairs(df, 0.5)) == [(0, 1), (0, 2), (1, 2)]
