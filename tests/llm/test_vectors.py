"""Nearest vectors and clusters against brute force and known groups."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessella.llm import clusters as K
from tessella.llm import knn, vamana

VECS = "ord bigint, id string, embedding array<float>"


def brute(vectors, k=5):
    ids = sorted(i for i, v in vectors if v is not None and np.isfinite(v).all() and np.linalg.norm(v) > 0)
    x = np.array([dict(vectors)[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(12)
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(ids) - 1)]
    return {tuple(sorted((ids[a], ids[b]))) for a in range(len(ids)) for b in best[a]}


def test_dirt_and_ties(spark):
    rng = np.random.default_rng(0)
    v = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(40)]
    v += [(100 + i, v[3][1]) for i in range(12)]  # equal ones, more than k
    v += [(200, (np.array(v[5][1]) * 4).tolist()), (201, [0.0] * 8), (202, None), (203, [float("nan")] * 8)]
    df = spark.createDataFrame([(i, str(i), x) for i, x in v] + [(300, "short", [1.0, 2.0])], VECS)
    want = brute([(i, np.array(x, float) if x is not None else None) for i, x in v])
    df = df.union(df.limit(9))  # repeated rows
    assert {tuple(r) for r in knn.neighbour_pairs(df).collect()} == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(i, "", [float(i + 1), 1.0]) for i in range(3)], VECS)
    assert rows(knn.neighbour_pairs(df)) == [(0, 1), (0, 2), (1, 2)]
    assert rows(knn.neighbour_pairs(df.limit(1))) == [] and rows(knn.neighbour_pairs(df.limit(0))) == []


def test_shards_cuts_and_blocks(spark, monkeypatch):
    """Many small shards, some of them cut, queries in blocks: recall stays."""
    for name, value in (("TARGET", 60), ("CAP", 50), ("QUERY_BLOCK", 64)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(120, 16))
    x = [(i, (centres[i % 120] + 0.15 * rng.normal(size=16)).astype(np.float32)) for i in range(900)]
    df = spark.createDataFrame([(i, "", v.tolist()) for i, v in x], VECS)
    want = brute([(i, v.astype(float)) for i, v in x])
    got = {tuple(r) for r in knn.neighbour_pairs(df).collect()}
    assert len(got & want) / len(want) > 0.95


def test_probes_follow_the_data(spark, monkeypatch):
    """More than two hundred shards, three probed first: recall holds for vectors in clusters and for those without any structure."""
    monkeypatch.setattr(knn, "TARGET", 12)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(250, 24))
    for x in (centres[rng.integers(250, size=2600)] + 0.2 * rng.normal(size=(2600, 24)), rng.normal(size=(2600, 12))):
        v = [(i, row.astype(np.float32)) for i, row in enumerate(x)]
        df = spark.createDataFrame([(i, "", row.tolist()) for i, row in v], VECS)
        found, _, count = knn.points(df)
        assert len(knn.pivots(found, count)) > 200
        want = brute([(i, row.astype(float)) for i, row in v])
        got = {tuple(r) for r in knn.neighbour_pairs(df).collect()}
        assert len(got & want) / len(want) > 0.9


def test_graph_is_pruned_and_finds():
    x = np.random.default_rng(2).normal(size=(1500, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, entries = vamana.build(x)
    assert graph.shape == (1500, vamana.DEGREE) and all(i not in graph[i] for i in range(1500))
    ids, dist = vamana.search(x, graph, entries, x[:200], beam=64)
    exact = np.argsort(2 - 2 * (x[:200] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(ids[i, :6]) & set(exact[i])) / 6 for i in range(200)]) > 0.9
    assert (np.diff(dist, axis=1) >= 0).all()


def _bank(spark, n=300):
    rng = np.random.default_rng(3)
    topics = {t: [f"{t}{c}" for c in "abcdefgh"] for t in ("cell", "lease", "graph", "sonnet")}
    rows_, labels = [], []
    for i in range(n):
        t = list(topics)[i % 4]
        words = list(rng.choice(topics[t], 5)) + list(rng.choice([f"filler{c}" for c in "abcdefghijkl"], 6)) + [f"name{rng.integers(60)}x"]
        rows_.append((i, (" ".join(words), None)))
        if i % 3 == 0:
            labels.append((i, f" {t.upper()}  topic" if i % 2 else f"{t} topic"))
    questions = spark.createDataFrame(rows_ + [(n, (None, None)), (n + 1, None), (n + 2, ("", None))], "ord bigint, question struct<stem: string, choices: array<struct<label: string, text: string>>>")
    table = spark.createDataFrame(labels + [(n, "no such name"), (1, None)], "ord bigint, kc string")
    values = spark.createDataFrame([(f"{t} topic",) for t in topics] + [("unused",), (None,)], "kc_name string")
    return questions, table, values, [f"{list(topics)[i % 4]} topic" for i in range(n)]


def test_clusters_carry_their_names(spark):
    questions, table, values, truth = _bank(spark)
    got = {r.ord: r.kc for r in K.question_clusters(questions, table, values).collect()}
    assert len(got) == 303
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) > 0.97
    assert got[300] == got[301] == got[302] and got[300] in set(truth)
    found = spark.createDataFrame(list(got.items()), "ord bigint, kc string")
    top = K.typical(questions, found).collect()
    assert {r["size"] for r in top} == {sum(v == k for v in got.values()) for k in set(got.values())}
    assert all(r["rank"] <= 5 for r in top) and len(top) == 20


def test_sums_are_made_in_a_tree(spark):
    """Four hundred tasks: no group of parts is larger than the fan, whatever their number."""
    rows_ = spark.range(4000, numPartitions=400).withColumn("idx", F.array(F.col("id").cast("int")))

    def partial(batches):
        out = np.zeros(40)
        for b in batches:
            np.add.at(out, b.column(0).to_numpy() % 40, 1)
        return out

    assert (K.total_of(rows_, ["id"], partial, fan=8) == 100).all()


def test_clusters_without_labels_or_rows(spark):
    questions, table, values, truth = _bank(spark, 80)
    none = table.limit(0)
    rows_ = K.features(questions, none.selectExpr("ord", "0 as label"))
    got = K.cluster(rows_, 0, clusters=4).collect()
    assert len(got) == 83 and {r.name for r in got} == {-1} and len({r.cluster for r in got}) > 1
    assert K.question_clusters(questions.limit(0), table, values).count() == 0
    assert K.question_clusters(questions, none, values).where("kc is not null").count() == 0
