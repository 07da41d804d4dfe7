"""Queries over all pairs move and store what grows with the questions, not with their pairs."""

import pytest
from pyspark.sql import functions as F

COPIES = 10
TABLES = {"questions": "ord", "question_vecs": "ord", "kc_table": "ord", "kc_template": "row_id", "kc_values": None}
#: Rows shuffled and stored per question, at most: vectors are packed, a text is cut into its words (about 130 rows), pairs would be 600.
VECTORS, TEXTS = 5, 300


@pytest.fixture(scope="module")
def bank(spark, sf, tmp_path_factory):
    """Ten copies of the questions under new numbers: several blocks of pairs."""
    folder = str(tmp_path_factory.mktemp("bank"))
    n = spark.read.parquet(f"{sf}/questions.parquet").count()
    for name, key in TABLES.items():
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if key:
            span = n if key == "ord" else rows.count()
            rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn(key, (F.col(key) + F.col("_copy") * span).cast("bigint")).drop("_copy")
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder, COPIES * n


def moved(spark):
    """Rows shuffled and written to files in this session."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


def run(spark, bank, name):
    """Rows moved before the result, and the result's rows."""
    from __spark_entry__ import queries

    folder, n = bank
    before = moved(spark)
    df = queries()[name](spark, folder)
    counted = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) % 1000)).first()[0]
    return (moved(spark) - before) / n, counted, n


def test_sim_euclidean(spark, bank):
    moves, _, _ = run(spark, bank, "sim_euclidean")
    assert moves < VECTORS


def test_sim_cosine(spark, bank):
    moves, _, _ = run(spark, bank, "sim_cosine")
    assert moves < VECTORS


def test_exemplar_assign(spark, bank):
    moves, _, _ = run(spark, bank, "exemplar_assign")
    assert moves < 2


def test_lm_logprob(spark, bank):
    moves, _, _ = run(spark, bank, "lm_logprob")
    assert moves < 137


def test_lm_holes(spark, bank):
    moves, _, _ = run(spark, bank, "lm_holes")
    assert moves < TEXTS


def test_runs_count_what_distinct_pairs_do(spark):
    """Repeats, gaps, other orders, missing and infinite values."""
    from tessella.sources.readers import holes

    rows = [(None, 0, 1.0), (None, 1, 1.0), (0, 1, 1.0), (0, 0, 1.0), (0, 1, 2.0), (1, 0, None), (1, 3, float("inf")), (1, None, 1.0), (1, None, float("nan")), (2, 5, 1.0), (2, 6, 1.0), (2, 5, 1.0), (2, 6, 1.0), (2, 7, 1.0)]
    df = spark.createDataFrame(rows, "cond_ord bigint, ord bigint, logp double")
    assert tuple(holes(df.repartition(3), 2).first()) == (6, len({(c, o) for c, o, _ in rows}), 14, 3)
    assert tuple(holes(df.limit(0), 2).first()) == (6, 0, 0, 0)


def test_pmi_raw(spark, bank):
    moves, _, _ = run(spark, bank, "pmi_raw")
    assert moves < TEXTS


def test_pmi_normalized(spark, bank):
    moves, _, _ = run(spark, bank, "pmi_normalized")
    assert moves < TEXTS


def test_pmi_conditionals(spark, bank):
    moves, _, _ = run(spark, bank, "pmi_conditionals")
    assert moves < TEXTS


def test_pmi_subset(spark, bank):
    moves, _, _ = run(spark, bank, "pmi_subset")
    assert moves < TEXTS


def test_refine_pmi(spark, bank):
    moves, _, _ = run(spark, bank, "refine_pmi")
    assert moves < 2 * TEXTS


def test_refine_unchanged(spark, bank):
    moves, _, _ = run(spark, bank, "refine_unchanged")
    assert moves < 4 * TEXTS


def test_refine_unchanged_counts_words_once(spark, bank, monkeypatch):
    """For the scores and the concepts of all three ways; four times before."""
    from tessella.operators import scoring

    seen, one = [], scoring.counts
    monkeypatch.setattr(scoring, "counts", lambda texts: seen.append(1) or one(texts))
    moves, _, _ = run(spark, bank, "refine_unchanged")
    assert len(seen) == 1 and moves < 1.5 * TEXTS, moves


def test_preferences(spark, bank):
    moves, _, _ = run(spark, bank, "preferences")
    assert moves < VECTORS


def test_spread_against_sorted_values(spark, monkeypatch):
    """Medians of an even and an odd number, ties, blocks and bins cut smaller."""
    import numpy as np

    from tessella.operators import pairs, similarity

    rng = np.random.default_rng(5)
    for n, few in ((9, 1 << 19), (61, 40), (2, 3), (40, 1)):
        monkeypatch.setattr(similarity, "FEW", few)
        x = rng.normal(size=(n, 8)).astype(np.float32)
        x[n // 2 :] = x[: n - n // 2] if n > 50 else x[n // 2 :]
        got = similarity.spread(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord bigint, embedding array<float>"))
        y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
        s = np.clip(y @ y.T, -1, 1)[~np.eye(n, dtype=bool)] - 1
        assert got == pytest.approx({"median": np.median(s), "mean": s.mean(), "min": s.min(), "max": s.max()}, abs=1e-12)
    assert set(similarity.spread(spark.createDataFrame([(0, [1.0, 0.0])], "ord bigint, embedding array<float>")).values()) == {None}


def test_ap_step(spark, bank):
    moves, _, _ = run(spark, bank, "ap_step")
    assert moves < VECTORS


def test_first_step_is_a_step_from_no_messages(spark):
    import random

    from tessella.operators import affinity, similarity

    rng = random.Random(2)
    for n in (1, 2, 12):
        v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)], "ord bigint, embedding array<float>")
        want = affinity.step(affinity.start(affinity.with_preference(similarity.similarity(v, n), -1.0)), 0.5).collect()
        got = affinity.first_step(v, -1.0, 0.5).collect()
        assert sorted((r.i, r.k, round(r.r, 9), round(r.a, 9)) for r in got) == sorted((r.i, r.k, round(r.r, 9), round(r.a, 9)) for r in want)


def test_pair_prompts_broadcasts_nothing(spark, bank):
    from __spark_entry__ import queries

    plan = queries()["pair_prompts"](spark, bank[0])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_pair_prompts_puts_a_prompt_together_once(spark, bank):
    """For its digest; the length comes of both sides. Texts longer in bytes than in characters, empty and missing ones."""
    from __spark_entry__ import queries
    from tessella.operators import scoring

    plan = queries()["pair_prompts"](spark, bank[0])._jdf.queryExecution().optimizedPlan().toString()
    pair = plan[: plan.index("Join Cross")].split("Project [cond_ord")[1]
    assert pair.count("concat(") == 1 and "length(" not in pair, pair
    rows = [(0, "Short Answer", "\u00e4\U0001f600?", ""), (1, None, None, None), (2, "", "x\n", "\u00df")]
    q = spark.createDataFrame([(o, t, (s, []), a) for o, t, s, a in rows], "ord bigint, q_type string, question struct<stem: string, choices: array<struct<label: string, text: string>>>, answer_key string")
    got = scoring.prompts(q, 3).collect()
    assert len(got) == 12 and all(r.context_len == len(r.context) for r in got)


def test_file_log_probs(spark, bank):
    """The scores are what it is about: they are written once, and met by broadcast marginals."""
    moves, _, n = run(spark, bank, "file_log_probs")
    assert moves < n + TEXTS


def test_ap_cluster(spark, bank, monkeypatch):
    """No pair is stored before the rounds, nor by one: 600 a question before."""
    from tessella.operators import affinity

    monkeypatch.setattr(affinity, "KERNEL", 100)
    monkeypatch.setattr(affinity, "dampings", list)
    moves, _, n = run(spark, bank, "ap_cluster")
    assert moves < 2 * VECTORS
    before = moved(spark)
    assert affinity.replay(spark.read.parquet(f"{bank[0]}/question_vecs.parquet").where("embedding is not null"), -1.0, 0.5, max_iterations=2) is None
    assert (moved(spark) - before) / n < 6 * VECTORS


def test_replayed_clusters_are_the_kernels(spark, monkeypatch):
    """Blocks and tiles cut smaller, two equal vectors, scattered numbers; a damping that fails; all alike; one point."""
    import numpy as np

    from tessella.operators import affinity, pairs, similarity

    monkeypatch.setattr(affinity, "KERNEL", 0)
    monkeypatch.setattr(affinity, "TILE", (5, 7))
    monkeypatch.setattr(pairs, "PACK", 40)
    n, rng = 41, np.random.default_rng(41)
    x = rng.normal(size=(5, 6))[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, 6))
    x[7] = x[3]
    ords = np.sort(rng.choice(3 * n, n, replace=False)).tolist()
    v = spark.createDataFrame([(o, r.tolist()) for o, r in zip(ords, x)], "ord bigint, embedding array<double>")
    points, s = affinity.matrix(affinity.broken_ties(similarity.similarity(v, n)).toPandas())
    p = float(np.median(s[~np.eye(n, dtype=bool)]))
    assert similarity.spread(v, affinity.moved)["median"] == pytest.approx(p, abs=1e-15)
    np.fill_diagonal(s, p)
    ex, to, ok, rounds = affinity.run_kernel(s, 0.5, patience=3)
    got = affinity.replay(v, p, 0.5, max_iterations=rounds, patience=3).collect()
    assert ok and len(ex) > 1 and {r.ord: r.exemplar for r in got} == dict(zip(points.tolist(), points[to].tolist()))
    assert affinity.replay(v, p, 0.5, max_iterations=2, patience=3) is None
    alike = spark.createDataFrame([(i, [1.0, 2.0]) for i in (4, 2, 9)], "ord bigint, embedding array<double>")
    assert {r.exemplar for r in affinity.search_vectors(alike, 3).collect()} == {2}
    assert affinity.search_vectors(alike.where("ord = 4"), 1).collect() == [(4, 4)]


def test_moved_as_ties_are_broken(spark):
    import numpy as np

    from tessella.operators import affinity

    i, k = np.array([0, 5, 10**12, -3]), np.array([7, 0])
    want = spark.createDataFrame([(int(x), int(y)) for x in i for y in k], "i bigint, k bigint").selectExpr("xxhash64(i, k) as h").collect()
    assert affinity.hashed(i[:, None], k[None, :]).astype(np.int64).ravel().tolist() == [r.h for r in want]


def test_kc_discover(spark, bank, monkeypatch):
    """No pair is stored before the rounds, nor by one; n x n edges before."""
    from tessella.operators import affinity, congruity
    from tessella.plans import reference

    monkeypatch.setattr(affinity, "KERNEL", 100)
    monkeypatch.setattr(affinity, "dampings", list)
    moves, _, n = run(spark, bank, "kc_discover")
    assert moves < 2 * TEXTS, moves
    rows = reference._normalized(spark, bank[0])
    before = moved(spark)
    assert affinity.replay(rows, -1.0, 0.5, max_iterations=2, measure=congruity.MUTUAL) is None
    assert (moved(spark) - before) / n < 6 * VECTORS


def test_clusters_by_mutual_information_are_the_kernels(spark, monkeypatch):
    """Replayed in small blocks, and as a group within a task; a text without words, two equal ones, one point."""
    import numpy as np

    from tessella.operators import affinity, congruity, pairs, scoring, similarity

    monkeypatch.setattr(affinity, "TILE", (5, 7))
    monkeypatch.setattr(pairs, "PACK", 50)
    rng = np.random.default_rng(3)
    topics = [[f"t{t}w{j}" for j in range(8)] for t in range(4)]
    texts = [(3 * i, " ".join(rng.choice(topics[rng.integers(0, 4)], 9)) + f" own{i}") for i in range(31)]
    texts[5], texts[9] = (texts[5][0], "..."), (texts[9][0], texts[8][1])
    rows = congruity.normalized(scoring.profiles(spark.createDataFrame(texts, "ord bigint, text string")))
    points, s = affinity.matrix(affinity.broken_ties(congruity.native_symmetric(rows)).toPandas())
    off = s[~np.eye(len(s), dtype=bool)]
    values = similarity.spread(rows, affinity.partial(affinity.moved, measure=congruity.MUTUAL), congruity.MUTUAL)
    assert values == pytest.approx({"median": np.median(off), "mean": off.mean(), "min": off.min(), "max": off.max()}, abs=1e-9)
    np.fill_diagonal(s, np.median(off))
    ex, to, ok, rounds = affinity.run_kernel(s, 0.5)
    want = dict(zip(points.tolist(), points[to].tolist()))
    assert ok and 1 < len(ex) < len(s)
    members = rows.selectExpr("'all' as grp", "ord").unionByName(rows.where("ord = 6").selectExpr("'one' as grp", "ord"))
    found = {(r.grp, r.ord): r.exemplar for r in affinity.search_members(members, rows, congruity.MUTUAL).collect()}
    assert found == {("all", o): e for o, e in want.items()} | {("one", 6): 6}
    got = affinity.replay(rows, values["median"], 0.5, max_iterations=3, patience=1, measure=congruity.MUTUAL)
    _, to, ok, _ = affinity.run_kernel(s, 0.5, max_iterations=3, patience=1)
    assert ok == (got is not None) and (not ok or {r.ord: r.exemplar for r in got.collect()} == dict(zip(points.tolist(), points[to].tolist())))


def test_refine_stores_no_pair_of_a_label(spark, bank, monkeypatch):
    """Labels of any size; the edges within a label were stored before."""
    from tessella.operators import affinity, refine, similarity

    members = spark.read.parquet(f"{bank[0]}/question_vecs.parquet").where("embedding is not null").selectExpr("'a' as kc_name", "ord")
    vectors = spark.read.parquet(f"{bank[0]}/question_vecs.parquet").where("embedding is not null")
    monkeypatch.setattr(affinity, "dampings", list)
    for kernel in (3000, 100):
        monkeypatch.setattr(affinity, "KERNEL", kernel)
        before = moved(spark)
        assert refine.recluster_vectors(members, vectors).count() == 0
        assert (moved(spark) - before) / bank[1] < 3 * VECTORS


def test_words_are_counted_where_they_are_read(spark, bank, monkeypatch):
    """A text is a row with its words as lists until it is packed; 130 rows a question were shuffled and stored before. Packed in place or not."""
    from tessella.operators import pairs

    for name in ("pmi_raw", "lm_logprob", "sim_cosine"):
        moves, rows, n = run(spark, bank, name)
        assert moves < 10, (name, moves)
        monkeypatch.setattr(pairs, "MANY", 0)
        monkeypatch.setattr(pairs, "PACK", 70)
        moves, again, _ = run(spark, bank, name)
        monkeypatch.undo()
        assert again == rows and moves < 10, (name, moves)


def test_counts_of_odd_texts(spark, monkeypatch):
    """No text, none with words, one word many times, words in runs cut by batches; broadcast or not."""
    from collections import Counter
    from math import log

    from tessella.operators import scoring

    texts = [(4, None), (0, "?!"), (1, "Ab ab b"), (7, " ".join(["b", "é"] * 40) + " " + " ".join(f"w{i}" for i in range(60))), (3, "")]
    df = spark.createDataFrame(texts, "ord bigint, text string").coalesce(1)
    bags = {o: Counter(t.lower().split()) if o in (1, 7) else Counter() for o, t in texts}
    cf, df_ = sum(bags.values(), Counter()), Counter(w for b in bags.values() for w in b)
    want = sorted((o, w, n, b.total(), cf[w], df_[w], cf.total()) for o, b in bags.items() for w, n in b.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for known in (scoring.broadcast_if_small, lambda small, _: small):
            monkeypatch.setattr(scoring, "broadcast_if_small", known)
            assert sorted((r.ord, r.w, r.tf, r.len, r.cf, r.df, r.total) for r in scoring.counts(df).collect()) == want
            found = {r.ord: (round(r.logp, 9), r.len, sorted(r.tf or [])) for r in scoring.profiles(df).collect()}
            assert found == {o: (round(sum(n * log(cf[w] / cf.total()) for w, n in b.items()), 9), b.total(), sorted(b.values())) for o, b in bags.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
