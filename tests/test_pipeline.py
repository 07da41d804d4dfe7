"""From files to files: the programs over a small bank, template and log."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessella import cli
from tessella.functions import names
from tessella.functions import questions as q
from tessella.operators import ingest, kcmodel, steps
from tessella.sources import html, readers, writers


@pytest.fixture(scope="module")
def bank(spark, sf, tmp_path_factory):
    """Sixty questions as lines: most JSON, some Python literals."""
    path = tmp_path_factory.mktemp("bank") / "bank.jsonl"
    lines = []
    for r in spark.read.parquet(f"{sf}/questions.parquet").orderBy("ord").collect():
        d = {"id": r.id, "question": {"stem": r.question.stem}, "note": "kept"}
        if r.q_type is not None:
            d["type"] = r.q_type
        if r.question.choices:
            d["question"]["choices"] = [{"label": c.label, "text": c.text} for c in r.question.choices]
        if r.answer_key is not None:
            d["answerKey"] = r.answer_key
        if r.ds_step_name:
            d["ds-step-name"] = list(r.ds_step_name)
        lines.append(repr(d) if r.ord % 3 == 0 else json.dumps(d))
    path.write_text("\n".join(lines) + "\n\n", encoding="utf8")
    return str(path)


def test_questions_in_both_notations(spark, sf, bank):
    got = readers.questions(spark, bank)
    want = spark.read.parquet(f"{sf}/questions.parquet")
    assert rows(got.select("ord", "id", q.rendered())) == rows(want.select("ord", "id", q.rendered()))
    assert got.where("extras['note'] <> 'kept' or extras is null").count() == 0


def test_bad_lines_stay_as_null(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text("{'id': 'a', 'question': {'stem': 'caf\\xe9\\xa0x', 'choices': None}}\n__import__('os')\n{\"id\": \"c\"}\n", encoding="utf8")
    assert [(r.ord, r.id, r.question.stem if r.question else None) for r in readers.questions(spark, str(p)).orderBy("ord").collect()] == [(0, "a", "caf\xe9\xa0x"), (1, None, None), (2, "c", None)]


def test_programs(spark, sf, bank, tmp_path):
    out = str(tmp_path / "run")
    cli.concept(spark, bank, f"{out}/concept", q_embeds=True)
    cli.pmi(spark, bank, f"{out}/pmi")
    cli.build(spark, f"{out}/concept", f"{out}/pmi", f"{out}/kcs")
    made = [m for m, _ in readers.kc_directory(spark, f"{out}/kcs")]
    assert {"concept", "pmi", "concept-cosine"} <= set(made)
    t = spark.read.parquet(f"{sf}/kc_template.parquet").dropDuplicates(["problem_hierarchy", "problem_name", "step_name"]).orderBy("row_id")
    keys = [F.col("problem_hierarchy").alias("Problem Hierarchy"), F.col("problem_name").alias("Problem Name"), F.col("step_name").alias("Step Name")]
    t.select(*keys, F.col("kc_lo").alias("KC (lo)"), F.lit(" ").alias("KC (none)")).coalesce(1).write.csv(f"{out}/t.txt", sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    t.select(*keys, F.concat_ws(" ", "problem_name", "step_name").alias("KC (Unique-step)")).coalesce(1).write.csv(f"{out}/u.txt", sep="\t", header=True)
    ss = spark.read.parquet(f"{sf}/student_step.parquet").orderBy("row_id")
    ss.select(*(F.col(c).alias(k) for k, c in (("Anon Student Id", "anon_student_id"), ("Problem Hierarchy", "problem_hierarchy"), ("Problem Name", "problem_name"), ("Step Name", "step_name"), ("First Transaction Time", "first_transaction_time"), ("First Attempt", "first_attempt"))), F.lit(1).alias("Other")).coalesce(1).write.csv(f"{out}/ss.txt", sep="\t", header=True)
    folder = cli.export(spark, f"{out}/kcs", f"{out}/t.txt", f"{out}/u.txt", f"{out}/ss.txt", minimal=True, multiplier=2)
    all_kc = readers.template(spark, f"{folder}/all-kc.txt")
    assert "KC (lo)" in all_kc.columns and "KC (none)" not in all_kc.columns and all_kc.count() == t.count()
    merged = spark.read.csv(f"{folder}/{writers.merged_name('all-kc', True, 2)}", sep="\t", header=True)
    assert merged.count() == ss.count() and "Opportunity (concept-1)" in merged.columns
    assert merged.where("`Anon Student Id` not like 'ST-%'").count() == 0
    values = f"{out}/lo_kc-values.csv"
    n = {r.kc_lo: r.n for r in t.groupBy("kc_lo").agg(F.count(F.lit(1)).alias("n")).collect() if r.kc_lo and r.kc_lo.strip()}
    with open(values, "w") as f:
        f.write(",KC Name,Number of Unique Steps,Number of Observations,Intercept (logit) at Opportunity 1,Intercept (probability) at Opportunity 1,Slope\n")
        f.writelines(f'{i},"{k}",{v},9,0.1,0.5,0.0005\n' for i, (k, v) in enumerate(sorted(n.items())))
    assert readers.kc_values(spark, values).count() == len(n)
    done = cli.refined(spark, f"{folder}/all-kc.txt", values, f"{out}/concept", f"{out}/pmi", base=f"{out}/refine")
    assert "KC (lo)" in readers.template(spark, f"{done}/refined-kc.txt").columns


def test_folder_must_be_new(spark, tmp_path):
    assert os.path.basename(writers.run_dir(spark, str(tmp_path), "Mon Jan  1 10:00:00 2024", exist_ok=False)) == "Mon_Jan__1_10-00-00_2024"
    with pytest.raises(FileExistsError):
        writers.run_dir(spark, str(tmp_path), "Mon Jan  1 10:00:00 2024", exist_ok=False)
    with pytest.raises(FileNotFoundError):
        readers.kc_directory(spark, str(tmp_path))
    with pytest.raises(ValueError):
        readers.sidecar(spark, str(tmp_path))


PAGE = """<div class="oli-question" id="q1"><div class="oli-body"><p>Which is <b>flexible</b>?</p><img src="a/b.png"></div>
<div class="oli-multiple-choice"><div value="A">wool (value: A)</div><div value="B">diamond [x]</div></div>
<div class="oli-part" id="p1"><skillref idref=" s1 "></skillref>
<div class="oli-response" match="A" score="1"></div><div class="oli-response" match="B" score="0"></div></div></div>"""


def test_course_pages(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "x" / "b.html").write_text(PAGE.replace('id="q1"', 'id="q2"').replace(" s1 ", "s2") + PAGE.replace("<p>Which is <b>flexible</b>?</p>", "<p> </p>").replace('id="q1"', 'id="q3"') + "<p>unclosed <div class='oli-question'>")
    (tmp_path / "c.html").write_text(PAGE.replace('score="0"', 'score="1"') + PAGE.replace('match="A"', 'match="A,B"') + PAGE.replace('match="A"', 'match="Z"') + PAGE.replace('score="0"', "") + PAGE.replace("wool", ""))
    raw = html.raw_blocks(readers.pages(spark, str(tmp_path)))
    why = [r[0] for r in raw.select(html.verdict().alias("v")).collect()]
    assert sorted(filter(None, why)) == ["blank choice", "no score", "no stem", "no stem", "not one answer", "several values", "unknown value"]
    made = ingest.course_questions(spark, str(tmp_path)).collect()
    assert len(made) == 1
    one = made[0]
    assert (one.question.stem, [(c.label, c.text) for c in one.question.choices], one.answer_key) == ("Which is flexible ?", [("a", "wool"), ("b", "diamond")], "a")
    assert one.images == ["b.png"] and sorted(zip(one.step_name, one.skillref)) == [("q1_p1", "s1"), ("q2_p1", "s2")]


def test_science(spark, tmp_path):
    base = {"question": "q", "choices": ["x", "y"], "answer": 1, "image": None, "skill": "s", "subject": "u", "topic": "t", "category": "c", "grade": "g"}
    data = {"1": base, "2": base | {"image": "i.png"}, "3": base | {"choices": ["x"]}, "4": base | {"skill": "rare"}, "5": base}
    p = tmp_path / "p.json"
    p.write_text(json.dumps(data))
    got = ingest.science_questions(readers.science_raw(spark, str(p)), min_skill=2).orderBy("ord").collect()
    assert [(r.ord, r.id, r.answer_key) for r in got] == [(0, "sciqa-1", "b"), (1, "sciqa-5", "b")]


def test_cv_results(spark, tmp_path):
    from tessella.operators import crossval

    p = tmp_path / "cv.xml"
    p.write_text("<r>" + "".join(f"<model><name>KC (x-{i})</name><aic>{i}.5</aic><rmse>{i}</rmse></model>" for i in range(10)) + "<model><name>odd</name><aic>1</aic></model></r>")
    res = readers.cv_results(spark, str(p))
    assert rows(crossval.bad_runs(res)) == [("", "aic", 1)]
    table = rows(crossval.result_table(res.where("column <> 'odd'")))
    assert ("x", "aic", "mean", 5.0) in table and len(table) == 11
    assert rows(crossval.publication(res.where("column <> 'odd'")))[0][4] == "5.0000 (2.8723)"


def test_embeddings_npy_and_holes(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "e.npy", np.eye(3, 4, dtype=np.float16))
    assert readers.embeddings(spark, str(tmp_path / "e.npy"), 3).count() == 3
    with pytest.raises(ValueError):
        readers.embeddings(spark, str(tmp_path / "e.npy"), 4)
    scores = spark.createDataFrame([(None, 0, -1.0), (0, 0, float("-inf"))], "cond_ord bigint, ord bigint, logp double")
    assert tuple(readers.holes(scores, 1).first()) == (2, 2, 2, 1)
    scores.write.parquet(str(tmp_path / "s"))
    assert rows(readers.log_probs(spark, str(tmp_path / "s"), 1, cond_on_dim=1)) == [(0, 0, float("-inf")), (None, 0, -1.0)]


def test_opportunity_follows_file_order(spark):
    log = spark.createDataFrame([(i, "s", "H (x)", "P", n, f"2024-01-0{9 - i}", "c") for i, n in enumerate(["a", "none", "a", "b", "a"])], "row_id bigint, anon_student_id string, problem_hierarchy string, problem_name string, step_name string, first_transaction_time string, first_attempt string")
    t = spark.createDataFrame([(0, "H x", "P", "a", "k1"), (1, "(H) x", "P", "b", "k2"), (2, "H x", None, "none", "k3")], "row_id bigint, problem_hierarchy string, problem_name string, step_name string, `KC (m (n))` string")
    got = [r["Opportunity (m (n))"] for r in steps.merge(log, t).orderBy("row_id").collect()]
    assert got == [1, None, 2, 1, 3]
    twice = t.union(t)
    with pytest.raises(ValueError):
        steps.merge(log, twice)
    nulls = spark.createDataFrame([(0, None, None, None, None, None, None)], log.schema)
    hit = spark.createDataFrame([(0, None, None, None, "k")], t.schema)
    assert steps.merge(nulls, hit).first()["KC (m (n))"] == "k"


def test_last_label_wins_and_masks(spark):
    table = spark.createDataFrame([(0, "a~b", "x"), (1, "b~a~b", "y"), (2, None, "z"), (3, "c", None)], "ord bigint, steps string, KC string")
    labels = kcmodel.step_labels(table, "steps")
    assert rows(labels) == [("a", "y"), ("b", "y"), ("c", None)]
    t = spark.createDataFrame([(0, "a", "k"), (1, "b", None), (2, "q", "k"), (3, None, "k")], "row_id bigint, step_name string, `KC (o)` string")
    u = spark.createDataFrame([(0, "u"), (1, "u"), (2, None), (3, "u")], "row_id bigint, `KC (Unique-step)` string")
    assert [r[2] for r in rows(kcmodel.fill_template(t, labels, u, "n"))] == ["y", None, None, None]
    both = kcmodel.fill_models(t, [("m2", labels), ("m1", labels.where("step_name = 'b'"))], u)
    assert [tuple(r)[2:] for r in both.orderBy("row_id").collect()] == [("k", None, None), (None, None, None), ("k", None, None), ("k", None, None)]
    free = kcmodel.fill_models(t, [("m2", labels), ("m1", labels.where("step_name = 'b'"))], u, "original")
    assert free.orderBy("row_id").first()["KC (m2)"] == "y"


def test_positions_follow_files_whatever_their_splits(spark, tmp_path):
    """Two tables that run along each other meet row by row, though one is read in many splits and several files."""
    from tessella.operators import evaluate

    n = 3000
    head = "Problem Hierarchy\tProblem Name\tStep Name\tKC (a)\n"
    (tmp_path / "t.txt").write_text(head + "".join(f"h\tp\ts{i}\tk{i}\n" for i in range(n)))
    (tmp_path / "u").mkdir()
    pad = "x" * 200
    for part, (lo, hi) in enumerate([(0, 700), (700, 710), (710, n)]):
        (tmp_path / "u" / f"part-{part}.txt").write_text(f"Notes\tKC (Unique-step)\n" + "".join(f"{pad}\tu{i}\n" if i % 3 else f"{pad}\t \n" for i in range(lo, hi)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        t = evaluate.plain(readers.template(spark, str(tmp_path / "t.txt")))
        assert t.rdd.getNumPartitions() > 1
        u = evaluate.unique_steps(spark, str(tmp_path / "u"), t)
        labels = spark.createDataFrame([(f"s{i}", f"new{i}") for i in range(n)], "step_name string, label string")
        got = {r.row_id: (r.step_name, r["KC (m)"]) for r in kcmodel.fill_template(t, labels, u, "m").collect()}
        assert got == {i: (f"s{i}", f"new{i}" if i % 3 else None) for i in range(n)}
        log = readers.with_row_id(spark.read.text(str(tmp_path / "u")))
        order = [r.value.split("\t")[1] for r in log.orderBy("row_id").collect() if "Notes" not in r.value]
        assert order == [f"u{i}" if i % 3 else " " for i in range(n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "short.txt").write_text("KC (Unique-step)\nu\n")
    with pytest.raises(ValueError):
        evaluate.unique_steps(spark, str(tmp_path / "short.txt"), t)


def test_models_from_outside(spark, bank, tmp_path, monkeypatch):
    """Scorer, labeler and embedder by name, from the command line."""
    out = str(tmp_path / "run")
    cli.concept(spark, bank, f"{out}/concept", verbal=True, q_embeds=True, labeler="models_for_tests:labeler", embedder="models_for_tests:embedder", batch_size=7, num_beams=3)
    made = {r.ord: r.KC for r in spark.read.parquet(f"{out}/concept/bank-concept").collect()}
    assert len(made) == 60 and set(made.values()) == {"can, with 3 beams"}
    vectors = spark.read.parquet(f"{out}/concept/bank-question-embed").collect()
    assert all(r.embedding[1] >= len("Exercise 2:\n") for r in vectors) and len(vectors) == 60
    assert spark.read.csv(f"{out}/concept/bank-concept.csv", header=True, multiLine=True, escape='"').count() == 60
    cli.pmi(spark, bank, f"{out}/pmi", scorer="models_for_tests:scorer", batch_size=50)
    scores = spark.read.parquet(f"{out}/pmi/scores")
    assert readers.holes(scores, 60).first().present == 3660 and scores.where("logp > 0").count() == 0
    with pytest.raises(ValueError):
        from tessella.operators import scoring

        scoring.loaded("nothing")


def test_evaluation_of_a_template_file(spark, tmp_path):
    rows_ = "".join(f"h\tp\ts{i}\t{'ab'[i % 2]}\t{'xy'[i % 2]}\t{'q' if i else ' '}\n" for i in range(20))
    (tmp_path / "t.txt").write_text("Problem Hierarchy\tProblem Name\tStep Name\tKC (true)\tKC (same)\tKC (one)\n" + rows_)
    text = cli.evaluated(spark, kc_temp=str(tmp_path / "t.txt"), true_kc="true", random=True)
    assert "same random" in text and "one" in text
    with pytest.raises(ValueError):
        cli.evaluated(spark, kc_temp=str(tmp_path / "t.txt"), true_kc="none")
    with pytest.raises(ValueError):
        cli.evaluated(spark)


def test_refined_rows_that_keep_their_label(spark):
    """The model of one label is not taken for that of another whose name ends alike."""
    from tessella.operators import refine

    t = spark.createDataFrame([(0, "s0", "a"), (1, "s1", "xa"), (2, "s2", "b")], "row_id bigint, step_name string, `KC (m)` string")
    labels = spark.createDataFrame([("a", "s0", "new"), ("xa", "s1", "xa")], "kc_name string, step_name string, label string")
    changed = refine.relabel(t, "KC (m)", labels, "cpt")
    assert rows(refine.unchanged(changed, t, "KC (m)", "cpt")) == [(1, "cpt-xa", "xa")]
    wide = refine.widen(t, "KC (m)", changed).orderBy("row_id").collect()
    assert [(r["KC (cpt-a)"], r["KC (cpt-xa)"]) for r in wide] == [("new", "a"), ("xa", "xa"), ("b", "b")]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace as Fake

    from tessella.session import shared_dir

    conf = Fake(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(Fake(conf=conf, sparkContext=Fake(getCheckpointDir=lambda: None, master="spark://host:7077")))


def test_names():
    assert names.display_name("KC (a-1)") == "a" and names.true_name("KC (a (b)-1)") == "a (b)-1"
    assert names.display_name("KC (a (b))") == "a (b"
    assert names.values_model("x/LOs-MCQ_kc-values.csv") == "LOs-MCQ"


def test_stream_counts_like_batch(spark, sf, tmp_path):
    from tessella.streaming.opportunity import opportunities

    src = str(tmp_path / "in")
    log = spark.read.parquet(f"{sf}/student_step.parquet").select("row_id", "anon_student_id", F.col("first_attempt").alias("kc_label"))
    middle = log.agg(F.expr("percentile_approx(row_id, 0.5)")).first()[0]
    log.where(F.col("row_id") <= middle).coalesce(1).write.parquet(f"{src}/1")
    log.where(F.col("row_id") > middle).coalesce(1).write.parquet(f"{src}/2")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(src)
    run = opportunities(stream).writeStream.format("memory").queryName("opps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    batch = log.select("row_id", steps.opportunity(F.col("kc_label"), F.col("anon_student_id"), F.col("row_id")).alias("o"))
    assert rows(spark.table("opps").select("row_id", "opportunity")) == rows(batch)
