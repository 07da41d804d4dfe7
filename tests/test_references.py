import random
from datetime import datetime

from conftest import rows

from tessella.operators import references as R

REF = "src_table string, src_key bigint, ref_field string, ref_value string, at timestamp_ntz"
PAR = "ref_field string, key_value string, since timestamp_ntz, until timestamp_ntz"


def run(spark, refs, parents):
    return rows(R.orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)))


def brute(refs, parents):
    fold = lambda s: s.strip().lower()
    out = []
    for t, k, f, v, at in refs:
        if v is None or not v.strip():
            continue
        own = [(s, u) for pf, pv, s, u in parents if pf == f and pv is not None and fold(pv) == fold(v)]
        if not own:
            out.append((t, k, f, v, "missing"))
        elif at is not None and not any((s is None or at >= s) and (u is None or at < u) for s, u in own):
            out.append((t, k, f, v, "deleted" if any(u is not None and at >= u for _, u in own) else "late"))
    return sorted(out, key=repr)


def test_kinds(spark):
    day = lambda d: datetime(2024, 3, d)
    parents = [("f", "Alpha", day(5), day(20)), ("f", "beta", None, None), ("g", "gamma", None, None)]
    refs = [
        ("t", 1, "f", " ALPHA ", day(5)), ("t", 2, "f", "alpha", day(4)), ("t", 3, "f", "alpha", day(20)), ("t", 4, "f", "alpha", None),
        ("t", 5, "f", "gamma", day(9)), ("t", 6, "f", "nobody", None), ("t", 7, "f", None, day(1)), ("t", 8, "f", "  ", day(1)),
        ("t", 9, "f", "Beta\t", day(9)), ("t", 10, "g", "GAMMA", None), ("t", 5, "f", "gamma", day(9)),
    ]
    got = run(spark, refs, parents)
    assert got == brute(refs, parents)
    assert [r[4] for r in got if r[1] in (2, 3)] == ["late", "deleted"]


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    when = lambda: None if rng.random() < 0.1 else datetime(2023, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    names = [f"n{i}" for i in range(60)]
    parents = [("f" if i % 2 else "g", n.upper() if i % 3 else n, when() if i % 4 == 0 else None, when() if i % 5 == 0 else None) for i, n in enumerate(names) if i % 7]
    parents.append(("f", "n1", datetime(2023, 2, 1), datetime(2023, 2, 2)))  # two targets of one name
    refs = [("t", i, rng.choice("fg"), rng.choice(["hot"] * 30 + names + [None, " "]), when()) for i in range(3000)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_empty_sides(spark):
    one = [("t", 1, "f", "x", datetime(2024, 1, 1))]
    assert run(spark, [], [("f", "x", None, None)]) == []
    assert run(spark, one, []) == [("t", 1, "f", "x", "missing")]
    assert run(spark, [], []) == []


def test_log_references_with_dirt(spark):
    steps = spark.createDataFrame([(1, "P", "S", "2024-01-01 00:00:00.5", "x"), (2, None, " ", "not a time", "x"), (3, "p ", "s", None, "x")], "row_id bigint, problem_name string, step_name string, first_transaction_time string, at string")
    questions = spark.createDataFrame([(0, ["s", None, "s"]), (1, None), (2, [])], "ord bigint, ds_step_name array<string>")
    refs = R.log_references(steps, questions)
    problems = spark.createDataFrame([("p", datetime(2024, 1, 1, 0, 0, 1), None)], "problem_name string, added_at timestamp_ntz, retired_at timestamp_ntz")
    template = spark.createDataFrame([(1, None), (2, "other")], "row_id bigint, step_name string")
    parents = R.log_parents(problems, questions, template)
    found = R.orphans(refs, parents)
    assert rows(found) == [("questions", 0, "ds_step_name", "s", "missing")] * 2 + [("student_step", 1, "problem_name", "P", "late")]
    report = rows(R.orphan_report(R.failing(refs, parents), refs))
    assert ("student_step", "problem_name", "2024-01", "late", 1, 1) in report
