"""The registered queries over the smallest data folder, and SQL where there is some."""

import pytest

from tessella.llm import plans

COLUMNS = {
    "p2_found": ["ord_a", "ord_b"], "p3_found": ["ord_a", "ord_b"], "p4_found": ["ord", "field_name", "pos"], "p5_found": ["ord_a", "ord_b"],
    "p7_found": ["ord", "kc"], "p8_ids": ["doc_id", "ids"], "p9_found": ["source"], "p10_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(name, spark, sf):
    df = plans.QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name]
    found = df.collect()
    assert found and len(found) == len(set(map(str, found)))


def test_copies_are_the_found_pairs(spark, sf):
    """One row per class of copies: classes and pairs tell the same."""
    pairs = {tuple(r) for r in plans.p2_found(spark, sf).collect()}
    counts = {r.ord: r.n_copies for r in plans.p2_copies(spark, sf).collect()}
    follow = {b for _, b in pairs}
    every = {r.ord for r in spark.read.parquet(f"{sf}/questions.parquet").select("ord").collect()}
    assert set(counts) == every - follow and sum(counts.values()) == len(every)
    assert all(counts[o] == 1 + sum(a == o for a, _ in pairs) for o in counts)


def test_groups_are_those_of_the_links(spark, sf):
    links = [tuple(r) for q in (plans.p2_found, plans.p3_found) for r in q(spark, sf).collect()]
    near = [tuple(r) for r in plans.p3_found(spark, sf).collect()]
    got = {r.ord: r for r in plans.p3_groups(spark, sf).collect()}
    assert set(got) == {o for pair in links for o in pair}
    assert all(got[a].group_ord == got[b].group_ord <= min(a, b) for a, b in links)
    assert all(got[o].n_links == sum(o in pair for pair in near) for o in got)


def test_uniform_texts(spark, sf):
    from pyspark.sql import functions as F

    from tessella.llm import lookalike as L

    got = plans.p4_uniform(spark, sf)
    texts = L.question_texts(spark.read.parquet(f"{sf}/questions.parquet"))
    both = got.join(texts, ["ord", "field_name", "pos"]).collect()
    assert len(both) == texts.count() == got.count() and all(r.uniform_text == L.unify(r.txt) for r in both)
    found = {tuple(r) for r in plans.p4_found(spark, sf).collect()}
    assert {(r.ord, r.field_name, r.pos) for r in both if r.uniform_text != r.txt} == found
    assert got.where(F.col("uniform_text").isNull()).count() == 0


def test_typical_questions(spark, sf):
    sizes = {}
    for r in plans.p7_found(spark, sf).collect():
        sizes[r.kc] = sizes.get(r.kc, 0) + 1
    top = plans.p7_typical(spark, sf).collect()
    assert {(r.kc, r["size"]) for r in top} == set(sizes.items())
    for kc in sizes:
        own = sorted((r for r in top if r.kc == kc), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == min(5, sizes[kc])
        assert all(a.affinity >= b.affinity for a, b in zip(own, own[1:]))


def test_mixture_of_the_tables(spark, sf):
    targets = {r.source.strip().lower(): r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    shares = {r.source.strip().lower(): r for r in plans.p9_shares(spark, sf).collect()}
    mixed = plans.p9_mix(spark, sf).collect()
    assert set(shares) == set(targets) and len({r.doc_id for r in mixed}) == len(mixed)
    assert all(0 < r.copies <= targets[r.source].max_repeats for r in mixed)
    for s, r in shares.items():
        assert r.used == sum(m.tokens * m.copies for m in mixed if m.source == s) <= r.have * targets[s].max_repeats
    assert sum(r.share for r in shares.values()) == pytest.approx(1.0)
    assert {r.source for r in plans.p9_found(spark, sf).collect()} == {r.source for r in shares.values() if r.short}


def test_offsets_cover_every_text(spark, sf):
    got = {r.doc_id: r for r in plans.p8_offsets(spark, sf).collect()}
    ids = {r.doc_id: r.ids for r in plans.p8_ids(spark, sf).collect()}
    assert set(got) == set(ids) and all(list(got[d].ids) == list(ids[d]) and len(got[d].first_byte) == len(ids[d]) for d in ids)
    assert all(not r.ids or r.first_byte[0] == 0 for r in got.values())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


def test_nothing_else_imports_this_package():
    import os
    import re

    import tessella

    root = os.path.dirname(tessella.__file__)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(os.path.join(folder, f)).read(), re.M)
