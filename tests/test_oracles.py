"""Every core query against its SQL, and those without SQL for their shape."""

import pytest

from tessella.plans import core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(name, same):
    same(core.QUERIES[name], core.SQL[name])


def test_every_other_query_is_tested():
    """Those without SQL; each has a test of its own below or in test_shred.py and test_references.py."""
    own = {"ap_cluster", "kc_discover", "random_baseline", "refine_cosine", "refine_pmi", "refine_unchanged", "p1_found", "p1_records", "p1_parts", "p1_choices"}
    assert set(core.QUERIES) - set(core.SQL) == own


def _matrix(rows):
    import numpy as np

    ords = sorted({r.i for r in rows})
    at = {o: n for n, o in enumerate(ords)}
    s = np.zeros((len(ords), len(ords)))
    for r in rows:
        s[at[r.i], at[r.k]] = r.s
    return ords, s


def _check_clusters(got, ords, s):
    """Every point goes to the exemplar most similar to it, an exemplar to itself."""
    import numpy as np

    assert set(got) == set(ords) and all(got[e] == e for e in set(got.values()))
    ex = sorted(set(got.values()))
    at = {o: n for n, o in enumerate(ords)}
    for o in ords:
        if o not in ex:
            best = max(s[at[o], at[e]] for e in ex)
            assert np.isclose(s[at[o], at[got[o]]], best, atol=1e-8)
    assert 1 < len(ex) < len(ords)


def test_ap_cluster(spark, sf):
    ords, s = _matrix(core.reference._cosine(spark, sf).collect())
    _check_clusters({r.ord: r.exemplar for r in core.QUERIES["ap_cluster"](spark, sf).collect()}, ords, s)


def test_kc_discover(spark, sf):
    ords, s = _matrix(core.QUERIES["pmi_normalized"](spark, sf).collect())
    found = core.QUERIES["kc_discover"](spark, sf).collect()
    assert {r.ord for r in found} == set(ords)
    phrases = {r.ord: r.concept for r in core.QUERIES["key_phrases"](spark, sf).collect()}
    exemplar = {r.ord: int(r["KC-raw"].removeprefix("KC-")) for r in found}
    assert all(exemplar[e] == e for e in set(exemplar.values())) and all(r.KC == phrases[exemplar[r.ord]] for r in found)


def test_random_baseline_keeps_margins(spark, sf):
    real = {r.model: r for r in core.QUERIES["metrics_all"](spark, sf).collect()}
    chance = {r.model: r for r in core.QUERIES["random_baseline"](spark, sf).collect()}
    assert set(chance) == set(real) and all(abs(r.adjusted_rand) < 0.15 and 0 <= r.v_measure <= 1 for r in chance.values())


@pytest.mark.parametrize("name,prefix", [("refine_cosine", "qcos"), ("refine_pmi", "pmi")])
def test_refinements(name, prefix, spark, sf):
    """Rows of other labels keep theirs; rows of a refined label carry a concept or nothing."""
    old = {r.row_id: r["KC (lo)"] for r in core.reference._template(spark, sf).collect()}
    phrases = {r.concept for r in core.QUERIES["key_phrases"](spark, sf).collect()}
    found = core.QUERIES[name](spark, sf).collect()
    models = {r.kc_model for r in found}
    assert models and len(found) == len(old) * len(models) and all(m.startswith(f"{prefix}-") for m in models)
    for r in found:
        own = old[r.row_id] == r.kc_model.removeprefix(f"{prefix}-")
        assert (r.kc_label is None or r.kc_label in phrases) if own else r.kc_label == old[r.row_id]


def test_refinements_change_every_label(spark, sf):
    assert core.QUERIES["refine_unchanged"](spark, sf).count() == 0


def test_nested_tables_hang_together(spark, sf):
    """Choices have their records and parts; what is found are the choices that say something."""
    get = lambda n: core.QUERIES[n](spark, sf).collect()
    records, parts, choices, found = get("p1_records"), get("p1_parts"), get("p1_choices"), get("p1_found")
    ids = {r.raw_id for r in records}
    links = {(r.raw_id, r.part_no) for r in parts} | {(i, 0) for i in ids}
    keys = [(r.raw_id, r.part_no, r.choice_no) for r in choices]
    assert len(ids) == len(records) > 0 and len(set(keys)) == len(keys) > 0 and all(k[:2] in links for k in keys)
    said = {k for k, r in zip(keys, choices) if (r.label or "").strip() or (r.text or "").strip()}
    assert {(r.raw_id, r.part_no, r.choice_no) for r in found} == said and {r.keyed for r in found} == {0, 1}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert core.entry(spark, "/root/testdata/sf0.001").count() == 60
