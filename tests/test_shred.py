import json

import pytest
from conftest import rows

from tessella.operators import shred

SCHEMA = "raw_id bigint, payload string"


def found(spark, *payloads):
    return rows(shred.keyed_choices(shred.shred(spark.createDataFrame(list(enumerate(payloads)), SCHEMA))))


def test_shapes(spark):
    listed = {"question": {"stem": "s", "choices": [{"label": "A", "text": "x"}, None, {}, {"label": "b", "text": "y"}]}, "answerKey": " a"}
    keyed = {"question": {"stem": "s", "choices": {"a": "x", "b": "y"}}, "answerKey": ["B", "X "]}
    single = {"question": {"stem": "s", "choices": {"label": "a", "text": "x"}}, "answerKey": "z"}
    inner = {"question": {"stem": "s", "choices": json.dumps([{"text": "x"}])}, "answerKey": "X"}
    parts = {"v": 2, "record": {"question": {"stem": "s", "parts": [{"choices": [{"label": "a", "text": "t"}], "answerKey": "a"}, None, {"choices": [{"label": "a", "text": "t"}]}]}, "answerKey": "a"}}
    got = found(spark, json.dumps(listed), repr(keyed), json.dumps(single), json.dumps(inner), json.dumps(parts))
    assert got == [
        (0, 0, 1, 1), (0, 0, 4, 0),
        (1, 0, 1, 1), (1, 0, 2, 1),
        (2, 0, 1, 0),
        (3, 0, 1, 1),
        (4, 1, 1, 1), (4, 3, 1, 0),
    ]


@pytest.mark.parametrize("payload", [None, "", "null", "[]", "7", '{"question": {"choices": [{"label": "a"', "{'a': 1", '"text"', "[" * 5000])
def test_unreadable_has_no_cases(spark, payload):
    assert found(spark, payload) == []


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", label string, part_no int")
    assert found(spark) == [] and shred.keyed_choices(shred.shred(empty)).count() == 0
    extra = spark.createDataFrame([(1, '{"question": {"choices": [{"label": "a"}]}}', "x", 9)], SCHEMA + ", label string, part_no int")
    assert rows(shred.keyed_choices(shred.shred(extra))) == [(1, 0, 1, 0)]


def test_long_text_and_surrogates(spark):
    long = "x" * 2_000_000
    payload = json.dumps({"question": {"choices": [{"text": long}, {"text": "\ud800"}]}, "answerKey": long})
    assert found(spark, payload) == [(0, 0, 1, 1), (0, 0, 2, 0)]


def test_levels_rebuild_every_table(spark):
    """Shredding and rebuilding gives back the nested form, whatever is missing."""
    record = {"id": "r", "type": "t", "question": {"stem": "s", "parts": [{"id": "p1", "prompt": "q", "answerKey": ["a", None, "b"], "choices": []}, {"id": "p2", "choices": [{"text": "u"}, {"label": "w"}]}]}}
    sh = shred.shred(spark.createDataFrame([(7, json.dumps(record)), (8, "{}")], SCHEMA))
    assert rows(shred.records(sh)) == [(7, "r", "t", "s"), (8, None, None, None)]
    assert rows(shred.parts(sh)) == [(7, 1, "p1", "q"), (7, 2, "p2", None)]
    assert rows(shred.choices(sh)) == [(7, 2, 1, None, "u"), (7, 2, 2, "w", None)]
    assert [r for r in rows(shred.answer_keys(sh)) if r[3]] == [(7, 1, 1, "a"), (7, 1, 3, "b")]


def test_repeated_delivery_counts_twice(spark):
    p = '{"question": {"choices": {"a": "x"}}, "answerKey": "a"}'
    assert found(spark, p, p) == [(0, 0, 1, 1), (1, 0, 1, 1)]


def test_any_form(spark):
    """A form of one's own, three repetitions deep, comes back as tables."""
    import json

    from tessella.operators import shred as H

    form = {"name": None, "a[]": {"x": None, "b[]": {"y": None, "c[]": None}}}
    record = {"name": "n", "a[]": [{"x": "1", "b[]": [{"y": "p", "c[]": ["u", None, "v"]}, None, {"y": None, "c[]": []}]}, {"x": None, "b[]": []}]}
    raw = spark.createDataFrame([(7, json.dumps(record)), (8, None), (9, json.dumps({"name": None, "a[]": []}))], "raw_id bigint, payload string")
    made = H.shred(raw, form=form, read=json.loads)
    table = lambda at: sorted((tuple(r) for r in H.flat(made, at, form=form).collect()), key=repr)
    assert table("") == [(7, "n"), (9, None)]
    assert table("a[]") == [(7, 1, "1"), (7, 2, None)]
    assert table("a[].b[]") == [(7, 1, 1, "p"), (7, 1, 3, None)]
    assert [r for r in table("a[].b[].c[]") if r[4] is not None] == [(7, 1, 1, 1, "u"), (7, 1, 1, 3, "v")]
