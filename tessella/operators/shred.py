"""Deeply nested records as flat tables that keep their parent-child links.

Records of varying notation and shape are read into one nested form and then
shredded by column: for each leaf path the sequence of its values with a
repetition level (the depth of the repeated ancestor that starts anew, 0 for a
new record) and a definition level (how many optional steps of the path are
present).  A table for any repeated ancestor is rebuilt from these sequences
alone, its keys being the positions within each ancestor.

Neither step shuffles: a record's level sequences stay in one row, and
rebuilding works on the levels of a whole Arrow batch at once.

Defined results: null, empty and unreadable payloads and those that are not a
record give no rows; null list elements keep their position with a definition
level that tells they are null; texts may have any length.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The nested form: a name that ends in [] is a repeated group or leaf, the rest are optional leaves.
FORM = {
    "id": None,
    "type": None,
    "stem": None,
    "key[]": None,
    "choice[]": {"label": None, "text": None},
    "part[]": {"id": None, "prompt": None, "key[]": None, "choice[]": {"label": None, "text": None}},
}


def paths(form: dict, above: str = "") -> list[str]:
    """All leaf paths of a nested form, in its order."""
    out = []
    for name, below in form.items():
        out += [above + name] if below is None else paths(below, f"{above}{name}.")
    return out


def slot(path: str) -> str:
    """The column that holds a leaf path."""
    return path.replace("[]", "s").replace(".", "_")


LEVELS = "struct<r: array<tinyint>, d: array<tinyint>, v: array<string>>"


# ---------------------------------------------------------------- reading

def parse(text: str | None):
    """A payload in JSON or as a Python literal; None where it can't be read as a whole."""
    if text is None:
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    try:
        return ast.literal_eval(text.strip())
    except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
        return None


def _text(x) -> str | None:
    if x is None or isinstance(x, (dict, list, tuple, set)):
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return x if isinstance(x, str) else str(x)


def _choice(x) -> dict | None:
    if x is None:
        return None
    if isinstance(x, dict):
        return {"label": _text(x.get("label")), "text": _text(x.get("text"))}
    return {"label": None, "text": _text(x)}


def _choices(x) -> list:
    if isinstance(x, str):
        x = parse(x)
    if isinstance(x, dict):
        if "label" in x or "text" in x:
            return [_choice(x)]
        return [{"label": _text(k), "text": _text(v.get("text") if isinstance(v, dict) else v)} for k, v in x.items()]
    return [_choice(e) for e in x] if isinstance(x, (list, tuple)) else []


def _keys(x) -> list:
    return [_text(k) for k in x] if isinstance(x, (list, tuple, set)) else [] if x is None else [_text(x)]


def read_record(payload: str | None) -> dict | None:
    """A payload in the nested form, whatever its notation and shape."""
    record = parse(payload)
    while isinstance(record, dict) and "question" not in record and isinstance(record.get("record"), (dict, str)):
        inner = record["record"]
        record = parse(inner) if isinstance(inner, str) else inner
    if not isinstance(record, dict):
        return None
    question = record.get("question")
    if isinstance(question, str):
        question = {"stem": question}
    elif not isinstance(question, dict):
        question = {}
    given = lambda name: question.get(name) if question.get(name) is not None else record.get(name)
    parts = given("parts")
    if isinstance(parts, str):
        parts = parse(parts)
    if isinstance(parts, dict):
        parts = [parts]
    return {
        "id": _text(record.get("id")),
        "type": _text(record.get("type")),
        "stem": _text(given("stem")),
        "key[]": _keys(record.get("answerKey") if record.get("answerKey") is not None else question.get("answerKey")),
        "choice[]": _choices(given("choices")),
        "part[]": [
            None
            if not isinstance(p, dict)
            else {
                "id": _text(p.get("id")),
                "prompt": _text(p.get("prompt")),
                "key[]": _keys(p.get("answerKey")),
                "choice[]": _choices(p.get("choices")),
            }
            for p in parts or []
        ]
        if isinstance(parts, (list, tuple))
        else [],
    }


# -------------------------------------------------------------- shredding

def levels(value, form: dict, out: dict, above: str = "", r: int = 0, d: int = 0, depth: int = 0) -> None:
    """Append the levels of one group (or of its absence, ``value`` None) to ``out[path]``."""
    for name, below in form.items():
        path = above + name
        inner = None if value is None else value.get(name)
        if not name.endswith("[]"):
            out[path].append((r, d if inner is None else d + 1, inner))
        elif not inner:
            if below is None:
                out[path].append((r, d, None))
            else:
                levels(None, below, out, path + ".", r, d, depth + 1)
        else:
            for i, element in enumerate(inner):
                at = depth + 1 if i else r
                if below is None:
                    out[path].append((at, d + 1 if element is None else d + 2, element))
                elif element is None:
                    levels(None, below, out, path + ".", at, d + 1, depth + 1)
                else:
                    levels(element, below, out, path + ".", at, d + 2, depth + 1)


def shred(raw: DataFrame, key: str = "raw_id", payload: str = "payload", form: dict | None = None, read: Callable[[str | None], dict | None] | None = None) -> DataFrame:
    """One row per readable record: ``key`` and, of each leaf path, its levels and values.

    ``read`` makes a record of the nested ``form`` of a payload, or None; by
    default the form and the reader of questions.
    """
    form, read = FORM if form is None else form, read or read_record
    leaves = paths(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("r", pa.list_(pa.int8())), ("d", pa.list_(pa.int8())), ("v", pa.list_(pa.string()))])
        for batch in batches:
            ids, cols = [], {p: [] for p in leaves}
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read(text)
                if record is None:
                    continue
                out = {p: [] for p in leaves}
                levels(record, form, out)
                ids.append(rid)
                for p, seq in out.items():
                    r, d, v = zip(*seq)
                    cols[p].append({"r": r, "d": d, "v": [None if x is None else x.encode("utf8", "replace").decode() for x in v]})
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(cols[p], kind) for p in leaves)], names=[key, *map(slot, leaves)])

    kind = dict(raw.dtypes)[key]
    schema = f"`{key}` {kind}, " + ", ".join(f"{slot(p)} {LEVELS}" for p in leaves)
    return raw.where(F.col(payload).isNotNull()).select(key, payload).mapInArrow(run, schema)


# -------------------------------------------------------------- rebuilding

def ordinals(r: np.ndarray, depth: int) -> list[np.ndarray]:
    """From repetition levels, the position (from 1) at each of ``depth`` nested repetitions."""
    out = []
    n = np.arange(len(r))
    for level in range(1, depth + 1):
        first = r < level  # an ancestor starts anew, and with it this count
        step = np.cumsum(r <= level)
        base = np.maximum.accumulate(np.where(first, n, 0))
        out.append(step - step[base] + 1)
    return out


def flat(shredded: DataFrame, ancestor: str, key: str = "raw_id", form: dict | None = None) -> DataFrame:
    """The table of a repeated ancestor (``""`` for the records themselves).

    Columns: ``key``, a position ``n1..nk`` for each repetition on the way and
    the optional leaves straight below the ancestor.  Null elements give no
    row, yet count in the positions.
    """
    steps = [s for s in ancestor.split(".") if s]
    below, form = ancestor + "." if ancestor else "", FORM if form is None else form
    for s in steps:
        form = form[s]
    leaf = form is None
    names = [ancestor] if leaf else [below + n for n, f in form.items() if f is None and not n.endswith("[]")]
    depth, columns = len(steps), [slot(n) for n in names]
    titles = ["value"] if leaf else [n.removeprefix(below) for n in names]
    present = 2 * depth  # the definition level at which the ancestor's element is there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [batch.column(i + 1) for i in range(len(columns))]
            lists = seqs[0].field(0)
            r = lists.flatten().to_numpy(zero_copy_only=False)
            d = seqs[0].field(1).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            keep = pa.array(np.flatnonzero(d >= present))
            numbers = [pa.array(o, pa.int64()).take(keep) for o in ordinals(r, depth)]
            values = [s.field(2).flatten().take(keep) for s in seqs]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)).take(keep), *numbers, *values], names=[key, *(f"n{i + 1}" for i in range(depth)), *titles])

    kind = dict(shredded.dtypes)[key]
    schema = f"`{key}` {kind}, " + "".join(f"n{i + 1} bigint, " for i in range(depth)) + ", ".join(f"`{t}` string" for t in titles)
    return shredded.select(key, *columns).mapInArrow(run, schema)


def records(shredded: DataFrame) -> DataFrame:
    """``raw_id, id, type, stem``."""
    return flat(shredded, "")


def parts(shredded: DataFrame) -> DataFrame:
    """``raw_id, part_no, id, prompt``."""
    return flat(shredded, "part[]").withColumnRenamed("n1", "part_no")


def choices(shredded: DataFrame) -> DataFrame:
    """``raw_id, part_no, choice_no, label, text``; part 0 is the record itself."""
    own = flat(shredded, "choice[]").select("raw_id", F.lit(0).cast("bigint").alias("part_no"), F.col("n1").alias("choice_no"), "label", "text")
    nested = flat(shredded, "part[].choice[]").select("raw_id", F.col("n1").alias("part_no"), F.col("n2").alias("choice_no"), "label", "text")
    return own.unionByName(nested)


def answer_keys(shredded: DataFrame) -> DataFrame:
    """``raw_id, part_no, key_no, value``."""
    own = flat(shredded, "key[]").select("raw_id", F.lit(0).cast("bigint").alias("part_no"), F.col("n1").alias("key_no"), "value")
    nested = flat(shredded, "part[].key[]").select("raw_id", F.col("n1").alias("part_no"), F.col("n2").alias("key_no"), "value")
    return own.unionByName(nested)


def folded(name: Column) -> Column:
    """Without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def keyed_choices(shredded: DataFrame) -> DataFrame:
    """``raw_id, part_no, choice_no, keyed`` of every choice with a label or a text.

    ``keyed`` is 1 if a key of the choice's own part names its label or its
    whole text.  Keys are gathered per part (a part has a handful) and met by
    one equi-join on the parent link.
    """
    keys = (
        answer_keys(shredded)
        .select("raw_id", "part_no", folded(F.col("value")).alias("k"))
        .where("k <> ''")
        .groupBy("raw_id", "part_no")
        .agg(F.collect_set("k").alias("named"))
    )
    own = choices(shredded).where((folded(F.col("label")) != "") | (folded(F.col("text")) != ""))
    hit = F.coalesce(F.array_contains("named", folded(F.col("label"))), F.lit(False)) | F.coalesce(F.array_contains("named", folded(F.col("text"))), F.lit(False))
    return own.join(keys, ["raw_id", "part_no"], "left").select("raw_id", "part_no", "choice_no", F.when(hit, 1).otherwise(0).cast("bigint").alias("keyed"))
