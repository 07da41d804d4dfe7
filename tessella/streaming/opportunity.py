"""Opportunity counts over a stream of student steps.

The same count as ``operators.steps.opportunity``, for steps that arrive in
order: the state of a student is a count per label, so it grows with the labels
a student meets, not with the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "row_id bigint, anon_student_id string, kc_label string, opportunity bigint"


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    labels, counts = state.get if state.exists else ([], [])
    seen = dict(zip(labels, counts))
    rows = pd.concat(list(frames)).sort_values("row_id")
    out = []
    for label in rows["kc_label"]:
        if label is None or label != label:
            out.append(None)
        else:
            seen[label] = seen.get(label, 0) + 1
            out.append(seen[label])
    state.update((list(seen), list(seen.values())))
    yield pd.DataFrame({"row_id": rows["row_id"].to_numpy(), "anon_student_id": key[0], "kc_label": rows["kc_label"].to_numpy(), "opportunity": pd.array(out, "Int64")})


def opportunities(steps: DataFrame) -> DataFrame:
    """``row_id, anon_student_id, kc_label, opportunity`` of a stream of the first three; null without a label."""
    return (
        steps.select("row_id", "anon_student_id", "kc_label")
        .groupBy("anon_student_id")
        .applyInPandasWithState(_count, OUT, "labels array<string>, counts array<bigint>", "append", GroupStateTimeout.NoTimeout)
    )
