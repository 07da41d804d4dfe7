"""Joins that a hot key cannot pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that go to one task, about.
HOT_ROWS = 1 << 17
#: Bytes of a measured table that is broadcast, at most.
BROADCAST_BYTES = 8 << 20


def lookup(big: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "inner", rows: str | None = None) -> DataFrame:
    """Join ``big`` with ``small`` on ``on``; keys that very many rows of ``big`` carry are dealt out.

    A key with more than ``HOT_ROWS`` rows is cut into that many salts as its
    count asks for, taken from the column ``spread`` of ``big``; only the rows
    of ``small`` with such a key are repeated.  All other keys meet in a plain
    join.  ``rows`` names the column of ``small`` that has the count (as it has
    where ``small`` is an aggregate of ``big``); without it the keys are
    counted.  The table of hot keys is broadcast: it has at most a
    ``HOT_ROWS``-th as many rows as ``big``.
    """
    counted = small.select(*on, F.col(rows).alias("_n")) if rows else big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where(F.col("_n") > HOT_ROWS).groupBy(*on).agg(F.ceil(F.max("_n") / HOT_ROWS).cast("int").alias("_salts"))
    if not hot.limit(1).count():
        return big.join(small, on, how)
    hot = F.broadcast(hot)
    few = F.coalesce("_salts", F.lit(1))
    salted = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), few - 1))).drop("_salts")
    dealt = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(F.col(spread), F.lit(5)), few).cast("int")).drop("_salts")
    return dealt.join(salted, [*on, "_salt"], how).drop("_salt")


def broadcast_if_small(small: DataFrame, size: int) -> DataFrame:
    """``small`` with a broadcast hint where its measured ``size`` in bytes allows it."""
    return F.broadcast(small) if size <= BROADCAST_BYTES else small
