"""Ordered pairs of questions, laid out in cells of bounded size.

All pairs of ``n`` questions are a result in themselves.  They are made by
cutting the questions into blocks, each packed into one row; the partitions of
the blocks then meet as a Cartesian product, in which every task reads its two
partitions.  So a question is shuffled once, however many others it meets, no
side is broadcast, and no task holds more than two partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..session import durable

BLOCK = 256
#: Pairs of a batch, about.
SLICE = 1 << 17
#: Blocks from which on they are packed where their rows are read and read as they lie; opened blocks of the second side a task keeps, at most.
MANY, OPEN = 64, 32
#: Questions packed into one row, about; rows kept in memory on one side of a product; partitions of a side and blocks in each.
PACK, HELD, SIDE, PER_SIDE = 2048, 4096, 12, 4


def all_pairs(rows: DataFrame, n: int, first: dict[str, Column], second: dict[str, Column]) -> DataFrame:
    """Every ordered pair as one row of expressions over either side."""
    parts = max(SIDE, -(-n // HELD))
    rows = durable(rows, "sides")
    a = rows.repartition(parts).select(*(c.alias(k) for k, c in first.items()))
    b = rows.repartition(parts).select(*(c.alias(k) for k, c in second.items()))
    return a.crossJoin(b.hint("shuffle_replicate_nl"))


def packed(rows: DataFrame, scattered: bool = False) -> DataFrame:
    """``block, rows``: a row per block of about ``PACK`` rows, by ``ord``; by a hash of it where the ``ord`` are ``scattered``."""
    block = F.floor(F.col("ord") / PACK)
    if scattered:
        block = F.pmod(F.xxhash64("ord", F.lit(29)), F.lit(max(1, -(-rows.count() // PACK))))
    return durable(rows.groupBy(block.alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows")), "blocks")


def packed_in_place(rows: DataFrame) -> DataFrame:
    """The same without a shuffle: blocks of what each task reads, numbered by task and within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                some = batch.slice(at, PACK).to_struct_array()
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pa.concat_arrays([some]))], names=["block", "rows"])
                number += 1

    return rows.mapInArrow(run, StructType([StructField("block", LongType()), StructField("rows", ArrayType(rows.schema))]))


def opened(rows: pa.StructArray) -> dict[str, np.ndarray | pa.Array]:
    """The columns of a packed block in the order of ``ord``; numbers as numpy arrays, lists as they are."""
    columns = dict(zip((f.name for f in rows.type), rows.flatten()))
    order = pa.array(np.argsort(columns["ord"].to_numpy(zero_copy_only=False), kind="stable"))
    columns = {k: c.take(order) for k, c in columns.items()}
    return {k: c if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for k, c in columns.items()}


def rows_of(names: list[str], first: np.ndarray, second: np.ndarray, *values: np.ndarray, digits: tuple[int | None, ...] = (None,)) -> Iterator[pa.RecordBatch]:
    """A matrix (or several) as rows: ``first`` and ``second`` of each pair and what it has there, rounded to its ``digits``."""
    step = max(1, SLICE // max(1, len(second)))
    again = np.tile(second, min(step, len(first)))
    for at in range(0, len(first), step):
        own = np.repeat(first[at : at + step], len(second))
        columns = [own, again[: len(own)], *(rounded(v[at : at + step], d).ravel() for v, d in zip(values, digits, strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from zero, and no negative zero, as SQL rounds; ``None`` leaves all digits."""
    if digits is None:
        return values
    out = np.abs(values)
    out *= 10.0**digits
    out += 0.5
    np.floor(out, out=out)
    out /= 10.0**digits
    np.copysign(out, values, out=out)
    out += 0.0
    return out


def in_cells(rows: DataFrame | None, opening: Callable[[dict], object], kernel: Callable[..., Iterator[pa.RecordBatch]], schema: str, second: DataFrame | None = None, once: bool = False, whole: bool = False, blocks: DataFrame | None = None) -> DataFrame:
    """A kernel over the two blocks of every cell: ``kernel(a, b)`` gives batches of rows.

    ``opening`` makes of a block's columns what the kernel takes; it is kept
    while the block is met again.  A ``second`` is taken to be the smaller side:
    ``rows`` meet it where they are read, without a shuffle.  ``once`` gives only the cells whose first
    block is not after their second.  With ``whole`` the kernel gets an iterator
    of all cells of a task and may sum up over them.  ``blocks`` are ``rows``
    that are packed already.
    """
    # As few tasks as keep a task's blocks few.
    spread = lambda d: d.repartition(min(max(1, c := d.count()), max(SIDE, -(-c // PER_SIDE))))
    if second is not None:
        own, other = packed_in_place(rows), packed(second, scattered=True)
    elif blocks is None and rows.count() > MANY * PACK:  # what is stored and shuffled of them is one copy
        own = other = durable(packed_in_place(rows), "blocks")
        if own.rdd.getNumPartitions() >= SIDE // 2:
            spread = lambda d: d
    else:
        own = other = packed(rows) if blocks is None else blocks
    a = (spread(own) if second is None else own).select(F.col("block").alias("ci"), F.col("rows").alias("a"))
    b = spread(other).select(F.col("block").alias("ck"), F.col("rows").alias("b")).hint("shuffle_replicate_nl")
    cells = a.join(b, F.col("ci") <= F.col("ck")) if once else a.crossJoin(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict] = {"a": {}, "b": {}}

        def held(side: str, block: int, rows: pa.ListScalar):
            own = kept[side]
            if block in own:
                return own[block]
            if side == "a":
                own.clear()
            now = opening(opened(rows.values))
            if len(own) < OPEN:  # the first ones stay: all are met in turn
                own[block] = now
            return now

        def met() -> Iterator[tuple]:
            for batch in batches:
                for ci, x, ck, y in zip(batch.column("ci").to_pylist(), batch.column("a"), batch.column("ck").to_pylist(), batch.column("b")):
                    yield held("a", ci, x), held("b", ck, y)

        if whole:
            yield from kernel(met())
        else:
            for x, y in met():
                yield from kernel(x, y)

    return cells.mapInArrow(run, schema)


def in_groups(members: DataFrame, sizes: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """A kernel over all ordered pairs within groups: ``members`` has ``grp, ord``, ``sizes`` has ``grp, n``.

    A group is cut by hash into blocks of about ``block`` members that meet in
    cells, so a cell is bounded however large a group is.
    """
    own = F.pmod(F.xxhash64("ord", F.lit(23)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = members.join(sizes.select("grp", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "grp")
    keys = ["grp", "ci", "ck"]
    a = dealt.withColumn("ci", own).withColumn("ck", every).drop("blocks")
    b = dealt.withColumn("ck", own).withColumn("ci", every).drop("blocks")
    b = b.select(*(F.col(c).alias(c) for c in b.columns))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(kernel, schema)
