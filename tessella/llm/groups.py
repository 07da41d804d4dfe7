"""Connected groups of linked items, by alternating stars.

A large star hangs the greater neighbours of an item on the least of its
neighbourhood, a small star its lesser ones and itself; repeated in turn they
leave every item linked to the least of its group alone, in a number of rounds
that grows with the logarithm of the longest chain.  Each round is an
aggregation and a lookup over links (hot items salted by their counts), written
to shared storage; no neighbourhood is ever gathered, so an item may have any
number of links.  The table of a round is deleted when the next is written.

Defined results: links may be repeated and go either way; a link of an item to
itself is none; items without links are in no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import lookup
from ..session import durable, forget

ROUNDS = 60


def _hang(links: DataFrame) -> DataFrame:
    """``u, v, least`` with the least of ``u`` and its neighbours ``v``."""
    least = durable(links.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("least"), F.count(F.lit(1)).alias("n")), "least")
    return lookup(links, least, ["u"], "v", rows="n").drop("n")


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _hang(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    hung = _hang(down)
    ends = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).union(hung.select("u", F.col("least").alias("v")))
    return ends.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``item, group_id``: every linked item with the least item of its group; ``links`` has ``a, b``."""
    now = durable(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        after = durable(_small(_large(now)), "links")
        forget(now)
        now = after
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"groups are not joined after {ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("item"), F.col("v").alias("group_id"))
    return leaves.unionByName(leaves.select(F.col("group_id").alias("item"), "group_id").distinct())
