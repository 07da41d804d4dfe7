"""Exact duplicates under a canonical key, kept in an incremental ledger.

The ledger holds, per bucket of the key's hash, the number of copies of every
key and its earliest representative.  A batch is aggregated first (map-side,
so a key that a third of all rows carry shuffles one row per task), then
full-outer-joined with the buckets it touches; counts add up and the earlier
representative stays.  Buckets a batch doesn't touch are not read or written.

Every version is a folder of its own in shared storage, a file per bucket, and
the manifest names, for each bucket, the version that holds it, so a batch that
fails half-way leaves the ledger as it was.  Versions that hold no bucket any
more are deleted.  Once buckets hold more than ``PER_BUCKET`` keys on average
their number is doubled, so that a bucket stays small and a batch of few keys
touches few of many.

Defined results: an empty batch leaves the ledger unchanged; null keys are not
counted; ties on the representative cannot occur as ``ord`` is unique, and
equal ones in two batches are the same row delivered twice and count twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import lookup
from ..session import durable, forget, fresh_path, remove

BUCKETS, PER_BUCKET = 64, 1 << 20
BLOCK = 1024
SCHEMA = "key string, n bigint, first_ord bigint, bucket int"


MANIFEST = "version int, bucket int, held_by int, keys bigint, buckets int"


class Ledger:
    """Counts of canonical keys in ``path`` (by default a fresh folder in the shared one)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "ledger")
        self.version = 0
        self.where: dict[int, tuple[int, int]] = {}  # bucket -> version that holds it and keys in it; at most ``buckets`` entries
        if path:
            self._load()

    def _load(self) -> None:
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return
        if rows:
            self.version = max(r.version for r in rows)
            now = [r for r in rows if r.version == self.version]
            self.buckets = now[0].buckets
            self.where = {r.bucket: (r.held_by, r["keys"]) for r in now}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """``key, n, first_ord, bucket`` of all buckets or of some."""
        held: dict[int, list[int]] = {}
        for bucket, (version, _) in self.where.items():
            if only is None or bucket in only:
                held.setdefault(version, []).append(bucket)
        frames = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{v}").where(F.col("bucket").isin(b)) for v, b in sorted(held.items())]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], SCHEMA)

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def add(self, batch: DataFrame) -> Ledger:
        """Count a batch of ``ord, key``."""
        counted = batch.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_new"), F.min("ord").alias("first_new"))
        fresh = durable(counted.withColumn("bucket", self._bucket()), "batch")
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most ``buckets`` rows
        if not touched:
            return self
        if not any(b in self.where for b in touched):
            merged = fresh.select("key", F.col("n_new").alias("n"), F.col("first_new").alias("first_ord"), "bucket")
        else:
            both = self.read(touched).join(fresh, ["bucket", "key"], "full_outer")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("n_new", F.lit(0))
            merged = both.select("key", n.alias("n"), F.least("first_ord", "first_new").alias("first_ord"), "bucket")
        self._write(merged, dict(self.where))
        forget(fresh)
        while sum(keys for _, keys in self.where.values()) > self.buckets * PER_BUCKET:
            self.buckets *= 2
            self._write(self.read().drop("bucket").withColumn("bucket", self._bucket()), {})
        return self

    def _write(self, rows: DataFrame, kept: dict[int, tuple[int, int]]) -> None:
        """A new version of the buckets of ``rows``; the others stay where ``kept`` has them."""
        version = self.version + 1
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/v{version}")
        sizes = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{version}").groupBy("bucket").count().collect()  # a row per bucket
        before = {v for v, _ in self.where.values()}
        self.where = kept | {r.bucket: (version, r["count"]) for r in sizes}
        self.version = version
        lines = [(version, b, v, keys, self.buckets) for b, (v, keys) in self.where.items()]
        self.spark.createDataFrame(lines, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for old in before - {v for v, _ in self.where.values()}:
            remove(self.spark, f"{self.path}/v{old}")


def count_copies(batches: list[DataFrame], spark: SparkSession) -> Ledger:
    """A ledger over batches of ``ord, key``, added one after the other."""
    ledger = Ledger(spark)
    for batch in batches:
        ledger.add(batch)
    return ledger


def in_batches(keyed: DataFrame, parts: int = 2) -> list[DataFrame]:
    """The rows of ``ord, key`` as consecutive deliveries by ``ord``; every row is in one."""
    top = keyed.agg(F.max("ord")).first()[0]
    if top is None:
        return [keyed]
    step = top // parts + 1
    return [keyed.where((F.col("ord") >= i * step) & (F.col("ord") < (i + 1) * step)) if 0 < i < parts - 1 else keyed.where(F.col("ord") < step) if i == 0 else keyed.where(F.col("ord") >= i * step) for i in range(parts)]


def blocked(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of groups, laid out so that every pair of a group meets in one bounded cell.

    ``members`` has the group's columns, ``id`` and ``n`` (the size of the group).  A group is
    cut by hash into blocks of about ``block`` members; a member of block ``i``
    goes to the cells ``(i, j)`` of all blocks ``j``, so no cell holds more than
    two blocks however large the group is.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), blocks).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("other")
    )


def copy_pairs(keyed: DataFrame, ledger: Ledger) -> DataFrame:
    """``ord_a < ord_b`` of all pairs of rows with one key.

    Only keys with copies take part; the pairs of a large group are spread over
    its cells.
    """
    many = durable(ledger.read().where("n > 1").select("key", "n"), "many")
    members = blocked(lookup(keyed, many, ["key"], "ord", rows="n").select("key", F.col("ord").alias("id"), "n")).drop("n")
    cells = durable(members, "cells")
    left = cells.where("own = lo").select("key", "lo", "hi", F.col("id").alias("a"))
    right = cells.where("own = hi").select("key", "lo", "hi", F.col("id").alias("b"))
    pairs = left.join(right, ["key", "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("ord_a"), F.greatest("a", "b").alias("ord_b"))
