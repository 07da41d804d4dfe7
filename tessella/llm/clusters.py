"""Clusters of questions by what their stems ask: power-iteration spectral clustering.

The affinity of two stems is the inner product of their weighted word vectors.
It is never formed: with ``X`` the sparse matrix of stems by word buckets, a
power step is ``X (X' v)``, normalised by degrees.  A block of vectors is
iterated at once, distributed over the rows of ``X``; what travels is the
bucket side, at most ``BUCKETS`` x ``VECTORS`` numbers however many rows there
are, and the block is kept orthogonal through its Gram matrix.  Sums over tasks
are made in a tree: no task adds more than ``FAN`` parts.  Power steps end when
the block's eigenvalues no longer change, passes of k-means when the centroids
no longer move.  The rows of the block, at unit length, are the embedding;
k-means clusters it in passes that send centroids out and sums back.  Members are ranked by their mean affinity to
their cluster.

Words are weighted by how much they tell of the labels that some rows carry
(divergence of the labels given the word from the labels at large, smoothed),
or where there are no labels by inverse document frequency.  Every labelled row
is used.  k-means starts from the mean of each label's rows; without labels
from rows chosen by hash.  A cluster is named by the label most of its labelled
members carry.

Defined results: every row gets a cluster; a stem without known words goes to
the largest one; labels are compared without case and blanks around or doubled
inside; a label that is no known name is no label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..joins import lookup
from ..session import durable
from .canonical import WORD
from .lookalike import uniform

BUCKETS = 1 << 16
VECTORS = 128
ITERATIONS, SETTLED = 24, 0.01  # power steps at most; relative change of the eigenvalues' sum that ends them
KMEANS_ROUNDS, STILL = 12, 0.01  # passes at most; the farthest move of a centroid that ends them
FAN = 32  # parts that one task adds
SMOOTH = 2.0
FLOOR = 0.02  # weight of a word that tells nothing
SLICES = 16
ROWS = 2048  # rows of a step in numpy


def label_name(name: Column) -> Column:
    """Without case and without outer or doubled blanks."""
    return F.lower(F.btrim(F.regexp_replace(name, r"(?U)\s+", " ")))


def features(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """``ord, label`` (-1: none) ``, idx`` (distinct word buckets of the stem) of every question.

    ``labels`` has ``ord, label``.
    """
    plain = F.lower(uniform(F.col("question.stem")))
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1)))
    idx = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))))
    rows = questions.select("ord", F.coalesce(idx, F.array().cast("array<int>")).alias("idx"))
    return rows.join(labels, "ord", "left").select("ord", F.coalesce("label", F.lit(-1)).alias("label"), "idx")


def bucket_weights(rows: DataFrame) -> np.ndarray:
    """A weight for every bucket; 0 for those no row has."""
    total = rows.count()
    long = rows.select("label", F.explode("idx").alias("b"))
    counts = long.groupBy("b").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("label") >= 0).alias("tot"))
    labelled = rows.where("label >= 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    n = rows.where("label >= 0").count()
    weight = np.zeros(BUCKETS, np.float32)
    if n == 0:
        for r in counts.collect():  # at most BUCKETS rows
            weight[r.b] = np.log(total / r.df) if r.df > 1 else 0.0
        return weight
    prior = labelled.select("label", (F.col("n") / n).alias("prior"))
    p = (F.col("c") + SMOOTH * F.col("prior")) / (F.col("tot") + SMOOTH)
    per = (
        long.where("label >= 0")
        .groupBy("b", "label")
        .agg(F.count(F.lit(1)).alias("c"))
        .join(prior, "label")
        .join(counts, "b")
        .groupBy("b")
        .agg(F.sum(p * F.log(p / F.col("prior"))).alias("seen"), F.sum("prior").alias("mass"))
    )
    share = F.lit(SMOOTH) / (F.col("tot") + SMOOTH)  # what a label not seen with the word keeps of its prior
    rest = F.coalesce(1 - F.col("mass"), F.lit(1.0)) * share * F.log(share)
    for r in counts.join(per, "b", "left").select("b", (F.coalesce("seen", F.lit(0.0)) + rest).alias("w")).collect():  # at most BUCKETS rows
        weight[r.b] = max(r.w, FLOOR)
    return weight


class Block:
    """A run of rows as a sparse matrix of unit rows."""

    def __init__(self, idx: pa.ListArray, weight: np.ndarray):
        sizes = np.diff(idx.offsets.to_numpy())
        self.n = len(sizes)
        self.col = idx.flatten().to_numpy()
        self.row = np.repeat(np.arange(self.n), sizes)
        val = weight[self.col]
        norm = np.sqrt(np.bincount(self.row, val * val, self.n))
        self.val = (val / np.maximum(norm, 1e-12)[self.row]).astype(np.float32)
        self.starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        self.full = np.flatnonzero(sizes > 0)
        order = np.argsort(self.col, kind="stable")
        self.by_col = order
        c = self.col[order]
        self.col_starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
        self.cols = c[self.col_starts] if len(c) else c

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows by what ``w`` has per bucket."""
        out = np.zeros((self.n, *w.shape[1:]), np.float32)
        if len(self.full):
            v = self.val if w.ndim == 1 else self.val[:, None]
            out[self.full] = np.add.reduceat(w[self.col] * v, self.starts, axis=0)
        return out

    def add_to(self, w: np.ndarray, v: np.ndarray) -> None:
        """Add the rows' ``v`` to ``w``, bucket by bucket."""
        if len(self.col):
            o = self.by_col
            x = self.val[o] if v.ndim == 1 else self.val[o][:, None]
            w[self.cols] += np.add.reduceat(v[self.row[o]] * x, self.col_starts, axis=0)


def blocks(batches: Iterator[pa.RecordBatch], weight: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Steps of at most ``ROWS`` rows; the column ``idx`` is the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            step = batch.slice(at, ROWS)
            column = step.column(step.num_columns - 1)
            yield step, Block(pa.ListArray.from_arrays(pa.array(column.offsets.to_numpy() - column.offsets[0].as_py(), pa.int32()), column.flatten()), weight)


def total_of(rows: DataFrame, columns: list[str], partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], fan: int = FAN) -> np.ndarray:
    """The sum over all tasks of an array each makes of its rows.

    The arrays are cut into slices and summed slice by slice in a tree: a task
    adds at most ``fan`` parts, however many tasks there were, and only the sum
    comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.asarray(partial(batches), np.float32).ravel()
        cut = np.array_split(flat, SLICES)
        task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32())
        yield pa.RecordBatch.from_arrays([task, pa.array(range(SLICES), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], names=["task", "slice", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for part in pdf["part"]:
            x = np.frombuffer(part, np.float32).astype(np.float64)
            out = x if out is None else out + x
        return pd.DataFrame({"task": pdf["task"].iloc[:1], "slice": pdf["slice"].iloc[:1], "part": [out.astype(np.float32).tobytes()]})

    kind = "task int, slice int, part binary"
    given = rows.select(*columns)
    left, sent = given.rdd.getNumPartitions(), given.mapInArrow(run, kind)
    while True:
        left = -(-left // fan)
        sent = sent.withColumn("task", F.pmod("task", F.lit(left)).cast("int")).groupBy("slice", "task").applyInPandas(add, kind)
        if left == 1:
            break
    parts = sent.collect()  # SLICES rows
    return np.concatenate([np.frombuffer(p.part, np.float32) for p in sorted(parts, key=lambda p: p.slice)]).astype(np.float64)


class Spectral:
    """The embedding: bucket side ``w`` of the iterated block, and what is needed to apply it."""

    def __init__(self, rows: DataFrame, vectors: int = VECTORS, iterations: int = ITERATIONS, seed: int = 11):
        self.rows, self.spark = rows, rows.sparkSession
        weight = bucket_weights(rows)
        used = np.flatnonzero(weight > 0)
        place = np.zeros(BUCKETS, np.int64)
        place[used] = np.arange(len(used))
        a = max(1, len(used))
        sc = self.spark.sparkContext

        def degrees(batches):
            weight, place, _ = shared.value
            out = np.zeros(a, np.float32)
            for _, b in blocks(batches, weight):
                b.cols, b.col = place[b.cols], place[b.col]
                b.add_to(out, np.ones(b.n, np.float32))
            return out

        shared = sc.broadcast((weight, place, None))
        degree = total_of(rows, ["idx"], degrees).astype(np.float32)
        self.shared = sc.broadcast((weight, place, degree))
        rng = np.random.default_rng(seed)
        w = rng.standard_normal((a, vectors)).astype(np.float32)
        before = None
        for self.steps in range(1, iterations + 1):
            w, found = self._step(w)
            if before is not None and self.steps > 2 and abs(found - before) <= SETTLED * before:
                break
            before = found
        self.w = w

    @staticmethod
    def _open(batches, shared):
        weight, place, degree = shared
        for step, b in blocks(batches, weight):
            b.cols, b.col = place[b.cols], place[b.col]
            scale = 1.0 / np.sqrt(np.maximum(b.times(degree), 1e-9))
            scale[~np.isin(np.arange(b.n), b.full)] = 0.0
            yield step, b, scale.astype(np.float32)

    def _step(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """One power step: the block and the sum of its eigenvalues."""
        a, d = w.shape
        shared, given, opened = self.shared, self.spark.sparkContext.broadcast(w), self._open

        def run(batches):
            out, gram = np.zeros((a, d), np.float32), np.zeros((d, d), np.float64)
            w = given.value
            for _, b, scale in opened(batches, shared.value):
                v = b.times(w) * scale[:, None]
                gram += v.T.astype(np.float64) @ v
                b.add_to(out, v * scale[:, None])
            return np.concatenate([out.ravel(), gram.ravel()])

        both = total_of(self.rows, ["idx"], run)
        given.unpersist()
        out, gram = both[: a * d].reshape(a, d), both[a * d :].reshape(d, d)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        keep = np.maximum(value, value.max() * 1e-7 + 1e-30)
        return (out @ vector / np.sqrt(keep)).astype(np.float32), float(np.sqrt(np.maximum(value, 0)).sum())

    def embed(self, batches: Iterator[pa.RecordBatch], shared, w: np.ndarray):
        """Each step with its block and unit embedding rows (zero for rows without words)."""
        for step, b, scale in self._open(batches, shared):
            v = b.times(w) * scale[:, None]
            yield step, b, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _unit(c: np.ndarray) -> np.ndarray:
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def cluster(rows: DataFrame, labels: int, clusters: int | None = None) -> DataFrame:
    """``ord, cluster, name`` of every row; ``name`` is the number of the label of its cluster (-1: none).

    ``labels`` is how many labels there are; ``clusters`` is only used where no row has one.
    """
    spec = Spectral(rows)
    sc = rows.sparkSession.sparkContext
    shared, w = spec.shared, sc.broadcast(spec.w)
    d = spec.w.shape[1]
    embed, opened = Spectral.embed, Spectral._open

    def embedded(batches):
        for step, b, scale in opened(batches, shared.value):
            v = b.times(w.value) * scale[:, None]
            yield step, v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    k = labels
    if labels == 0 or rows.where("label >= 0").limit(1).count() == 0:
        k = clusters or 60
        seeds = rows.where(F.size("idx") > 0).orderBy(F.xxhash64("ord", F.lit(1))).limit(k).select("ord").collect()
        of = sc.broadcast({r.ord: i for i, r in enumerate(seeds)})  # k entries
        label = lambda step: np.array([of.value.get(o, -1) for o in step.column(0).to_pylist()])
    else:
        label = lambda step: step.column(1).to_numpy()
    k = max(1, k)

    def sums(assign: Callable) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            out, n = np.zeros((k, d)), np.zeros((k, 1 + labels))
            for step, e in embedded(batches):
                to = assign(step, e)
                ok = to >= 0
                np.add.at(out, to[ok], e[ok])
                np.add.at(n, (to[ok], 0), 1)
                own = step.column(1).to_numpy()
                voted = ok & (own >= 0)
                np.add.at(n, (to[voted], 1 + own[voted]), 1)
            return np.concatenate([out.ravel(), n.ravel()])

        both = total_of(rows, ["ord", "label", "idx"], run)
        return both[: k * d].reshape(k, d), both[k * d :].reshape(k, 1 + labels)

    start, n = sums(lambda step, e: label(step))
    centres = _unit(start)
    centres[n[:, 0] == 0] = 0
    votes = n
    for _ in range(KMEANS_ROUNDS):
        given = sc.broadcast(centres.astype(np.float32))
        moved, votes = sums(lambda step, e, c=given: (e @ c.value.T).argmax(axis=1))
        after = np.where(votes[:, :1] > 0, _unit(moved), centres)
        farthest = np.linalg.norm(after - centres, axis=1).max()
        centres = after
        if farthest <= STILL:
            break
    largest = int(votes[:, 0].argmax())
    names = np.where(votes[:, 1:].sum(axis=1) > 0, votes[:, 1:].argmax(axis=1), -1) if labels else np.full(k, -1)
    last = sc.broadcast((centres.astype(np.float32), names.astype(np.int32), largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names, largest = last.value
        for step, e in embedded(batches):
            to = (e @ c.T).argmax(axis=1)
            to[~e.any(axis=1)] = largest
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(to.astype(np.int32)), pa.array(names[to])], names=["ord", "cluster", "name"])

    return rows.select("ord", "label", "idx").mapInArrow(run, "ord bigint, cluster int, name int")


def _labelled(questions: DataFrame, kc_table: DataFrame, kc_values: DataFrame) -> tuple[DataFrame, list[str]]:
    names = sorted(r[0] for r in kc_values.where("kc_name is not null").select("kc_name").distinct().collect())  # the label vocabulary
    spark = questions.sparkSession
    known = spark.createDataFrame(list(enumerate(names)), "label int, proper string").withColumn("n", label_name(F.col("proper"))).groupBy("n").agg(F.min("label").alias("label"))
    given = kc_table.select("ord", label_name(F.col("kc")).alias("n")).join(F.broadcast(known), "n").groupBy("ord").agg(F.min("label").alias("label"))
    return given, names


def question_clusters(questions: DataFrame, kc_table: DataFrame, kc_values: DataFrame) -> DataFrame:
    """``ord, kc``: the cluster of every question by the name most of its labelled members carry."""
    labels, names = _labelled(questions, kc_table, kc_values)
    rows = durable(features(questions, labels), "features")
    spark = questions.sparkSession
    proper = spark.createDataFrame(list(enumerate(names)), "name int, kc string")
    return cluster(rows, len(names)).join(F.broadcast(proper), "name", "left").select("ord", "kc")


def typical(questions: DataFrame, clustered: DataFrame, top: int = 5) -> DataFrame:
    """``kc, size, rank, ord, affinity``: of each cluster its size and its ``top`` most typical questions.

    A member's affinity is its mean affinity to all members of its cluster,
    over idf-weighted words: the inner product with the cluster's mean vector.
    """
    found = durable(clustered.select("ord", F.coalesce("kc", F.lit("")).alias("kc")), "clustered")
    rows = durable(features(questions, questions.select("ord").where("false").withColumn("label", F.lit(-1))), "features")
    weight = rows.sparkSession.sparkContext.broadcast(bucket_weights(rows.withColumn("label", F.lit(-1))))

    def values(batches):
        for step, b in blocks(batches, weight.value):
            starts = np.concatenate([[0], np.cumsum(np.bincount(b.row, minlength=b.n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(b.col.astype(np.int32))), pa.ListArray.from_arrays(pa.array(starts), pa.array(b.val.astype(np.float64)))], names=["ord", "b", "v"])

    long = rows.select("ord", "idx").mapInArrow(values, "ord bigint, b array<int>, v array<double>").join(found, "ord").select("ord", "kc", F.explode(F.arrays_zip("b", "v")).alias("x")).select("ord", "kc", "x.b", "x.v")
    long = durable(long, "long")
    sizes = found.groupBy("kc").agg(F.count(F.lit(1)).alias("size"))
    means = durable(long.groupBy("kc", "b").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n")), "means")
    scored = lookup(long, means, ["kc", "b"], "ord", rows="n").groupBy("ord", "kc").agg(F.sum(F.col("v") * F.col("s")).alias("a"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("kc").orderBy(F.desc("a"), "ord")).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "kc").select(F.when(F.col("kc") != "", F.col("kc")).alias("kc"), "size", "rank", "ord", (F.col("a") / F.col("size")).alias("affinity"))
