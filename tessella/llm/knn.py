"""The k most similar vectors of every vector.

Vectors are dealt to shards by their nearest pivot (k-means on a bounded
sample); a shard above ``CAP`` is cut by hash, so building never depends on how
the vectors are spread.  Each shard is indexed by a robust-pruned directed graph
that is written as a table.  Every vector is a query, in blocks of bounded size:
a beam search over a shard's graph proposes neighbours, which are then ranked
by their exact cosine.

A query goes to the ``PROBES`` shards of its nearest pivots first, all of their
cuts included.  If all neighbours found come from the very nearest one it is
done; else it is taken to ``GROW`` times as many shards, and on, until a round
brings no neighbour that is nearer than those it has, or all shards are asked.
So vectors that lie in clusters ask few shards and vectors without any
structure ask most; recall holds for both.

Equal directions are one point: the point keeps the number of its vectors and
its smallest ``ord``s, so a group of equal vectors of any size costs one search.

Every vector is indexed and every vector asks.  Recall against brute force is
measured in the tests.  Fitted on a sample: only the pivots (``PER_PIVOT`` for
each, ``SAMPLE`` at most).  Beyond ``MOST_PIVOTS`` times ``TARGET`` vectors
(134 million) shards grow and are cut.

Defined results: null vectors, those with a null, infinite or NaN number, those
of another length than most, and all-zero ones take no part; repeated rows of
one ``ord`` count once; of equally near
ones the smaller ``ord`` is nearer; with fewer than k others, all others come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..joins import lookup
from ..session import durable, forget
from . import vamana

#: Vectors the pivots are fitted on: for each pivot, and at most (about: they are taken by hash).
PER_PIVOT, SAMPLE = 512, 131_072
#: Vectors a pivot stands for on average, and pivots at most.
TARGET, MOST_PIVOTS = 4096, 32_768
#: Vectors in one graph, and queries in one block, at most (about, as they are dealt by hash).
CAP, QUERY_BLOCK = 8192, 16384
PROBES, GROW = 3, 4
DIGITS = 12  # cosines that agree to so many digits are equal
SAME = 1e9  # directions that agree to so many parts are one point


def _mixed(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One more number into a 64-bit hash per row."""
    h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector without nulls, and their numbers one after the other."""
    flat = column.flatten()
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths().fill_null(0)), 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32)  # a null becomes NaN
    return sizes, values


def points(vectors: DataFrame, key: str = "ord", vector: str = "embedding") -> tuple[DataFrame, DataFrame, int]:
    """``point, vec`` of every direction (as first given), ``point, id`` of every vector, and the number of points."""
    given = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec"))
    common = given.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).collect()
    size = common[0].s if common else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = _rows(batch.column(1))
            right = np.flatnonzero(sizes == size)
            start = np.cumsum(sizes) - sizes
            x = flat[start[right][:, None] + np.arange(size)].astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            right, x, norm = right[ok], x[ok], norm[ok]
            q = np.rint(x / norm[:, None] * SAME).astype(np.int64).view(np.uint64)
            h, h2 = np.full(len(q), 1, np.uint64), np.full(len(q), 2, np.uint64)
            for d in range(size):
                h, h2 = _mixed(q[:, d], h), _mixed(q[:, d] + np.uint64(d), h2)
            take = pa.array(right)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), batch.column(1).take(take)], names=["id", "h", "h2", "vec"])

    unit = durable(given.where((F.size("vec") == size) & (F.size("vec") > 0)).mapInArrow(run, "id bigint, h bigint, h2 bigint, vec array<float>"), "unit")
    # Only numbers are grouped; the vectors move once, to their points.
    groups = durable(unit.groupBy("h", "h2").agg(F.min("id").alias("point"), F.count(F.lit(1)).alias("n")), "groups")
    members = durable(lookup(unit.select("id", "h", "h2"), groups, ["h", "h2"], "id", rows="n").select("point", "id").distinct(), "members")
    firsts = groups.select(F.col("point").alias("id"), "h", "h2")
    found = unit.join(firsts, ["id", "h", "h2"]).select(F.col("id").alias("point"), "vec")
    if groups.where("n > 1").limit(1).count():  # else every row is its own point
        found = found.groupBy("point").agg(F.min_by("vec", F.lit(0)).alias("vec"))
    return durable(found, "points"), members, groups.select("point").distinct().count()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots(found: DataFrame, count: int) -> np.ndarray:
    """Unit pivots from a bounded sample of the points."""
    n = int(min(MOST_PIVOTS, max(1, -(-count // TARGET))))
    want = min(SAMPLE, max(8192, PER_PIVOT * n))
    share = int(min(1.0, want / max(count, 1)) * (1 << 30))
    rows = found.where(F.pmod(F.xxhash64("point", F.lit(3)), F.lit(1 << 30)) <= share).select("point", "vec").toPandas().sort_values("point")
    if not len(rows):
        return np.zeros((1, 1), np.float32)
    x = _unit(np.array(rows["vec"].tolist())).astype(np.float32)
    c = x[np.random.default_rng(5).permutation(len(x))[: min(n, len(x))]].copy()
    for _ in range(6 if n <= 2048 else 1):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        total = np.zeros((len(c), x.shape[1]))
        np.add.at(total, near, x)
        full = np.bincount(near, minlength=len(c)) > 0
        c[full] = (total[full] / np.maximum(np.linalg.norm(total[full], axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return c


def deal(found: DataFrame, centres: np.ndarray, low: int, high: int) -> DataFrame:
    """``shard, rank, point, vec``: each point under its pivots from the ``low``-th nearest (0: the nearest) to before the ``high``-th."""
    given = found.sparkSession.sparkContext.broadcast(centres)  # at most MOST_PIVOTS vectors
    high = min(high, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = given.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = np.argsort(-(_unit(_matrix(part.column(1))).astype(np.float32) @ c.T), axis=1, kind="stable")[:, low:high]
                each = near.shape[1]
                take = pa.array(np.repeat(np.arange(part.num_rows), each))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(low, low + each, dtype=np.int32), part.num_rows)), part.column(0).take(take), part.column(1).take(take)],
                    names=["shard", "rank", "point", "vec"],
                )

    return found.select("point", "vec").mapInArrow(run, "shard int, rank int, point bigint, vec array<float>")


def index(homes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``shard, cut, ids, vecs, graph, entries``: one graph per shard and cut, as a table."""
    placed = homes.join(F.broadcast(cuts), "shard").withColumn("cut", F.pmod(F.xxhash64("point", F.lit(11)), F.col("cuts")).cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point")
        x = np.array(pdf["vec"].tolist(), np.float32)
        graph, entries = vamana.build(_unit(x).astype(np.float32))
        return pd.DataFrame(
            {"shard": [pdf["shard"].iloc[0]], "cut": [pdf["cut"].iloc[0]], "ids": [pdf["point"].to_numpy(np.int64).tobytes()], "vecs": [x.tobytes()], "graph": [graph.tobytes()], "entries": [entries.tobytes()]}
        )

    schema = "shard int, cut int, ids binary, vecs binary, graph binary, entries binary"
    return placed.select("shard", "cut", "point", "vec").groupBy("shard", "cut").applyInPandas(make, schema)


def ask(queries: DataFrame, built: DataFrame, cuts: DataFrame, k: int) -> DataFrame:
    """``point, rank, near, cos``: of each graph of the shards ``queries`` names the ``k`` nearest other points."""
    keys = ["shard", "cut", "block"]
    asked = durable(queries, "asked")
    sizes = durable(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")).join(F.broadcast(cuts), "shard"), "sizes")  # a row per shard
    laid = (
        asked.join(F.broadcast(sizes), "shard")
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts").cast("int") - 1)))
        .withColumn("block", F.pmod(F.xxhash64("point", F.lit(13)), F.col("blocks")).cast("int"))
        .select(*keys, "rank", "point", "vec")
    )
    graphs = built.join(F.broadcast(sizes.select("shard", "blocks")), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"point": pd.Series(dtype="int64"), "rank": pd.Series(dtype="int32"), "near": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})
        g = held.iloc[0]
        ids = np.frombuffer(g["ids"], np.int64)
        x = _unit(np.frombuffer(g["vecs"], np.float32).reshape(len(ids), -1))
        graph = np.frombuffer(g["graph"], np.int32).reshape(len(ids), -1)
        entries = np.frombuffer(g["entries"], np.int32)
        x32 = x.astype(np.float32)
        out = []
        who, vecs, ranks = asked["point"].to_numpy(np.int64), asked["vec"], asked["rank"].to_numpy(np.int32)
        beam = max(vamana.BEAM, 2 * k)
        for at in range(0, len(who), vamana.BATCH):
            q = _unit(np.array(vecs.iloc[at : at + vamana.BATCH].tolist()))
            own = who[at : at + vamana.BATCH]
            here = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            start = np.where(ids[here] == own, here, entries[0]).astype(np.int32)
            found, _ = vamana.search(x32, graph, entries, q.astype(np.float32), start, beam)
            real = (found >= 0) & (ids[np.maximum(found, 0)] != own[:, None])
            cos = np.where(real, np.einsum("ijk,ik->ij", x[np.maximum(found, 0)], q), -9.0).round(DIGITS)
            best = np.lexsort((ids[np.maximum(found, 0)], -cos), axis=1)[:, :k]
            keep = np.take_along_axis(real, best, 1)
            each = best.shape[1]
            out.append(
                pd.DataFrame({"point": np.repeat(own, each)[keep.ravel()], "rank": np.repeat(ranks[at : at + vamana.BATCH], each)[keep.ravel()], "near": ids[np.take_along_axis(found, best, 1)[keep]], "cos": np.take_along_axis(cos, best, 1)[keep]})
            )
        return pd.concat(out, ignore_index=True)

    return laid.groupBy(*keys).cogroup(graphs.groupBy(*keys)).applyInPandas(answer, "point bigint, rank int, near bigint, cos double")


def _best(near: DataFrame, k: int) -> DataFrame:
    """``point, best``: the ``k`` first of ``point, rank, near, cos`` as structs; a handful of rows per point are gathered."""
    each = F.struct((-F.col("cos")).alias("c"), F.col("near").alias("near"), F.col("rank").alias("rank"))
    return near.groupBy("point").agg(F.slice(F.sort_array(F.collect_list(each)), 1, k).alias("best"))


def nearest_points(found: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """``point, best``: the nearest other points of every point, with ``c`` (minus the cosine) and ``near``."""
    homes = durable(deal(found, centres, 0, 1), "homes")
    cuts = durable(homes.groupBy("shard").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CAP), F.lit(1)).cast("int").alias("cuts")), "cuts")  # at most MOST_PIVOTS rows
    built = durable(index(homes, cuts), "graphs")
    forget(homes)
    low, high, open_ = 0, PROBES, found
    done: list[DataFrame] = []
    before = None
    while True:
        near = ask(deal(open_, centres, low, high), built, cuts, k)
        if before is not None:
            near = near.unionByName(before.select("point", F.explode("best").alias("b")).select("point", "b.rank", "b.near", (-F.col("b.c")).alias("cos")))
        now = durable(_best(near, k), "best")
        # The first round must find all in the nearest shard, a later one nothing that is nearer.
        still = F.exists("best", lambda b: b["rank"] >= max(low, 1)) | (F.size("best") < k)
        if high >= len(centres):
            done.append(now)
            break
        done.append(now.where(~still))
        before = now.where(still)
        missing = open_.select("point").join(now.select("point"), "point", "left_anti").count() if low == 0 else 0
        if not before.limit(1).count() and not missing:
            break
        left = open_.join(now.where(~still).select("point"), "point", "left_anti")
        open_ = durable(left, "open")
        low, high = high, high * GROW
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def neighbours(vectors: DataFrame, k: int = 5, key: str = "ord", vector: str = "embedding") -> DataFrame:
    """``id, near, cos``: the ``k`` nearest of every vector."""
    found, members, count = points(vectors, key, vector)
    best = nearest_points(found, pivots(found, count), k)
    # Every point with the smallest ids of its equals.
    rank = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    few = members.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("point").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    sizes = members.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    few = durable(few.join(sizes, "point"), "few")
    links = durable(best.select("point", F.explode("best").alias("b")).select("point", "b.c", "b.near"), "links")
    # A point of one vector stands for itself; only the others have more to show.
    equal = few.where("n > 1").select(F.col("point").alias("near"), "ids")
    around = links.join(equal, "near", "left").select("point", F.explode(F.transform(F.coalesce("ids", F.array("near")), lambda i: F.struct("c", i.alias("id")))).alias("x"))
    own = few.select("point", F.explode(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("id")))).alias("x"))
    # One list per point; a member of the point drops itself and takes the first k.
    lists = around.unionByName(own).groupBy("point").agg(F.slice(F.sort_array(F.collect_list("x")), 1, k + 1).alias("xs"))
    lists = durable(lists.join(few.select("point", "n"), "point"), "lists")
    each = lookup(members, lists, ["point"], "id", rows="n")
    mine = F.slice(F.filter("xs", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select("id", F.explode(mine).alias("x")).select("id", F.col("x.id").alias("near"), (-F.col("x.c")).alias("cos"))


def neighbour_pairs(vectors: DataFrame, k: int = 5) -> DataFrame:
    """``ord_a < ord_b``: pairs of which at least one is among the ``k`` nearest of the other."""
    near = neighbours(vectors, k)
    return near.select(F.least("id", "near").alias("ord_a"), F.greatest("id", "near").alias("ord_b")).distinct()
