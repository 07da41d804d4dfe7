"""Near-duplicate questions: sets of words that overlap by a share of their union.

Every set is sketched by its bottom-k values under one hash function.  The
function puts frequent words above all others (by the class of their frequency)
and is a plain hash within a class; k is such that two sets of the wanted
similarity share a retained value whatever they are (with ``n`` words and
threshold ``t`` the ``n - ceil(t n) + 1`` smallest), so the inverted lists of
retained values lose no pair.  Values with very long lists are paired up: sets
then share a list per two such values, for which one more value is retained;
sets so small that one common word may be enough are listed under each hot
value as well, so nothing is lost either.  Lists are cut into blocks that meet in cells of
bounded size.

In a cell pairs are filtered by a union sketch: a fixed-size bitmap of the
set's hashes, of which the bits that differ are a lower bound of the words that
differ; a pair that may not reach the threshold is dropped.  What is left, each
pair once, is verified by exact Jaccard over the words themselves.

Rows with the same key and words are one unit until the end, so a group of
copies is compared once.

Defined results: questions without words are similar to nothing; rows of one
key are exact duplicates and give no pair here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..joins import lookup
from ..session import durable, width
from .groups import components
from .ledger import blocked

#: A word is frequent from one in so many sets; their table has at most that many times the mean set size.
FREQUENT = 1000
#: A retained value is hot when more sets than this have the word.
HOT = 16384
#: Members of a cell's side.
BLOCK = 4096
#: Long lists whose table is broadcast, at most.
LONG_LISTS = 100_000
LANES = 4  # 64-bit words of a union sketch


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def units(canonical: DataFrame) -> DataFrame:
    """``unit, key, words, hashes, copies``: rows of one key and one set of words, by their smallest ``ord``."""
    return (
        canonical.withColumn("hashes", F.array_sort(F.transform("words", lambda w: F.xxhash64(w))))
        .groupBy("key", F.xxhash64("words").alias("w"))
        .agg(F.min("ord").alias("unit"), F.first("words").alias("words"), F.first("hashes").alias("hashes"), F.count(F.lit(1)).alias("copies"))
        .drop("w")
    )


def frequent_words(sets: DataFrame, total: int) -> dict[int, int]:
    """Hash and number of sets of every frequent word; at most ``FREQUENT`` times the mean set size of them."""
    least = max(2, total // FREQUENT)
    rows = sets.select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= least)
    return {r.h: r["count"] for r in rows.collect()}


def sketch(sets: DataFrame, threshold: Fraction, frequent: dict[int, int]) -> DataFrame:
    """``key1, key2, id, size, s0..s3``: a row for each retained value, or pair of hot ones, of each unit."""
    words = np.array(sorted(frequent), np.int64)
    counts = np.array([frequent[w] for w in sorted(frequent)], np.int64)
    given = sets.sparkSession.sparkContext.broadcast((words, counts))
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = given.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            h = batch.column(1).flatten().to_numpy()
            row = np.repeat(np.arange(len(ids)), sizes)
            if len(words):
                at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                df = np.where(words[at] == h, counts[at], 0)
            else:
                df = np.zeros(len(h), np.int64)
            grade = np.ceil(2 * np.log2(np.maximum(df, 1))).astype(np.uint64)  # classes of a factor sqrt(2)
            mixed = _mix(h.view(np.uint64), 1)
            rank = (grade << np.uint64(57)) | (mixed >> np.uint64(7))
            order = np.lexsort((rank, row))
            h, df, row = h[order], df[order], row[order]
            start = np.cumsum(sizes) - sizes
            pos = np.arange(len(h)) - np.repeat(start, sizes)
            bits = _mix(h.view(np.uint64), 2)
            lanes = []
            lane, bit = (bits >> np.uint64(6)) % np.uint64(LANES), np.uint64(1) << (bits & np.uint64(63))
            full = sizes > 0
            for k in range(LANES):
                s = np.zeros(len(ids), np.uint64)
                if len(h):
                    s[full] = np.bitwise_or.reduceat(np.where(lane == k, bit, np.uint64(0)), start[full])
                lanes.append(s.view(np.int64))
            least = -(-sizes * num // den)  # words that a similar set has in common
            keep = sizes - least + 2  # one more than needed, for the pairs of hot values
            retained = pos < keep[row]
            hot = df > HOT
            one = np.flatnonzero(retained & (~hot | (least <= 1)[row]))
            key1, key2, owner = [h[one]], [np.zeros(len(one), np.int64)], [row[one]]
            warm = np.flatnonzero(retained & hot)
            if len(warm):
                # Hot values come last in a sketch, so those of a unit lie side by side.
                for step in range(1, int(np.bincount(row[warm]).max())):
                    a, b = warm[:-step], warm[step:]
                    same = row[a] == row[b]
                    x, y = h[a[same]], h[b[same]]
                    key1.append(np.minimum(x, y))
                    key2.append(np.maximum(x, y))
                    owner.append(row[a[same]])
            owner = np.concatenate(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key1)), pa.array(np.concatenate(key2)), pa.array(ids[owner]), pa.array(sizes[owner].astype(np.int32)), *(pa.array(s[owner]) for s in lanes)],
                names=["key1", "key2", "id", "size", *(f"s{k}" for k in range(LANES))],
            )

    lanes = ", ".join(f"s{k} bigint" for k in range(LANES))
    return sets.where(F.size("hashes") > 0).select("unit", "hashes").mapInArrow(run, f"key1 bigint, key2 bigint, id bigint, size int, {lanes}")


def candidates(lists: DataFrame, threshold: Fraction) -> DataFrame:
    """``a < b``: pairs of one inverted list that the union sketch lets through, each once."""
    num, den = threshold.numerator, threshold.denominator
    spark = lists.sparkSession
    long = durable(lists.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK), "long")
    # A BLOCK-th as many as entries at most: broadcast while that is small.
    listed = lists.join(F.broadcast(long), ["key1", "key2"], "left") if long.count() <= LONG_LISTS else lookup(lists, long, ["key1", "key2"], "id", "left", rows="n")
    cells = blocked(listed.withColumn("n", F.coalesce("n", F.lit(1))), BLOCK)
    columns = ["key1", "key2", "lo", "hi"]
    laid = cells.select(*columns, (F.col("own") != F.col("lo")).alias("second"), "id", "size", *(f"s{k}" for k in range(LANES)))
    laid = laid.repartition(max(width(spark), 12) * 4, *columns).sortWithinPartitions(*columns, "second")

    def meet(ids, sizes, lanes, second, crossed) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one cell that pass size and union-sketch filters."""
        split = int(np.searchsorted(second, True))
        if crossed and split in (0, len(ids)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        right = np.arange(split, len(ids)) if split < len(ids) else None
        out_a, out_b = [], []
        cols = range(split) if right is not None else range(len(ids) - 1)
        for i in cols:
            b = slice(split, None) if right is not None else slice(i + 1, None)
            differ = np.bitwise_count(lanes[0][b] ^ lanes[0][i]).astype(np.int32)
            for s in lanes[1:]:
                differ += np.bitwise_count(s[b] ^ s[i])
            # |A xor B| <= (|A| + |B|) (1 - t) / (1 + t)
            ok = np.flatnonzero(differ * (den + num) <= (sizes[b] + sizes[i]) * (den - num))
            if len(ok):
                out_a.append(np.full(len(ok), ids[i]))
                out_b.append(ids[b][ok])
        if not out_a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in _with_end(frames):
            last = frame is None
            if not last:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or not len(rest):
                continue
            k = rest[columns].to_numpy()
            new = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            ends = np.concatenate([new, [len(rest)]]) if last else new
            starts = np.concatenate([[0], new])[: len(ends)]
            ids, sizes = rest["id"].to_numpy(), rest["size"].to_numpy()
            lanes = [rest[f"s{j}"].to_numpy().view(np.uint64) for j in range(LANES)]
            second = rest["second"].to_numpy(dtype=bool)
            crossed = k[:, 2] != k[:, 3]
            out = [meet(ids[s:e], sizes[s:e], [x[s:e] for x in lanes], second[s:e], crossed[s]) for s, e in zip(starts, ends) if e - s > 1]
            if out:
                a, b = np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])
                pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
                yield pairs[pairs.a < pairs.b]
            rest = rest.iloc[ends[-1] :].reset_index(drop=True) if len(ends) else rest

    return laid.mapInPandas(run, "a bigint, b bigint").distinct()


def _with_end(frames):
    yield from frames
    yield None


def similar_units(sets: DataFrame, threshold: Fraction) -> DataFrame:
    """``a < b, same_key, n_a, n_b`` of all pairs of units whose words overlap by ``threshold`` or more."""
    total = sets.count()
    lists = durable(sketch(sets, threshold, frequent_words(sets, total)), "lists")
    pairs = durable(candidates(lists, threshold), "candidates")
    side = lambda s: sets.select(F.col("unit").alias(s), F.col("words").alias(f"words_{s}"), F.col("key").alias(f"key_{s}"), F.col("copies").alias(f"n_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    union = F.size("words_a") + F.size("words_b") - shared
    reached = shared * threshold.denominator >= union * threshold.numerator
    return both.where(reached).select("a", "b", (F.col("key_a") == F.col("key_b")).alias("same_key"), "n_a", "n_b")


def near_pairs(canonical: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``ord_a < ord_b`` of all pairs of questions that are similar but not the same.

    ``canonical`` has ``ord, key, words``.
    """
    exact = Fraction(str(threshold))
    canonical = canonical.withColumn("w", F.xxhash64("words"))
    sets = durable(units(canonical), "units")
    linked = durable(similar_units(sets, exact).where("not same_key"), "linked")
    single = linked.where("n_a = 1 and n_b = 1").select(F.col("a").alias("x"), F.col("b").alias("y"))
    copied = linked.where("n_a > 1 or n_b > 1").select("a", "b")
    # Members of units that have copies and a link.
    touched = copied.select(F.col("a").alias("unit")).union(copied.select(F.col("b"))).distinct()
    named = durable(sets.join(touched, "unit", "left_semi").select("unit", "key", F.xxhash64("words").alias("w"), "copies"), "named")
    members = durable(lookup(canonical.select("ord", "key", "w"), named, ["key", "w"], "ord", rows="copies").select("unit", "ord", "copies"), "members")
    first = durable(lookup(members.withColumnRenamed("unit", "a"), copied, ["a"], "ord").select(F.col("ord").alias("x"), "b"), "first")
    second = lookup(first, members.select(F.col("unit").alias("b"), F.col("ord").alias("y")), ["b"], "x").select("x", "y")
    return single.unionByName(second).select(F.least("x", "y").alias("ord_a"), F.greatest("x", "y").alias("ord_b"))


def near_groups(canonical: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``ord, group_ord, n_links, n_copies``: a row per question that has a copy or a near-duplicate.

    ``group_ord`` is the least ``ord`` of all questions linked directly or
    through others, ``n_links`` the near-duplicates of the question itself and
    ``n_copies`` the questions of its own key.
    """
    canonical = canonical.withColumn("w", F.xxhash64("words"))
    sets = durable(units(canonical), "units")
    linked = durable(similar_units(sets, Fraction(str(threshold))), "linked")
    keys = durable(sets.groupBy("key").agg(F.min("unit").alias("first"), F.sum("copies").alias("n_copies")), "keys")
    # Units of one key (their words differ only in how blanks cut them) belong together too.
    same = sets.join(keys, "key").where("unit <> first").select(F.col("unit").alias("a"), F.col("first").alias("b"))
    group = components(linked.select("a", "b").unionByName(same)).select(F.col("item").alias("unit"), "group_id")
    other = linked.where("not same_key")
    ways = other.select(F.col("a").alias("unit"), F.col("n_b").alias("n")).unionByName(other.select(F.col("b").alias("unit"), F.col("n_a").alias("n")))
    links = ways.groupBy("unit").agg(F.sum("n").alias("n_links"))
    described = sets.join(keys, "key").join(group, "unit", "left").join(links, "unit", "left").where("group_id is not null or n_copies > 1")
    described = described.select("key", F.xxhash64("words").alias("w"), F.coalesce("group_id", "unit").alias("group_ord"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies", "copies")
    return lookup(canonical.select("ord", "key", "w"), durable(described, "described"), ["key", "w"], "ord", rows="copies").select("ord", "group_ord", "n_links", "n_copies")
