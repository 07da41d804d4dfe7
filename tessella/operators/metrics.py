"""Agreement of two labelings: eight measures from one contingency table.

All measures of all models come from one aggregation of the label pairs and two
of its margins; only expected mutual information needs more, and that is summed
over distinct pairs of margin sizes, of which there are few.

Defined results: a null true label is a class of its own, rows with a null
predicted label are left out; a single class on both sides counts as perfect
agreement; with fewer than two rows the pair-counting measures are 1.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from ..sources.readers import with_ord

NO_LABEL = "nan"
STEP = 1 << 20  # terms of an expectation summed at once
NOTHING = 1e-12  # a difference of entropies that is none
MEASURES = ("rand", "adjusted_rand", "nmi", "ami", "fowlkes_mallows", "homogeneity", "completeness", "v_measure")


def contingency(pairs: DataFrame) -> DataFrame:
    """``model, true, pred, n`` of ``model, true, pred``."""
    return pairs.where("pred is not null").groupBy("model", F.coalesce("true", F.lit(NO_LABEL)).alias("true"), "pred").agg(F.count(F.lit(1)).alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 1, by Stirling's series above 15."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 15).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - shift


def expected_term(a: int, b: int, n: int) -> float:
    """Expected share of mutual information of one cell with margins ``a`` and ``b`` of ``n`` (hypergeometric)."""
    total = 0.0
    lo, hi = max(1, a + b - n), min(a, b)
    fixed = float(log_gamma(np.array([a + 1.0, b + 1.0, n - a + 1.0, n - b + 1.0])).sum() - log_gamma(np.array([n + 1.0]))[0])
    for at in range(lo, hi + 1, STEP):
        k = np.arange(at, min(at + STEP, hi + 1), dtype=np.float64)
        logp = fixed - log_gamma(k + 1) - log_gamma(a - k + 1) - log_gamma(b - k + 1) - log_gamma(n - a - b + k + 1)
        total += float((k / n * (np.log(n) + np.log(k) - np.log(a) - np.log(b)) * np.exp(logp)).sum())
    return total


def _expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        e = [m * expected_term(int(a), int(b), int(n)) for a, b, n, m in zip(f["a"], f["b"], f["n"], f["times"])]
        yield pd.DataFrame({"model": f["model"], "e": np.array(e, np.float64)})


def expected_information(cells: DataFrame) -> DataFrame:
    """``model, emi``."""
    sizes = lambda by, name: cells.groupBy("model", by).agg(F.sum("n").alias(name)).groupBy("model", name).agg(F.count(F.lit(1)).alias(f"times_{name}"))
    total = cells.groupBy("model").agg(F.sum("n").alias("n"))
    # Distinct sizes of one side: their sum is n at most, so there are fewer than sqrt(2 n) of them a model.
    both = sizes("true", "a").join(F.broadcast(sizes("pred", "b").join(total, "model")), "model").repartition("model", "a", "b")
    terms = both.select("model", "a", "b", "n", (F.col("times_a") * F.col("times_b")).alias("times")).mapInPandas(_expected, "model string, e double")
    return terms.groupBy("model").agg(F.sum("e").alias("emi"))


def measures(pairs: DataFrame) -> DataFrame:
    """``model, n_labels`` and the eight measures, a row per model."""
    cells = contingency(pairs)
    n = F.col("n").cast("double")
    rows = cells.groupBy("model", "true").agg(F.sum(n).alias("a"))
    cols = cells.groupBy("model", "pred").agg(F.sum(n).alias("b"))
    plogp = lambda c: -F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t"))
    total = cells.groupBy("model").agg(F.sum(n).alias("t"), F.sum(n * n).alias("q"))
    a = rows.join(total, "model").groupBy("model").agg(F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(plogp("a")).alias("hc"))
    b = cols.join(total, "model").groupBy("model").agg(F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(plogp("b")).alias("hk"), F.count(F.lit(1)).alias("n_labels"))
    mi = (
        cells.join(rows, ["model", "true"])
        .join(cols, ["model", "pred"])
        .join(total, "model")
        .groupBy("model")
        .agg(F.sum(n / F.col("t") * F.log(n * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    )
    whole = total.join(a, "model").join(b, "model").join(mi, "model").join(expected_information(cells), "model")
    t, q, aa, bb = (F.col(c) for c in ("t", "q", "aa", "bb"))
    c11, c01, c10, c00 = q - t, bb - q, aa - q, t * t - aa - bb + q
    hc, hk, mi, emi = (F.col(c) for c in ("hc", "hk", "mi", "emi"))
    h = F.when(hc == 0, 1.0).otherwise(mi / hc)
    c = F.when(hk == 0, 1.0).otherwise(mi / hk)
    mean = (hc + hk) / 2
    alike = (hc == 0) & (hk == 0)  # one class on either side
    no_room = F.abs(mean - emi) < NOTHING  # chance agrees as much as anything can
    return whole.select(
        "model",
        "n_labels",
        F.when(t < 2, 1.0).otherwise((c00 + c11) / (t * t - t)).alias("rand"),
        F.when((c01 == 0) & (c10 == 0), 1.0).otherwise(2 * (c00 * c11 - c01 * c10) / ((c00 + c01) * (c01 + c11) + (c00 + c10) * (c10 + c11))).alias("adjusted_rand"),
        F.when(alike, 1.0).when(mean == 0, 0.0).otherwise(mi / mean).alias("nmi"),
        F.when(alike | no_room, 1.0).otherwise((mi - emi) / (mean - emi)).alias("ami"),
        F.when(t < 2, 1.0).when(c11 == 0, 0.0).otherwise(c11 / F.sqrt((aa - t) * (bb - t))).alias("fowlkes_mallows"),
        h.alias("homogeneity"),
        c.alias("completeness"),
        F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)).alias("v_measure"),
    )


def wide_pairs(table: DataFrame, true: str, columns: dict[str, str]) -> DataFrame:
    """``model, true, pred`` of a wide table; ``columns`` maps label columns to model names."""
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{c}`").cast("string").alias("pred")) for c, m in columns.items()))
    return table.select(F.col(f"`{true}`").cast("string").alias("true"), F.explode(pairs).alias("x")).select("x.model", "true", "x.pred")


def distinct_labels(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("model").agg(F.count_distinct("pred").alias("n_labels"))


def random_baseline(pairs: DataFrame, runs: int = 30, seed: int = 42) -> DataFrame:
    """Mean measures over shuffles of the predicted labels, per model.

    A shuffle keeps both margins.  Rows of all runs are numbered twice, by
    their place and by a seeded hash, each within run and model, and labels
    meet places by number: a permutation.  The numbering is a sort by range
    over all tasks; no task holds a run.
    """
    rng = random.Random(seed)
    seeds = [rng.getrandbits(31) for _ in range(runs)]
    kept = durable(pairs.where("pred is not null").withColumn("id", F.monotonically_increasing_id()), "pairs")
    each = kept.withColumn("s", F.explode(F.array(*map(F.lit, seeds))))
    placed = with_ord(each.select("model", "s", "true", F.struct("model", "s", "id").alias("by")), "by", "r").drop("by")
    dealt = with_ord(each.select("pred", F.struct("model", "s", F.xxhash64("id", "s"), "id").alias("by")), "by", "r").drop("by")
    shuffled = placed.join(dealt, "r").select(F.concat_ws("\x01", "s", "model").alias("model"), "true", "pred")
    means = measures(shuffled).withColumn("model", F.substring_index("model", "\x01", -1)).groupBy("model")
    return means.agg(*(F.avg(m).alias(m) for m in MEASURES))
