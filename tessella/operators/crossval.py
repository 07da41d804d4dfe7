"""Tables of cross-validation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

AVERAGED = ("aic", "bic", "log_likelihood")
MEAN_RUN = "mean"


def folded(results: DataFrame) -> DataFrame:
    """``model, metric, entry, value``: replicas of a model under its name."""
    return results.select(names.model_name(F.col("column")).alias("model"), "column", "metric", "entry", "value")


def bad_runs(results: DataFrame, runs: int = 10) -> DataFrame:
    """Models not recognised, and (model, metric) pairs without exactly ``runs`` values."""
    return folded(results).groupBy("model", "metric").agg(F.count("value").alias("n")).where((F.col("model") == "") | (F.col("n") != runs))


def result_table(results: DataFrame, averaged: tuple[str, ...] = AVERAGED) -> DataFrame:
    """``model, metric, run, value``: the mean of the averaged metrics, every run of the others."""
    f = folded(results)
    means = f.where(F.col("metric").isin(*averaged)).groupBy("model", "metric").agg(F.avg("value").alias("value")).select("model", "metric", F.lit(MEAN_RUN).alias("run"), "value")
    rest = f.where(~F.col("metric").isin(*averaged)).select("model", "metric", F.col("entry").cast("string").alias("run"), "value")
    return means.unionByName(rest)


def publication(results: DataFrame) -> DataFrame:
    """``model, metric, mean, std`` (population) and the cell that shows them with four digits."""
    both = folded(results).groupBy("model", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return both.withColumn("cell", F.format_string("%.4f (%.4f)", "mean", "std"))
