"""Evaluation and adjustment of label models that lie in files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..sources import readers, writers
from . import kcmodel, metrics

FILE_KEYS = {"Problem Hierarchy": "problem_hierarchy", "Problem Name": "problem_name", "Step Name": "step_name"}


def plain(template: DataFrame) -> DataFrame:
    """A template with the keys' short names."""
    return template.withColumnsRenamed({k: v for k, v in FILE_KEYS.items() if k in template.columns})


def filed(template: DataFrame) -> DataFrame:
    """A template with the keys named as in files."""
    return template.withColumnsRenamed({v: k for k, v in FILE_KEYS.items()})


def compared(pairs: DataFrame, random: bool = False, **options) -> DataFrame:
    """Eight measures per model and, with ``random``, rows ``<model> random`` of shuffled labels."""
    found = metrics.measures(pairs)
    if not random:
        return found
    chance = metrics.random_baseline(pairs, **options)
    return found.unionByName(chance.withColumn("model", F.concat("model", F.lit(" random"))), allowMissingColumns=True)


def folder(spark: SparkSession, directory: str, true: str = "skill", random: bool = False, **options) -> DataFrame:
    """All label tables ``*-kc.csv`` of a folder against their column ``true``."""
    each = [
        readers.kc_csv(spark, path).select(F.lit(model).alias("model"), F.col(f"`{true}`").alias("true"), F.col("KC").alias("pred"))
        for model, path in readers.kc_directory(spark, directory)
    ]
    return compared(reduce(DataFrame.unionByName, each), random, **options)


def template(spark: SparkSession, path: str, true: str, random: bool = False, **options) -> DataFrame:
    """All models of a template file against the model ``true``."""
    given = readers.template(spark, path)
    columns = {c: names.true_name(c) for c in names.kc_columns(given.columns)}
    target = f"KC ({true})"
    if target not in columns:
        raise ValueError(f"{target} is not in {path}")
    others = {c: m for c, m in columns.items() if c != target}
    return compared(metrics.wide_pairs(given, target, others), random, **options)


def adjusted(spark: SparkSession, data_path: str, kc_path: str, step_kc_path: str, save_to: str | None = None, renamed: dict[str, str] | None = None, suffix: str = "new") -> DataFrame:
    """The template of ``kc_path`` without the labels no question of ``data_path`` stands for; written to ``save_to`` if given."""
    given = plain(readers.template(spark, kc_path))
    unique = unique_steps(spark, step_kc_path, given)
    out = filed(kcmodel.adjust_template(given, readers.questions(spark, data_path), unique, renamed, suffix))
    if save_to:
        writers.tsv(out, save_to)
    return out


def unique_steps(spark: SparkSession, path: str, template: DataFrame) -> DataFrame:
    """``row_id, KC (Unique-step)`` of the table that runs along a template; they must have as many rows."""
    found = readers.template(spark, path, drop_empty=False).select("row_id", "`KC (Unique-step)`")
    here, there = found.count(), template.count()
    if here != there:
        raise ValueError(f"{here} rows in {path} for {there} rows of the template")
    return found
