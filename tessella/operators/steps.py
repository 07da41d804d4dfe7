"""Student steps with label models: the merge, opportunity counts and short codes.

Opportunities follow the order of the file (``row_id``), never the time of a
step.  The template is met on its three keys, nulls included.

A window over (student, label) needs the rows of one student and label in one
task; that is bounded by what one student does.  Codes are ranks among the
distinct values: those of all columns are found in one pass, ranked together
and joined back, by broadcast where their measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..joins import broadcast_if_small, lookup
from ..session import durable
from ..sources.readers import with_ord
from . import kcmodel

KEYS = ["problem_hierarchy", "problem_name", "step_name"]
CODES = {"anon_student_id": "ST", "problem_hierarchy": "PH", "problem_name": "PN", "step_name": "SN"}


def opportunity(label: Column, student: Column, order: Column) -> Column:
    """How many times the student has met the label so far; null without a label."""
    return F.when(label.isNotNull(), F.row_number().over(Window.partitionBy(student, label).orderBy(order)).cast("bigint"))


def codes(df: DataFrame, prefixes: dict[str, str]) -> dict[str, tuple[DataFrame, int, int]]:
    """Of each column the table ``v, c`` (``<prefix>-<rank among its sorted distinct values>``), its rows and its bytes."""
    each = F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"`{x}`").alias("v")) for x in prefixes))
    values = df.select(F.explode(each).alias("e")).select("e.x", "e.v").where("v is not null").distinct()
    ranked = durable(with_ord(values.withColumn("by", F.struct("x", "v")), "by", "place").drop("by"), "codes")
    found = {r.x: r for r in ranked.groupBy("x").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.length("v") + 48).alias("bytes")).collect()}  # a row per column
    out = {}
    for x, prefix in prefixes.items():
        first, n, size = (found[x].first, found[x].n, found[x].bytes) if x in found else (0, 0, 0)
        code = F.concat(F.lit(f"{prefix}-"), (F.col("place") - first).cast("string"))
        out[x] = ranked.where(F.col("x") == x).select("v", code.alias("c")), n, size
    return out


def coded(df: DataFrame, tables: dict[str, tuple[DataFrame, int, int]], prefixes: dict[str, str], keep_null: bool, spread: str | None = None) -> DataFrame:
    """``df`` with short codes for the columns of ``tables``; a null is last, or kept."""
    columns = df.columns
    for x, (known, n, size) in tables.items():
        side = known.select(F.col("v").alias(x), F.col("c").alias("_code"))
        small = broadcast_if_small(side, size)
        df = lookup(df, side, [x], spread, "left") if small is side and spread else df.join(small, x, "left")
        code = F.col("_code") if keep_null else F.coalesce("_code", F.lit(f"{prefixes[x]}-{n}"))
        df = df.withColumn(x, code).drop("_code")
    return df.select(*(F.col(f"`{c}`") for c in columns))


def merge(steps: DataFrame, template: DataFrame, minimal: bool = False, multiplier: int = 1, check: bool = True) -> DataFrame:
    """Steps with every model's label and, right after it, its opportunity.

    ``minimal`` writes short codes for names and labels; with ``multiplier`` m
    every pair of columns comes again as ``(<model>-1)`` to ``(<model>-<m-1>)``.
    Opportunities are integers, null without a label.
    """
    columns = names.kc_columns(template.columns)
    labels = template.select(names.without_parentheses(F.col("problem_hierarchy")).alias("problem_hierarchy"), "problem_name", "step_name", *(F.col(f"`{c}`") for c in columns))
    if check and kcmodel.duplicate_keys(labels, KEYS).limit(1).count():
        raise ValueError("the template has two rows for one step")
    if minimal and columns:
        plain = labels.toDF(*KEYS, *(f"l{i}" for i in range(len(columns))))  # names of labels may hold anything
        short = {f"l{i}": "KC" for i in range(len(columns))}
        labels = durable(coded(plain, codes(plain, short), short, keep_null=True), "labels").toDF(*KEYS, *columns)
    log = steps.select("row_id", "anon_student_id", names.without_parentheses(F.col("problem_hierarchy")).alias("problem_hierarchy"), "problem_name", "step_name", "first_transaction_time", "first_attempt")
    if minimal:
        tables = codes(log, CODES)
    keys = [(k, f"_{k}") for k in KEYS]
    side = labels.withColumnsRenamed(dict(keys))
    on = [F.col(k).eqNullSafe(F.col(x)) for k, x in keys]
    merged = log.join(side, on, "left").drop(*(x for _, x in keys))
    if minimal:
        merged = coded(merged, tables, CODES, keep_null=False, spread="row_id")
    out, shown = [F.col(c) for c in log.columns], {}
    for c in columns:
        name = names.true_name(c)
        count = opportunity(F.col(f"`{c}`"), F.col("anon_student_id"), F.col("row_id"))
        merged = merged.withColumn(f"Opportunity ({name})", count)
        shown[name] = (c, f"Opportunity ({name})")
    for c, o in shown.values():
        out += [F.col(f"`{c}`"), F.col(f"`{o}`")]
    for i in range(1, multiplier):
        for name, (c, o) in shown.items():
            out += [F.col(f"`{c}`").alias(f"KC ({name}-{i})"), F.col(f"`{o}`").alias(f"Opportunity ({name}-{i})")]
    return merged.select(*out)
