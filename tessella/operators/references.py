"""References to keys that are missing, already gone or not yet there.

Names are encoded as integers by a dictionary; for each referring field and
period the integers in use form bitmaps, one per key range, and so do the
integers of the keys that were there during the whole period.  Reference
AND-NOT parent leaves the suspects of a period; their bits are decoded and only
the rows that carry a suspect are looked at by their own time.

What is shuffled: names once per period and field (aggregated before the
shuffle, so a name that a third of all rows carry is a handful of rows), then
bitmaps of 4 KB per key range.  The bitmaps lie in as many tasks as there are
key ranges and periods.  Of the rows, those that carry a suspect are found by a
join; a suspect that very many rows carry is dealt out by its count
(``joins.lookup``).

Defined results: null and blank names are no references; names are compared
without case and outer blanks; a row without a readable time belongs to no
period and can only refer to something missing; an empty parent makes every
reference missing; several parents of one name are valid when any is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..joins import lookup
from ..session import durable

BLANKS = " \t\n\r\f\v\u00a0"
RANGE = 32768  # keys in a bitmap, as Spark's bitmap functions have it
NO_PERIOD = -1


def folded(name: Column) -> Column:
    """Without case and outer blanks."""
    return F.lower(F.btrim(name, F.lit(BLANKS)))


def month(time: Column) -> Column:
    """Months since the start of the calendar; null without a time."""
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def month_start(number: Column) -> Column:
    """The first instant of a month number, as a timestamp without zone."""
    return F.make_timestamp_ntz((number / 12).cast("int"), number % 12 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def dictionary(names: DataFrame) -> DataFrame:
    """``name, code``: an integer for every distinct name, written once.

    Codes are dense within each task of the shuffle; what follows needs no more
    than that they fill key ranges well.
    """
    return durable(names.select("name").distinct().withColumn("code", F.monotonically_increasing_id()), "dictionary")


def bitmaps(coded: DataFrame, by: list[str], name: str) -> DataFrame:
    """One bitmap per key range and ``by`` of the column ``code``."""
    position = F.bitmap_bit_position(F.col("code") + 1)
    return coded.groupBy(*by, F.bitmap_bucket_number(F.col("code") + 1).alias("bucket")).agg(F.bitmap_construct_agg(position).alias(name))


def decode(frame: DataFrame, by: list[str], kinds: str) -> DataFrame:
    """``by, code`` of the bits of ``refs`` that neither ``held`` nor ``always`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 4
            rows, codes = [], []
            for i, (bucket, refs, *parents) in enumerate(zip(*(batch.column(n + k).to_pylist() for k in range(4)))):
                bits = np.frombuffer(refs, np.uint8)
                for held in parents:
                    if held is not None:
                        bits = bits & ~np.frombuffer(held, np.uint8)
                at = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                rows.append(np.full(len(at), i))
                codes.append(at + (bucket - 1) * RANGE)
            rows = pa.array(np.concatenate(rows) if rows else [], pa.int64())
            codes = pa.array(np.concatenate(codes) if codes else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(n)), codes], names=[*by, "code"])

    return frame.select(*by, "bucket", "refs", "held", "always").mapInArrow(run, f"{kinds}, code bigint")


def failing(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references that fail, as rows ``src_table, src_key, ref_field, ref_value, at, kind``.

    ``references``: ``src_table, src_key, ref_field, ref_value, at`` (null time: only missing counts).
    ``parents``: ``ref_field, key_value, since, until``, a row per target; both times may be null (no bound).
    """
    period = F.coalesce(month(F.col("at")), F.lit(NO_PERIOD))
    refs = references.withColumn("name", folded(F.col("ref_value"))).where("name <> ''").withColumn("period", period)
    used = durable(refs.groupBy("ref_field", "name", "period").agg(F.count(F.lit(1)).alias("n")), "used")
    targets = durable(
        parents.withColumn("name", folded(F.col("key_value")))
        .where("name <> ''")
        .groupBy("ref_field", "name")
        .agg(F.collect_set(F.struct("since", "until")).alias("spans")),
        "targets",
    )
    codes = dictionary(used.select("name").unionByName(targets.select("name")))
    by = ["ref_field", "period"]
    coded = durable(used.join(codes, "name"), "coded")
    wanted = bitmaps(coded.select(*by, "code"), by, "refs")
    # A row without a time can only miss its target, so period -1 asks for the name alone.
    start, end = month_start(F.col("period")), month_start(F.col("period") + 1)
    whole = F.exists(
        "spans",
        lambda s: (F.col("period") < 0) | ((s["since"].isNull() | (s["since"] <= start)) & (s["until"].isNull() | (s["until"] >= end))),
    )
    free = F.exists("spans", lambda s: s["since"].isNull() & s["until"].isNull())
    known = targets.withColumn("free", free).join(codes, "name")
    # Targets without bounds need one bitmap for all periods; only the others depend on the month.
    always = bitmaps(known.where("free").select("ref_field", "code"), ["ref_field"], "always")
    periods = used.select(*by).distinct()  # a row per field and month
    held = bitmaps(known.where("not free").join(F.broadcast(periods), "ref_field").where(whole).select(*by, "code"), by, "held")
    wanted = wanted.join(held, [*by, "bucket"], "left").join(always, ["ref_field", "bucket"], "left")
    left = decode(wanted, by, "ref_field string, period int")
    suspects = left.join(coded, [*by, "code"]).join(targets, ["ref_field", "name"], "left").select("ref_field", "name", "period", "spans", "n")
    found = lookup(refs, durable(suspects, "suspects"), ["ref_field", "name", "period"], "src_key", rows="n")
    there = F.exists("spans", lambda s: (s["since"].isNull() | (F.col("at") >= s["since"])) & (s["until"].isNull() | (F.col("at") < s["until"])))
    gone = F.exists("spans", lambda s: s["until"].isNotNull() & (F.col("at") >= s["until"]))
    kind = F.when(F.col("spans").isNull(), "missing").when(F.col("at").isNull() | there, None).when(gone, "deleted").otherwise("late")
    return found.withColumn("kind", kind).where("kind is not null").select("src_table", "src_key", "ref_field", "ref_value", "at", "kind")


def orphans(references: DataFrame, parents: DataFrame) -> DataFrame:
    """``failing`` without times."""
    return failing(references, parents).drop("at")


def log_references(student_step: DataFrame, questions: DataFrame) -> DataFrame:
    """The references of the log and of the bank, one row each."""
    at = F.expr("try_cast(first_transaction_time as timestamp_ntz)")
    fields = F.array(
        F.struct(F.lit("problem_name").alias("ref_field"), F.col("problem_name").alias("ref_value")),
        F.struct(F.lit("step_name").alias("ref_field"), F.col("step_name").alias("ref_value")),
    )
    log = student_step.select(F.lit("student_step").alias("src_table"), F.col("row_id").alias("src_key"), F.explode(fields).alias("x"), at.alias("at"))
    bank = questions.select(
        F.lit("questions").alias("src_table"),
        F.col("ord").alias("src_key"),
        F.explode(F.transform("ds_step_name", lambda v: F.struct(F.lit("ds_step_name").alias("ref_field"), v.alias("ref_value")))).alias("x"),
        F.lit(None).cast("timestamp_ntz").alias("at"),
    )
    both = log.unionByName(bank)
    return both.select("src_table", "src_key", "x.ref_field", "x.ref_value", "at")


def log_parents(problems: DataFrame, questions: DataFrame, kc_template: DataFrame) -> DataFrame:
    """The targets those references name."""
    free = F.lit(None).cast("timestamp_ntz")
    return (
        problems.select(F.lit("problem_name").alias("ref_field"), F.col("problem_name").alias("key_value"), F.col("added_at").cast("timestamp_ntz").alias("since"), F.col("retired_at").cast("timestamp_ntz").alias("until"))
        .unionByName(questions.select(F.lit("step_name").alias("ref_field"), F.explode("ds_step_name").alias("key_value"), free.alias("since"), free.alias("until")))
        .unionByName(kc_template.select(F.lit("ds_step_name").alias("ref_field"), F.col("step_name").alias("key_value"), free.alias("since"), free.alias("until")))
    )


def orphan_report(failed: DataFrame, references: DataFrame) -> DataFrame:
    """Failing references (of ``failing``) per table, field, kind and month, beside all references of that month."""
    month_name = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("none")).alias("month")
    by = ["src_table", "ref_field", "month"]
    per = references.where(folded(F.col("ref_value")) != "").select("src_table", "ref_field", month_name).groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = failed.select("src_table", "ref_field", month_name, "kind").groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n_failed"))
    return bad.join(per, by)
