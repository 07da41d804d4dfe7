"""Readers: files of questions, scores, embeddings, label tables, templates and logs as DataFrames.

All but the side files (metadata of a run) are read by Spark.  Positions that
carry meaning - a question's ``ord``, a log's ``row_id`` - are made here, once,
in the order of the files by name and of the lines in them: ``row_id`` of a log
only orders rows, ``ord`` and the ``row_id`` of templates are dense from 0.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .. import schemas
from ..functions import names
from ..session import durable
from . import files

#: Bits of a row id: places in a task, tasks of a read; the rest numbers files.
ROW_BITS, TASK_BITS = 26, 20


# ----------------------------------------------------------------- positions
def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """File order as a column that grows with it but has gaps; ``df`` is a plain read of files.

    Spark packs the splits of one file into tasks in their order, but not those
    of several files; so the file's place by name comes first.  Nothing is
    shuffled or read twice.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()  # task, then place in it by 33 bits
    place = F.shiftleft(F.shiftright(at, 33), ROW_BITS) + at.bitwiseAND((1 << 33) - 1)
    paths = sorted(df.inputFiles())
    if len(paths) < 2:
        return df.withColumn(name, place)
    if len(paths) >= 1 << (63 - ROW_BITS - TASK_BITS):
        raise ValueError(f"{len(paths)} files are too many to be put in order")
    ranks = F.broadcast(spark.createDataFrame(list(zip(paths, range(len(paths)))), "_file string, _rank bigint"))  # a row per file
    placed = df.withColumn("_file", F.input_file_name()).withColumn("_place", place)
    ranked = placed.join(ranks, "_file")
    return ranked.withColumn(name, F.shiftleft("_rank", ROW_BITS + TASK_BITS) + F.col("_place")).drop("_file", "_rank", "_place")


def with_ord(df: DataFrame, by: str, name: str = "ord") -> DataFrame:
    """``name`` dense from 0 in the order of the unique column ``by``.

    Rows are sorted by range over all tasks and written with their place in
    their task; to that are added the rows of the tasks before it, so there is
    no window and no second shuffle.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id())
    ranged = durable(ranged.withColumn("_task", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "ranged")
    sizes = {r["_task"]: r["count"] for r in ranged.groupBy("_task").count().collect()}  # a row per task
    before, total = [], 0
    for task in sorted(sizes):
        before.append((task, total))
        total += sizes[task]
    start = spark.createDataFrame(before, "_task int, _before bigint")
    return ranged.join(F.broadcast(start), "_task").withColumn(name, F.col("_before") + F.col("_at")).drop("_task", "_at", "_before")


# ----------------------------------------------------------------- questions
def _literal_to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(line):
        try:
            return json.dumps(ast.literal_eval(line.strip()))
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None

    for lines in batches:
        yield lines.map(one, na_action="ignore")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Question lines, in JSON or as Python literals; ``ord`` is the line's place.

    Lines that are neither come with a null ``question``; blank lines are none.
    """
    lines = with_row_id(spark.read.text(path), "_at").where(F.trim("value") != "")
    placed = with_ord(lines.select("value", "_at"), "_at")
    parse = F.pandas_udf(_literal_to_json, StringType())
    # Strict JSON stays in the JVM; only what it rejects goes to Python.
    strict = F.expr("try_parse_json(value)")
    text = F.when(strict.isNotNull(), F.col("value")).otherwise(parse(F.when(strict.isNull(), F.col("value"))))
    return from_json_text(placed.select("ord", text.alias("value")))


def from_json_text(lines: DataFrame) -> DataFrame:
    """``ord, value`` (one JSON question each) in the declared form; unknown keys go to ``extras``."""
    lists = [k for k in ("images", "skillref", "step-name", "ds-step-name")]
    fields = ["id string", "type string", f"question struct<stem: string, choices: array<{schemas.CHOICE}>>", "answerKey string", *(f"`{k}` array<string>" for k in lists), *(f"{k} string" for k in ("skill", "subject", "topic", "category", "grade"))]
    parsed = lines.select("ord", F.from_json("value", ", ".join(fields)).alias("q"), F.from_json("value", "map<string,string>").alias("m"))
    known = F.array(*(F.lit(k) for k in schemas.QUESTION_KEYS))
    rest = F.map_filter("m", lambda k, _: ~F.array_contains(known, k))
    extras = F.when(F.size(rest) > 0, rest)
    return parsed.select("ord", *(F.col(f"q.`{k}`").alias(c) for k, c in schemas.QUESTION_KEYS.items()), extras.alias("extras"))


def science_raw(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of questions by id, as rows in key order of the file."""
    value = "map<string, struct<question: string, choices: array<string>, answer: int, image: string, skill: string, subject: string, topic: string, category: string, grade: string>>"
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", value)).alias("pos", "id", "q")).select(F.col("pos").cast("bigint").alias("pos"), "id", "q.*")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """``path, html`` of all HTML files below ``root``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


# ---------------------------------------------------------- scores, vectors
def embeddings(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """``ord, embedding`` from Parquet, or from ``.npy`` where the row is the position; ``n`` rows are expected."""
    if path.endswith(".npy"):

        def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import io

            for frame in frames:
                for content in frame["content"]:
                    x = np.load(io.BytesIO(content), allow_pickle=False)
                    yield pd.DataFrame({"ord": np.arange(len(x)), "embedding": list(x.astype(np.float32))})

        out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "ord bigint, embedding array<float>")
    else:
        out = spark.read.parquet(path)
    if n is not None and (found := out.count()) != n:
        raise ValueError(f"{found} embeddings for {n} questions")
    return out


def log_probs(spark: SparkSession, path: str, n: int, cond_on_dim: int = 0) -> DataFrame:
    """``cond_ord`` (null: marginal) ``, ord, logp``; ``cond_on_dim=1`` is stored the other way round."""
    out = spark.read.parquet(path).select("cond_ord", "ord", F.col("logp").cast("double").alias("logp"))
    if cond_on_dim == 1:
        swap = F.col("cond_ord").isNotNull()
        out = out.select(F.when(swap, F.col("ord")).alias("cond_ord"), F.coalesce("cond_ord", "ord").alias("ord"), "logp")
    return out


RUNS = "c bigint, lo bigint, hi bigint, rows bigint, bad bigint"


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``RUNS`` of ``cond_ord, ord, logp``: rows of one condition (-1: marginal) whose ``ord`` follow each other, as one row."""
    for batch in batches:
        c = batch.column("cond_ord").fill_null(-1).to_numpy(zero_copy_only=False)
        finite = np.isfinite(batch.column("logp").fill_null(float("nan")).to_numpy(zero_copy_only=False))
        known = ~batch.column("ord").is_null().to_numpy(zero_copy_only=False)
        o = batch.column("ord").fill_null(-1).to_numpy(zero_copy_only=False)
        if not len(c):
            continue
        new = np.ones(len(c), bool)
        new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1] + 1) | ~known[1:] | ~known[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(c)))
        lo = pa.array(o[start], mask=~known[start])
        hi = pa.array(o[start] + size - 1, mask=~known[start])
        yield pa.RecordBatch.from_arrays([pa.array(c[start]), lo, hi, pa.array(size.astype(np.int64)), pa.array(np.add.reduceat((~finite).astype(np.int64), start))], names=["c", "lo", "hi", "rows", "bad"])


def holes(scores: DataFrame, n: int) -> DataFrame:
    """One row: pairs expected, distinct pairs there, rows, and scores that are not finite.

    Pairs are shuffled as runs of ``ord`` that follow each other under one
    condition, as a scorer's cells and its files have them; in another order
    runs are short, and the count is the same.
    """
    rows = scores.select(F.col("cond_ord").cast("bigint").alias("cond_ord"), F.col("ord").cast("bigint").alias("ord"), F.col("logp").cast("double").alias("logp"))
    return holes_of(rows.mapInArrow(runs, RUNS), n)


def holes_of(found: DataFrame, n: int) -> DataFrame:
    """The same of runs."""
    order = Window.partitionBy("c").orderBy(F.asc_nulls_first("lo"), "hi")
    met, first = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.row_number().over(order) == 1
    fresh = F.when(F.col("lo").isNull(), F.when(F.col("first"), 1).otherwise(0)).otherwise(F.greatest(F.lit(0), F.col("hi") - F.greatest(F.col("lo") - 1, F.coalesce("met", F.col("lo") - 1))))
    return found.withColumn("met", met).withColumn("first", first).agg(
        F.lit(n * n + n).cast("bigint").alias("expected"),
        F.coalesce(F.sum(fresh), F.lit(0)).cast("bigint").alias("present"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("not_finite"),
    )


# ------------------------------------------------------ label tables, steps
def kc_csv(spark: SparkSession, path: str) -> DataFrame:
    """A label or concept table; texts may hold line ends and quotes; empty cells are null."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def template(spark: SparkSession, path: str, drop_empty: bool = True, only: str | None = None) -> DataFrame:
    """A template with a dense ``row_id``: blank cells are null, columns without a value are dropped.

    ``only`` keeps this label column and all that are no label columns.  As
    ``row_id`` is the row's number in the file, however the file is split,
    tables that run along each other meet on it.
    """
    raw = spark.read.csv(path, sep="\t", header=True, escape='"')
    chosen = [c for c in raw.columns if only is None or c == only or c not in names.kc_columns(raw.columns)]
    placed = with_row_id(raw, "_row").select("_row", *(names.or_null(F.col(f"`{c}`")).alias(c) for c in chosen))
    df = with_ord(placed, "_row", "row_id").drop("_row")
    if not drop_empty:
        return df
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in chosen)).first()
    return df.select(*(F.col(f"`{c}`") for c in chosen if counts[c]), "row_id")


def student_steps(spark: SparkSession, path: str) -> DataFrame:
    """The six columns of a log that count, as texts, with ``row_id`` for file order."""
    raw = with_row_id(spark.read.csv(path, sep="\t", header=True, escape='"'))
    return raw.select("row_id", *(names.or_null(F.col(f"`{c}`")).alias(n) if n != "anon_student_id" else F.col(f"`{c}`").alias(n) for c, n in schemas.STEP_COLUMNS.items()))


def kc_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schemas.KC_VALUES, escape='"', enforceSchema=True).drop("_c0")


def cv_results(spark: SparkSession, path: str) -> DataFrame:
    """``column, metric, value``, a row per ``<model>`` element and metric."""
    raw = spark.read.format("xml").option("rowTag", "model").option("inferSchema", False).load(path)
    metrics = [c for c in raw.columns if c != "name"]
    numbered = with_row_id(raw, "entry")
    long = numbered.unpivot(["entry", "name"], metrics, "metric", "text")
    return long.select("entry", F.btrim("name").alias("column"), "metric", F.expr("try_cast(trim(text) as double)").alias("value")).where("value is not null")


def kc_directory(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """``(model, path)`` of every ``*-kc.csv``, sorted; none is an error."""
    found = files.matching(spark, f"{directory}/*-kc.csv")
    if not found:
        raise FileNotFoundError(f"no *-kc.csv in {directory}")
    return [(files.base_name(p)[: -len("-kc.csv")], p) for p in found]


# ------------------------------------------------------------------- side files
def sidecar(spark: SparkSession, directory: str) -> dict:
    """The one ``args*.json`` of a run."""
    found = files.matching(spark, f"{directory}/args*.json")
    if len(found) != 1:
        raise ValueError(f"{len(found)} side files in {directory}, one expected")
    return {"cond_on_dim": 0} | json.loads(files.read_text(spark, found[0]))


def artifacts(spark: SparkSession, directory: str, kinds: tuple[str, ...] = ("concept", "question")) -> list[str]:
    """Which kinds of embeddings a run left."""
    return [k for k in kinds if files.matching(spark, f"{directory}/*{k}-embed*")]
