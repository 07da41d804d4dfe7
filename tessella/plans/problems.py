"""Queries of the general data problems: nested records and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import references as refs
from ..operators import shred
from ..session import durable, table


def _shredded(spark: SparkSession, sf: str) -> DataFrame:
    return durable(shred.shred(table(spark, sf, "question_raw")), "shredded")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every choice of a readable payload and whether the answer key names it."""
    return shred.keyed_choices(_shredded(spark, sf))


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return shred.records(shred.shred(table(spark, sf, "question_raw")))


def p1_parts(spark: SparkSession, sf: str) -> DataFrame:
    return shred.parts(shred.shred(table(spark, sf, "question_raw")))


def p1_choices(spark: SparkSession, sf: str) -> DataFrame:
    return shred.choices(_shredded(spark, sf))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    questions = table(spark, sf, "questions")
    return (
        refs.log_references(table(spark, sf, "student_step"), questions),
        refs.log_parents(table(spark, sf, "problems"), questions, table(spark, sf, "kc_template")),
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference that fails, and how."""
    return refs.orphans(*_references(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Failing references per table, field, month and kind."""
    given, parents = _references(spark, sf)
    return refs.orphan_report(refs.failing(given, parents), given)


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_parts, p1_choices, p6_found, p6_report)}

_ORPHANS = """
WITH refs AS (
  SELECT 'student_step' AS src_table, row_id AS src_key, 'problem_name' AS ref_field, problem_name AS ref_value, TRY_CAST(first_transaction_time AS TIMESTAMP) AS seen FROM student_step
  UNION ALL SELECT 'student_step', row_id, 'step_name', step_name, TRY_CAST(first_transaction_time AS TIMESTAMP) FROM student_step
  UNION ALL SELECT 'questions', ord, 'ds_step_name', unnest(ds_step_name), NULL FROM questions
), named AS (
  SELECT *, lower(trim(ref_value, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) AS name FROM refs
), parents AS (
  SELECT 'problem_name' AS ref_field, problem_name AS key_value, added_at AS since, retired_at AS until FROM problems
  UNION ALL SELECT 'step_name', unnest(ds_step_name), NULL, NULL FROM questions
  UNION ALL SELECT 'ds_step_name', step_name, NULL, NULL FROM kc_template
), targets AS (
  SELECT DISTINCT ref_field, lower(trim(key_value, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160))) AS name, since, until FROM parents
), judged AS (
  SELECT r.src_table, r.src_key, r.ref_field, r.ref_value, r.seen,
    (SELECT count(*) FROM targets t WHERE t.ref_field = r.ref_field AND t.name = r.name) AS n,
    (SELECT count(*) FROM targets t WHERE t.ref_field = r.ref_field AND t.name = r.name AND (t.since IS NULL OR r.seen >= t.since) AND (t.until IS NULL OR r.seen < t.until)) AS n_there,
    (SELECT count(*) FROM targets t WHERE t.ref_field = r.ref_field AND t.name = r.name AND r.seen >= t.until) AS n_gone
  FROM named r WHERE r.name <> ''
), found AS (
  SELECT src_table, src_key, ref_field, ref_value,
    CASE WHEN n = 0 THEN 'missing' WHEN n_gone > 0 THEN 'deleted' ELSE 'late' END AS kind
  FROM judged WHERE n = 0 OR (seen IS NOT NULL AND n_there = 0)
)
"""

SQL = {
    "p6_found": _ORPHANS + "SELECT * FROM found",
    "p6_report": _ORPHANS
    + """
, months AS (
  SELECT src_table, src_key, coalesce(strftime(any_value(seen), '%Y-%m'), 'none') AS month FROM refs GROUP BY 1, 2
), per AS (
  SELECT n.src_table, n.ref_field, m.month, count(*) AS n_refs FROM named n JOIN months m USING (src_table, src_key) WHERE n.name <> '' GROUP BY 1, 2, 3
)
SELECT f.src_table, f.ref_field, m.month, f.kind, count(*) AS n_failed, any_value(p.n_refs) AS n_refs
FROM found f JOIN months m USING (src_table, src_key) JOIN per p ON p.src_table = f.src_table AND p.ref_field = f.ref_field AND p.month = m.month
GROUP BY 1, 2, 3, 4
""",
}
