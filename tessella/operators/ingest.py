"""Raw question collections to questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import questions as q
from ..joins import lookup
from ..session import durable
from ..sources import html, readers, writers
from . import kcmodel


def skill_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("skill").agg(F.count(F.lit(1)).alias("n"))


def frequent_skills(questions: DataFrame, least: int = 100) -> DataFrame:
    """Questions whose skill at least so many questions have; questions without a skill count as one skill."""
    kept = skill_counts(questions).where(F.col("n") >= least).select(F.col("skill").alias("_skill"))
    return questions.join(kept, F.col("skill").eqNullSafe(F.col("_skill")), "left_semi")


def fold_identical(rows: DataFrame, text: str) -> DataFrame:
    """``ord, n_copies, steps`` per text of ``ord, step_name``: the first, the number and all steps in order.

    Steps are joined by text as rows (``fold_members``) and put in one list
    only at the end, as the folded form has them; a text with more copies than
    a list holds is read from ``fold_members``.
    """
    each = fold_members(rows, text)
    steps = each.where("step is not null").groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy_ord", "pos", "step"))), lambda x: x["step"]).alias("steps"))
    heads = each.where("copy_ord = ord and pos <= 0").select("ord", "n_copies")
    return heads.join(steps, "ord", "left").select("ord", "n_copies", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"))


def fold_members(rows: DataFrame, text: str) -> DataFrame:
    """``ord, n_copies, copy_ord, pos, step``: every step of every question beside the first question with its text.

    A question without steps has one row with null ``step`` and position -1.
    """
    keyed = durable(rows.withColumn("_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).select("_key", F.col("ord").alias("copy_ord"), "step_name"), "keyed")
    first = durable(keyed.groupBy("_key").agg(F.min("copy_ord").alias("ord"), F.count(F.lit(1)).alias("n_copies")), "firsts")
    met = lookup(keyed, first, ["_key"], "copy_ord", rows="n_copies")
    steps = met.select("ord", "n_copies", "copy_ord", F.posexplode_outer("step_name").alias("pos", "step"))
    return steps.withColumn("pos", F.coalesce("pos", F.lit(-1)))


def science_questions(raw: DataFrame, min_choices: int = 2, min_skill: int = 100) -> DataFrame:
    """Text-only questions with enough choices and a frequent skill.

    ``raw`` has ``pos, id, question, choices, answer, image`` and the subject fields.
    """
    kept = raw.where(F.col("image").isNull() & (F.size("choices") >= min_choices))
    choices = F.transform("choices", lambda t, i: F.struct(q.choice_letter(i).alias("label"), t.alias("text")))
    made = kept.select(
        "pos",
        F.concat(F.lit("sciqa-"), "id").alias("id"),
        F.lit(q.MULTIPLE_CHOICE).alias("q_type"),
        F.struct(F.col("question").alias("stem"), choices.alias("choices")).alias("question"),
        q.choice_letter(F.col("answer")).alias("answer_key"),
        "skill",
        "subject",
        "topic",
        "category",
        "grade",
    )
    return readers.with_ord(frequent_skills(made, min_skill), "pos").drop("pos")


def write_science(spark, path: str, out: str, min_choices: int = 2, min_skill: int = 100) -> None:
    writers.question_lines(science_questions(readers.science_raw(spark, path), min_choices, min_skill), f"{out}/sciqa-skill-{min_skill}.jsonl")


def course_questions(spark, root: str) -> DataFrame:
    return html.fold(html.questions(html.raw_blocks(readers.pages(spark, root))))


def write_course(spark, root: str, template: str, out: str, part_style: bool = False) -> None:
    """Course questions that the template has steps of; ``part_style`` is the later naming of steps."""
    steps = kcmodel.clean_to_raw(readers.template(spark, template), part_style)
    found = kcmodel.match_steps(course_questions(spark, root), steps, part_style)
    writers.question_lines(found, f"{out}/elearning{23 if part_style else 22}-mcq.jsonl")
