"""Rendering of questions as Column expressions.

A question row has ``q_type``, ``question`` (``stem`` and ``choices`` of
``label`` and ``text``) and ``answer_key``.  A null type, stem, label, text or
answer prints as the empty text; null and empty choices are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MULTIPLE_CHOICE = "Multiple Choice"
TRAILER = "Answer:"
# How the request for a concept ends.
ASKS_NOUN = "whether the student understands the concept of"
ASKS_VERB = "whether the student can"
#: Python's idea of white space at the ends of a text.
OUTER_SPACE = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def q_type() -> Column:
    return _or_empty(F.col("q_type"))


def stem() -> Column:
    return F.col("question.stem")


def answer() -> Column:
    return _or_empty(F.col("answer_key"))


def trailer() -> Column:
    return F.lit(TRAILER)


def choice_lines() -> Column:
    """``label) text`` of every choice that is there."""
    there = F.filter("question.choices", lambda c: c.isNotNull())
    return F.transform(there, lambda c: F.concat(_or_empty(c["label"]), F.lit(") "), _or_empty(c["text"])))


def body() -> Column:
    """The stem and, of a multiple-choice question, a line per choice."""
    plain = _or_empty(stem())
    lines = F.concat_ws("\n", plain, F.coalesce(choice_lines(), F.array().cast("array<string>")))
    return F.when(q_type() == MULTIPLE_CHOICE, lines).otherwise(plain)


def header(number: int = 1) -> Column:
    first = F.lit(f"Exercise {number}:")
    return F.when(q_type() != "", F.concat(first, F.lit("\n"), q_type(), F.lit(":"))).otherwise(first)


def prompt(number: int = 1) -> Column:
    return F.concat_ws("\n", header(number), body(), trailer())


def rendered() -> Column:
    """Body and answer."""
    return F.when(answer() != "", F.concat(body(), F.lit("\nAnswer: "), answer())).otherwise(body())


def flat(questions: DataFrame) -> DataFrame:
    """Every field as a column of a flat table: ``question`` rendered, lists of texts joined by ``~``.

    ``images`` is left out.  A null list stays null, an empty one gives the
    empty text; null elements are skipped.
    """
    out = []
    for field in questions.schema.fields:
        if field.name == "images":
            continue
        if field.name == "question":
            out.append(rendered().alias("question"))
        elif field.dataType == ArrayType(StringType()):
            out.append(F.array_join(F.col(f"`{field.name}`"), "~").alias(field.name))
        else:
            out.append(F.col(f"`{field.name}`"))
    return questions.select(*out)


def concept_prompt(verbal: bool = False) -> Column:
    """The text that asks for the concept a question tests."""
    slug = F.replace(F.lower(q_type()), F.lit(" "), F.lit("-"))
    opening = F.lit("\n\nRemark:\nThe above exercise is a ")
    return F.concat(header(1), F.lit("\n"), rendered(), opening, slug, F.lit(" question that tests "), F.lit(ASKS_VERB if verbal else ASKS_NOUN))


def cleaned_concept(text: Column) -> Column:
    """Without outer white space, then without full stops and commas at the end."""
    return F.rtrim(F.regexp_replace(text, OUTER_SPACE, ""), F.lit(".,"))


def marginal_context() -> Column:
    return F.concat(header(2), F.lit("\n"))


def choice_letter(position: Column) -> Column:
    """``a`` for 0 and so on."""
    return F.char(F.lit(97) + position)
