"""Canonical keys and word sets of questions.

The key of a question is the same for all questions with the same stem and the
same choice texts once blanks, letter case, punctuation, labels, the order of
choices and look-alike characters are disregarded.  A sign or a decimal point
that belongs to a number is content.  The words of a question are the distinct
runs of letters and the numbers (with sign and decimals) of stem and choices.

Defined results: a null question gives no row; a null stem or choice text
counts as empty; null and empty choice lists are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lookalike import unify

CUT = "\x01"  # between the texts of a question
GAP = "\x02"  # where something disregarded lay between two numbers
#: Letters, digits, and what is disregarded besides signs and points (blanks, control characters, punctuation), for any text and for ASCII.
ANY = (r"\p{L}", r"\p{N}", r"[[\s\p{Z}\p{C}\p{P}]&&[^\x01\x02.\-]]", r"\p{L}\p{M}")
ASCII = ("a-z", "0-9", r"[\x00\x03-\x20!\"#%&'()*,/:;?@\[\\\]_{}\x7f]", "a-z")


def noise(letter: str, digit: str, plain: str, _: str) -> str:
    """Runs of what is disregarded; a sign or point is, unless it is part of a number."""
    return rf"{plain}+|-(?!\.?\d)|(?<=[{letter}{digit}])-|\.(?!\d)|(?<=[{letter}])\."


def word(letter: str, digit: str, _: str, run: str) -> str:
    """A number, else a run of letters."""
    return rf"(?:(?<![{letter}{digit}])[-+])?(?:\d+(?:\.\d+)?|(?<![{letter}{digit}.])\.\d+)|[{run}]+"


WORD = word(*ANY)
BEYOND_ASCII = r"[^\x00-\x7F]"


@F.pandas_udf(StringType())
def _unify_parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: CUT.join(map(unify, t.split(CUT))), na_action="ignore")


def plain_texts(questions: DataFrame) -> DataFrame:
    """``ord, plain``: stem and choice texts, joined by ``CUT``, in one form and in lower case."""
    empty = F.array().cast("array<string>")
    texts = F.concat(F.array(F.col("question.stem")), F.coalesce(F.col("question.choices.text"), empty))
    joined = F.array_join(F.transform(texts, lambda t: F.translate(F.coalesce(t, F.lit("")), CUT + GAP, "")), CUT)
    rows = questions.where("question is not null").select("ord", joined.alias("joined"))
    beyond = F.when(F.col("joined").rlike(BEYOND_ASCII), F.col("joined"))
    return rows.select("ord", F.lower(F.coalesce(_unify_parts(beyond), "joined")).alias("plain"))


def canonical_text(plain: Column) -> Column:
    """The canonical form of one or more joined texts in lower case."""

    def by(kind: tuple[str, str, str, str]) -> Column:
        gapped = F.when(plain.rlike(rf"\d[^{kind[0]}\d]+\d"), F.regexp_replace(plain, rf"(?<=\d)(?:{noise(*kind)})+(?=[-+.]?\d)", GAP)).otherwise(plain)
        return F.regexp_replace(gapped, noise(*kind), "")

    return F.when(plain.rlike(BEYOND_ASCII), by(ANY)).otherwise(by(ASCII))


def words_of(plain: Column) -> Column:
    """The distinct words of texts in lower case, sorted."""
    found = lambda kind: F.regexp_extract_all(plain, F.lit(f"({word(*kind)})"), F.lit(1))
    return F.sort_array(F.array_distinct(F.when(plain.rlike(BEYOND_ASCII), found(ANY)).otherwise(found(ASCII))))


def canonical_questions(questions: DataFrame, words: bool = False) -> DataFrame:
    """``ord, key`` and, if asked for, ``words`` (sorted, distinct) of every question."""
    plain = plain_texts(questions)
    more = ["plain"] if words else []
    # Step by step, so that each step's text is made once for all who read it.
    parts = plain.select("ord", *more, F.split(canonical_text(F.col("plain")), CUT, -1).alias("parts"))
    choices = F.sort_array(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))))
    key = F.sha2(F.concat_ws(CUT, F.slice("parts", 1, 1), choices), 256)
    return parts.select("ord", key.alias("key"), *([words_of(F.col("plain")).alias("words")] if words else []))
