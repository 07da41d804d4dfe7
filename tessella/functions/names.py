"""Names of label models, files, steps and hierarchies."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a label column; the name loses a trailing replica number.
KC_COLUMN = r"KC \((.+?)(-\d+)?\)"
BLANK_VALUES = ("", " ", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def model_name(column: Column) -> Column:
    """The model in a column name, empty if it is none."""
    return F.regexp_extract(column, KC_COLUMN, 1)


def kc_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if re.search(KC_COLUMN, c)]


def display_name(column: str) -> str:
    m = re.search(KC_COLUMN, column)
    if not m:
        raise ValueError(f"not a label column: {column}")
    return m[1]


def true_name(column: str) -> str:
    """What stands between ``KC (`` and the last parenthesis; keeps replica numbers and parentheses."""
    return column[len("KC (") : -1] if column.startswith("KC (") and column.endswith(")") else display_name(column)


def without_parentheses(text: Column) -> Column:
    return F.translate(text, "()", "")


def or_null(text: Column) -> Column:
    """Null for what a template writes where there is no value."""
    return F.when(~text.isin(*BLANK_VALUES), text)


def exemplar_label(ord_: Column) -> Column:
    return F.concat(F.lit("KC-"), ord_.cast("string"))


def exemplar_ord(label: Column) -> Column:
    """The exemplar's position in ``KC-<position>``; null for any other text."""
    return F.try_element_at(F.split(label, "-"), F.lit(2)).try_cast("bigint")


def clean_choice(text: Column) -> Column:
    """A choice without ``(value:...)`` and ``[...]`` behind it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"\(value:.*\)", ""), r"\[.*\]", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def values_model(path: str) -> str:
    """The model a file of label values belongs to: its base name up to the first underscore."""
    return path.replace("\\", "/").rsplit("/", 1)[-1].split("_")[0]
