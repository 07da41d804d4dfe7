"""Label models: from clusters to label tables, and from these into templates.

A template is wide - keys, then one column ``KC (<model>)`` per model - and has
a ``row_id``.  The unique-step table runs along it and is met on ``row_id``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def label_clusters(questions: DataFrame, clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """Questions with ``KC-raw`` (the exemplar) and ``KC`` (the exemplar's concept).

    ``clusters`` has ``ord, exemplar``; ``concepts`` has ``ord, concept``.  Two
    clusters whose exemplars have the same concept get the same label.
    """
    concept = concepts.select(F.col("ord").alias("exemplar"), F.col("concept").alias("KC"))
    joined = questions.join(clusters, "ord").join(concept, "exemplar", "left")
    return joined.select(*(F.col(f"`{c}`") for c in questions.columns), names.exemplar_label(F.col("exemplar")).alias("KC-raw"), "KC")


def invalid_concepts(table: DataFrame, column: str = "KC") -> DataFrame:
    """Rows whose label is null or blank; a valid table has none."""
    return table.where(F.coalesce(F.btrim(F.regexp_replace(F.col(f"`{column}`"), r"\s+", " ")), F.lit("")) == "")


def step_labels(table: DataFrame, steps: str = "ds_step_name", label: str = "KC", order: str = "ord") -> DataFrame:
    """``step_name, label``: the label of each step; the last row (and last place in it) that names a step counts.

    ``steps`` is a list of names or names joined by ``~``.
    """
    each = F.col(f"`{steps}`") if dict(table.dtypes)[steps].startswith("array") else F.split(F.col(f"`{steps}`"), "~")
    rows = table.select(F.col(order).alias("o"), F.col(f"`{label}`").alias("label"), F.posexplode(each).alias("pos", "step_name"))
    return rows.groupBy("step_name").agg(F.max_by("label", F.struct("o", "pos")).alias("label"))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts, F.lit(False))


def any_label_missing(columns: list[str]) -> Column:
    """True where some label column is null; false where there is none."""
    return _any([F.col(f"`{c}`").isNull() for c in columns])


def all_labels_there(columns: list[str]) -> Column:
    return ~any_label_missing(columns)


def fill_template(template: DataFrame, labels: DataFrame, unique_steps: DataFrame | None, model: str, match_other: bool = True, drop_other: bool = True, mask_columns: list[str] | None = None) -> DataFrame:
    """The template with a new column ``KC (<model>)`` by step name.

    With ``match_other`` a row gets no label where another model (or one of
    ``mask_columns``) has none; with ``drop_other`` the other models go.  Rows
    without a unique step get none.
    """
    others = names.kc_columns(template.columns)
    masked = any_label_missing(mask_columns if mask_columns is not None else others) if match_other else F.lit(False)
    step_column = "step_name" if "step_name" in template.columns else "Step Name"
    df = template.withColumn("_masked", masked)
    if drop_other:
        df = df.drop(*others)
    if unique_steps is not None:
        has = unique_steps.select("row_id", F.col("`KC (Unique-step)`").isNotNull().alias("_has"))
        df = df.join(has, "row_id", "left").withColumn("_masked", F.col("_masked") | ~F.coalesce("_has", F.lit(False))).drop("_has")
    keep = [c for c in df.columns if c != "_masked"]
    known = labels.select(F.col("step_name").alias("_step"), F.col("label").alias("_label"))
    out = df.join(known, F.col(f"`{step_column}`") == F.col("_step"), "left")
    return out.select(*(F.col(f"`{c}`") for c in keep), F.when(~F.col("_masked"), F.col("_label")).alias(f"KC ({model})"))


def fill_models(template: DataFrame, models: list[tuple[str, DataFrame]], unique_steps: DataFrame | None, mask_mode: str = "sequential") -> DataFrame:
    """Add models one after the other, by name.

    ``sequential``: what earlier ones left empty masks later ones too;
    ``original``: only the template's own models mask.
    """
    if mask_mode not in ("sequential", "original"):
        raise ValueError(f"no such mask mode: {mask_mode}")
    own = names.kc_columns(template.columns)
    for name, labels in sorted(models, key=lambda m: m[0]):
        template = fill_template(template, labels, unique_steps, name, drop_other=False, mask_columns=own if mask_mode == "original" else None)
    return template


def adjust_template(template: DataFrame, questions: DataFrame, unique_steps: DataFrame | None, renamed: dict[str, str] | None = None, suffix: str = "new") -> DataFrame:
    """Existing models without the labels of rows that no question stands for, under new names.

    A row loses its labels where some model has none, where no question has its
    step, or where it has no unique step.
    """
    columns = names.kc_columns(template.columns)
    step_column = "step_name" if "step_name" in template.columns else "Step Name"
    known = questions.select(F.explode("ds_step_name").alias("_step")).distinct().withColumn("_there", F.lit(True))
    df = template.join(known, F.col(f"`{step_column}`") == F.col("_step"), "left")
    masked = any_label_missing(columns) | F.col("_there").isNull()
    if unique_steps is not None:
        df = df.join(unique_steps.select("row_id", F.col("`KC (Unique-step)`").isNotNull().alias("_has")), "row_id", "left")
        masked = masked | ~F.coalesce("_has", F.lit(False))
    renamed = renamed or {}
    new = {c: f"KC ({renamed.get(n, n.replace(' ', '-') + '-' + suffix)})" for c in columns for n in [names.true_name(c)]}
    return df.select(*(F.when(~masked, F.col(f"`{c}`")).alias(new[c]) if c in new else F.col(f"`{c}`") for c in template.columns))


def long_labels(template: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kc_model, kc_label``: the wide template as rows."""
    columns = names.kc_columns(template.columns)
    each = F.array(*(F.struct(F.lit(names.true_name(c)).alias("kc_model"), F.col(f"`{c}`").alias("kc_label")) for c in columns))
    return template.select(*keys, F.explode(each).alias("x")).select(*keys, "x.kc_model", "x.kc_label")


def duplicate_keys(template: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has; a template that is joined may have none."""
    return template.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_to_raw(template: DataFrame, part_style: bool = False) -> DataFrame:
    """``clean, raw`` (list, in template order) of the steps whose rows have all labels.

    The clean name is the text before the first blank, or with ``part_style``
    the first word after ``part ``.
    """
    full = template.where(all_labels_there(names.kc_columns(template.columns)))
    step_column = "step_name" if "step_name" in template.columns else "Step Name"
    raw = full.groupBy(F.col(f"`{step_column}`").alias("raw")).agg(F.min("row_id").alias("first")).where("raw is not null")
    clean = F.regexp_extract("raw", r"part (\S+)", 1) if part_style else F.element_at(F.split("raw", " "), 1)
    rows = raw.withColumn("clean", clean)
    return rows.groupBy("clean").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "raw"))), lambda x: x["raw"]).alias("raw"))


def match_steps(questions: DataFrame, steps: DataFrame, part_style: bool = False) -> DataFrame:
    """Questions with at least one step the template has; ``step_name`` and ``skillref`` shrink to those and ``ds_step_name`` lists their raw names."""
    pairs = questions.select("ord", F.posexplode(F.arrays_zip("step_name", F.coalesce("skillref", F.array().cast("array<string>")).alias("skillref"))).alias("pos", "x")).where("x.step_name is not null")
    probe = F.element_at(F.split("x.step_name", "_"), -1) if part_style else F.col("x.step_name")
    hit = pairs.withColumn("clean", probe).join(steps, "clean")
    ordered = hit.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "raw"))).alias("hits"))
    lists = ordered.select("ord", F.transform("hits", lambda h: h["x"]["step_name"]).alias("step_name"), F.transform("hits", lambda h: h["x"]["skillref"]).alias("skillref"), F.flatten(F.transform("hits", lambda h: h["raw"])).alias("ds_step_name"))
    return questions.drop("step_name", "skillref", "ds_step_name").join(lists, "ord")
