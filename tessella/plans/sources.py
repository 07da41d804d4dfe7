"""Queries over files: tables are written in the forms the programs take and give, and read back.

Each query writes its files to a fresh folder of the shared folder, whole
tables, several part files where Spark splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import questions as q
from ..operators import congruity, crossval, evaluate, ingest, kcmodel, metrics, steps
from ..session import durable, fresh_path, table
from ..sources import files, html, readers, writers
from . import reference
from .reference_sql import CV, RENDER, SQL as PIPELINE_SQL, TEMPLATE

KEYS = reference.KEYS


def _folder(spark: SparkSession, label: str) -> str:
    return files.make_folder(spark, fresh_path(spark, label))


# ------------------------------------------------------------------ questions
def _lines(spark, sf) -> str:
    path = f"{_folder(spark, 'lines')}/bank.jsonl"
    writers.question_lines(table(spark, sf, "questions"), path)
    return path


def _shown(questions: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, "~")
    return questions.select("ord", "id", q.q_type().alias("q_type"), q.rendered().alias("text"), joined("skillref").alias("skillref"), joined("step_name").alias("steps"), joined("ds_step_name").alias("raw_steps"), "skill", "grade")


def file_question_lines(spark, sf):
    """Questions written as JSON lines and read back."""
    return _shown(readers.questions(spark, _lines(spark, sf)))


def file_question_literals(spark, sf):
    """Questions written as Python literals, one per line, and read back without evaluating them."""
    import json

    def literal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"ord": f["ord"], "value": [repr(json.loads(v)) for v in f["value"]]})

    path = f"{_folder(spark, 'literals')}/bank.txt"
    as_json = readers.with_ord(readers.with_row_id(spark.read.text(_lines(spark, sf)), "at"), "at").select("ord", "value")
    as_json.mapInPandas(literal, "ord bigint, value string").orderBy("ord").select("value").write.text(path)
    return _shown(readers.questions(spark, path))


_SHOWN = f"""WITH {RENDER} SELECT q.ord, q.id, coalesce(q.q_type, '') AS q_type, r.txt AS text, array_to_string(q.skillref, '~') AS skillref, array_to_string(q.step_name, '~') AS steps,
  array_to_string(q.ds_step_name, '~') AS raw_steps, q.skill, q.grade FROM questions q JOIN rendered r ON r.ord = q.ord"""


# ---------------------------------------------------------------- raw science
def _science(spark, sf) -> DataFrame:
    """Questions in the raw form: plain choices, a number for the answer, some with an image."""
    qs = table(spark, sf, "questions").where("question.choices is not null")
    return qs.select(
        "ord",
        F.coalesce("question.stem", F.lit("")).alias("question"),
        F.transform("question.choices", lambda c: F.coalesce(c["text"], F.lit(""))).alias("choices"),
        (F.col("ord") % 3).cast("int").alias("answer"),
        F.when(F.col("ord") % 7 == 0, F.lit("image.png")).alias("image"),
        F.coalesce("skill", F.lit("none")).alias("skill"),
        "subject",
        "topic",
        "category",
        "grade",
    )


def _science_path(spark, sf) -> str:
    """One JSON object with all questions; it is one file by its nature."""
    path = f"{_folder(spark, 'science')}/problems.json"
    rows = _science(spark, sf)
    body = rows.select(F.lit(0).alias("one"), "ord", F.concat(F.lit('"'), F.col("ord").cast("string"), F.lit('": '), F.to_json(F.struct(*[c for c in rows.columns if c != "ord"]))).alias("entry"))
    body.groupBy("one").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "entry"))), lambda x: x["entry"]), ", "), F.lit("}")).alias("value")).select("value").write.text(path)
    return path


def file_science(spark, sf):
    """Raw questions of one JSON object: those without image, with two choices or more and a skill of ten or more."""
    out = f"{_folder(spark, 'sciqa')}"
    ingest.write_science(spark, _science_path(spark, sf), out, 2, 10)
    found = readers.questions(spark, f"{out}/sciqa-skill-10.jsonl")
    return found.select("ord", "id", q.q_type().alias("q_type"), q.rendered().alias("text"), "skill", "answer_key")


_SCIENCE = """
WITH raw AS (
  SELECT ord, coalesce(question.stem, '') AS stem, [coalesce(c.text, '') FOR c IN question.choices] AS ch, ord % 3 AS answer, coalesce(skill, 'none') AS skill FROM questions WHERE question.choices IS NOT NULL AND ord % 7 <> 0
), kept AS (SELECT * FROM raw WHERE len(ch) >= 2), often AS (SELECT skill FROM kept GROUP BY 1 HAVING count(*) >= 10)
SELECT row_number() OVER (ORDER BY k.ord) - 1 AS ord, 'sciqa-' || k.ord AS id, 'Multiple Choice' AS q_type,
  stem || chr(10) || array_to_string([chr((97 + i - 1)::INTEGER) || ') ' || ch[i] FOR i IN generate_series(1, len(ch))], chr(10)) || chr(10) || 'Answer: ' || chr((97 + answer)::INTEGER) AS text,
  k.skill, chr((97 + answer)::INTEGER) AS answer_key
FROM kept k JOIN often USING (skill)
"""


# --------------------------------------------------------------- course pages
def _page_parts(spark, sf) -> DataFrame:
    """Question blocks as markup: plain words of the stems, three choices, some broken, some twice."""
    word = F.regexp_replace(F.coalesce(F.col("question.stem"), F.lit("")), r"[^A-Za-z0-9 ]", "")
    word = F.regexp_replace(F.btrim(word), r" +", " ")
    right = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("ord") % 3 + 1).cast("int"))
    stem = F.when(F.col("ord") % 11 == 5, F.lit(" ")).otherwise(F.concat(F.lit("Item <b>"), (F.col("ord") % 40).cast("string"), F.lit("</b> of<i></i> "), word))
    response = lambda v: F.concat(F.lit(f'<div class="oli-response" match="{v}" score="'), F.when(F.col("right") == v, "1").otherwise("0"), F.lit('"></div>'))
    html_ = F.concat(
        F.lit('<div class="oli-question" id="q'), F.col("ord").cast("string"), F.lit('"><div class="oli-body"><p>'), stem, F.lit('</p><img src="a/b'), (F.col("ord") % 5).cast("string"), F.lit('.png"></div>'),
        F.lit('<div class="oli-multiple-choice"><div value="A">wool (value: A)</div><div value="B">'), F.when(F.col("ord") % 13 == 7, " ").otherwise("iron [x]"), F.lit('</div><div value="C">clay</div></div>'),
        F.lit('<div class="oli-part" id="p1"><skillref idref=" s'), (F.col("ord") % 9).cast("string"), F.lit(' "></skillref>'), response("A"), response("B"), response("C"), F.lit("</div></div>\n"),
    )
    return table(spark, sf, "questions").select("ord", "question").withColumn("right", right).select("ord", html_.alias("html"))


def _pages(spark, sf) -> str:
    """A page per twenty questions, in two levels of folders; every page's first block comes twice."""
    root = f"{_folder(spark, 'pages')}/course"
    parts = _page_parts(spark, sf).withColumn("page", F.floor(F.col("ord") / 20))
    page = parts.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "html"))), lambda x: x["html"]).alias("blocks"))  # twenty a page
    whole = page.select("page", (F.col("page") % 3).alias("part"), F.concat(F.lit("<html><body>"), F.array_join(F.concat("blocks", F.slice("blocks", 1, 1)), ""), F.lit("</body></html>")).alias("value"))
    # One file per page: the name says which, as course folders have it.
    whole.repartition("page").write.partitionBy("part", "page").text(root)
    return root


def _read_pages(spark, root: str) -> DataFrame:
    """Pages by their folder; the files' own names are Spark's."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))
    number = F.regexp_extract("path", r"page=(\d+)", 1)
    return raw.where(number != "").select(F.lpad(number, 9, "0").alias("path"), "html")


def file_course_questions(spark, sf):
    """Valid questions of all course pages, exact repeats and equal texts folded, with skills and steps."""
    found = html.fold(html.questions(html.raw_blocks(_read_pages(spark, _pages(spark, sf)))))
    return found.select("id", q.rendered().alias("text"), F.array_join("skillref", "~").alias("skillref"), F.array_join("step_name", "~").alias("steps"), F.array_join("images", "~").alias("images"))


def file_course_rejects(spark, sf):
    """Why blocks of course pages are no valid questions, counted."""
    raw = html.raw_blocks(_read_pages(spark, _pages(spark, sf)))
    return raw.groupBy(F.coalesce(html.verdict(), F.lit("valid")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


_COURSE = """
WITH b AS (
  SELECT ord, floor(ord / 20) AS page, trim(regexp_replace(trim(regexp_replace(coalesce(question.stem, ''), '[^A-Za-z0-9 ]', '', 'g')), ' +', ' ', 'g')) AS w FROM questions
), blocks AS (
  SELECT ord, page, 0 AS again, w FROM b UNION ALL SELECT ord, page, 1, w FROM b WHERE ord = (SELECT min(ord) FROM b x WHERE x.page = b.page)
), judged AS (
  SELECT *, CASE WHEN ord % 11 = 5 THEN 'no stem' WHEN ord % 13 = 7 THEN 'blank choice' ELSE 'valid' END AS why FROM blocks
)
"""


# ------------------------------------------------------------------- tables
def file_kc_csv(spark, sf):
    """A label table with rendered questions (line ends, quotes) written as CSV and read back."""
    path = f"{_folder(spark, 'csv')}/x-kc.csv"
    rows = q.flat(table(spark, sf, "questions").drop("extras")).join(table(spark, sf, "kc_table").select("ord", "kc"), "ord")
    writers.csv(rows.select("ord", "id", "question", F.col("ord").alias("at"), "kc"), path, single=True, order="ord")
    return readers.kc_csv(spark, path).select(F.col("at").cast("bigint").alias("ord"), "id", "question", "kc")


def _template_file(spark, sf) -> str:
    path = f"{_folder(spark, 'template')}/t.txt"
    t = table(spark, sf, "kc_template").select("row_id", *KEYS, F.col("kc_lo").alias("KC (lo)"), F.col("kc_topic").alias("KC (topic)"), F.lit(" ").alias("KC (none)"))
    writers.tsv(evaluate.filed(t), path)
    return path


def file_template(spark, sf):
    """A template written and read back: blank cells null, the column without a value gone, rows numbered in order."""
    found = evaluate.plain(readers.template(spark, _template_file(spark, sf)))
    return found.withColumnsRenamed({"KC (lo)": "kc_lo", "KC (topic)": "kc_topic"})


def file_template_only(spark, sf):
    """The same with one label column asked for, and columns without a value kept."""
    found = evaluate.plain(readers.template(spark, _template_file(spark, sf), drop_empty=False, only="KC (lo)"))
    return found.withColumnsRenamed({"KC (lo)": "kc_lo"})


def file_template_fill(spark, sf):
    """A model put into a template file along a unique-step file, whatever splits the two are read in."""
    t_path = _template_file(spark, sf)
    u_path = f"{_folder(spark, 'unique')}/u.txt"
    t = table(spark, sf, "kc_template")
    unique = F.when(F.btrim("step_name") != "", F.concat_ws(" ", *KEYS)).otherwise(F.lit(" "))
    pad = F.repeat(F.lit("x"), 400)  # a much longer file than the template's
    writers.tsv(evaluate.filed(t.select("row_id", *KEYS, pad.alias("Notes"), unique.alias("KC (Unique-step)"))), u_path)
    template = evaluate.plain(readers.template(spark, t_path))
    filled = kcmodel.fill_template(template, kcmodel.step_labels(reference._labelled(spark, sf)), evaluate.unique_steps(spark, u_path, template), "new")
    return filled.withColumnRenamed("KC (new)", "kc_new")


def file_template_adjust(spark, sf):
    """A template file without the labels no question stands for, saved and read back."""
    t_path, folder = _template_file(spark, sf), _folder(spark, "adjusted")
    t = table(spark, sf, "kc_template")
    writers.tsv(evaluate.filed(t.select("row_id", *KEYS, F.when(F.btrim("step_name") != "", F.lit("u")).otherwise(F.lit(" ")).alias("KC (Unique-step)"))), f"{folder}/u.txt")
    evaluate.adjusted(spark, _lines(spark, sf), t_path, f"{folder}/u.txt", f"{folder}/new.txt", {"lo": "goal"})
    found = evaluate.plain(readers.template(spark, f"{folder}/new.txt", drop_empty=False))
    return found.withColumnsRenamed({"KC (goal)": "kc_goal", "KC (topic-new)": "kc_topic_new"})


_ROWS = f"SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {', '.join(f'CASE WHEN {k} NOT IN {names.BLANK_VALUES!r} THEN {k} END AS {k}' for k in KEYS)}, row_id AS old_id FROM kc_template"


def _log_file(spark, sf) -> str:
    path = f"{_folder(spark, 'log')}/ss.txt"
    back = {v: k for k, v in readers.schemas.STEP_COLUMNS.items()}
    log = table(spark, sf, "student_step").select("row_id", *(F.col(c).alias(k) for c, k in back.items()), F.lit(1).alias("Other"))
    writers.tsv(log, path)
    return path


def file_student_steps(spark, sf):
    """A log written and read back: six columns, ids as texts, rows in file order."""
    log = readers.student_steps(spark, _log_file(spark, sf))
    return readers.with_ord(log, "row_id", "n").drop("row_id").withColumnRenamed("n", "row_id")


def file_merged_log(spark, sf):
    """A log file with labels and opportunities, written as the export does and read back."""
    folder = _folder(spark, "merged")
    log = readers.student_steps(spark, _log_file(spark, sf))
    merged = steps.merge(log, reference._unique_template(spark, sf), multiplier=2, check=False)
    path = f"{folder}/{writers.merged_name('all-kc', False, 2)}"
    writers.tsv(writers.display_opportunities(evaluate.filed(merged)), path)
    found = readers.with_ord(readers.with_row_id(spark.read.csv(path, sep="\t", header=True, escape='"'), "at"), "at", "row_id")
    return found.select("row_id", F.col("`KC (lo)`").alias("kc_lo"), F.col("`Opportunity (lo)`").cast("bigint").alias("opp_lo"), F.col("`KC (topic-1)`").alias("kc_topic_1"), F.col("`Opportunity (topic-1)`").cast("bigint").alias("opp_topic_1"))


def file_kc_values(spark, sf):
    """Label values written as CSV with a number column and read by their schema."""
    path = f"{_folder(spark, 'values')}/lo_kc-values.csv"
    v = table(spark, sf, "kc_values").orderBy("kc_name").withColumn("_c0", F.lit(0))
    v.select("_c0", "kc_name", "n_steps", "n_obs", "intercept_logit", "intercept_prob", "slope").write.csv(path, header=True, escape='"')
    return readers.kc_values(spark, path).withColumn("model", F.lit(names.values_model(path)))


def file_cv_results(spark, sf):
    """Cross-validation results written as XML and read into their table."""
    path = f"{_folder(spark, 'cv')}/cv.xml"
    cv = reference._cv(spark, sf).groupBy(F.col("column").alias("name"), "entry").pivot("metric", ["aic", "rmse"]).agg(F.first("value"))
    cv.drop("entry").write.format("xml").option("rowTag", "model").option("rootTag", "models").save(path)
    found = crossval.folded(readers.cv_results(spark, path))
    return found.groupBy("model", "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.count("value").alias("n"))


def file_embeddings(spark, sf):
    """Vectors written, their number checked, and read back."""
    path = f"{_folder(spark, 'vectors')}/bank-question-embed"
    v = reference._vectors(spark, sf)
    writers.vectors(v, path)
    return readers.embeddings(spark, path, v.count()).select("ord", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def file_log_probs(spark, sf):
    """Scores stored the other way round, read, checked and made into mutual information."""
    path = f"{_folder(spark, 'scores')}/scores"
    given = reference._scores(spark, sf)
    swap = F.col("cond_ord").isNotNull()
    writers.scores(given.select(F.when(swap, F.col("ord")).alias("cond_ord"), F.coalesce("cond_ord", "ord").alias("ord"), "logp"), path)
    n = table(spark, sf, "questions").count()
    found = readers.log_probs(spark, path, n, cond_on_dim=1)
    check = readers.holes(found, n).first()
    if check.present != check.expected or check.not_finite:
        raise ValueError(f"scores are not whole: {check}")
    return congruity.pmi(found, few=n).select("i", "k", F.round("s", 4).alias("s"))


def file_run(spark, sf):
    """What a run leaves: its side file, label tables and embeddings, as the next program finds them."""
    folder = writers.run_dir(spark, _folder(spark, "run"), "Mon Jan  1 10:00:00 2024", exist_ok=False)
    writers.sidecar(spark, folder, "concept", "some/bank.jsonl", {"verbal": True})
    few = table(spark, sf, "kc_values").select("kc_name")
    for name in ("b-cosine", "a", "pmi"):
        writers.csv(few, f"{folder}/{name}-kc.csv", single=True)
    writers.vectors(reference._vectors(spark, sf), f"{folder}/bank-question-embed")
    side = readers.sidecar(spark, folder)
    found = [("folder", files.base_name(folder)), ("data_path", side["data_path"]), ("verbal", str(side["verbal"])), ("cond_on_dim", str(side["cond_on_dim"]))]
    found += [("model", m) for m, _ in readers.kc_directory(spark, folder)] + [("embeddings", k) for k in readers.artifacts(spark, folder)]
    return spark.createDataFrame(found, "what string, value string")


def file_folder_metrics(spark, sf):
    """Two label tables of a folder against the skills they carry."""
    folder = _folder(spark, "kcs")
    rows = table(spark, sf, "questions").select("ord", "skill", "topic").join(table(spark, sf, "kc_table").select("ord", "kc"), "ord")
    for name, column in (("own", "kc"), ("topic", "topic")):
        writers.csv(rows.select("ord", "skill", F.col(column).alias("KC")), f"{folder}/{name}-kc.csv", single=True, order="ord")
    return evaluate.folder(spark, folder).select("model", "n_labels", *(F.round(m, 6).alias(m) for m in metrics.MEASURES))


def file_template_metrics(spark, sf):
    """The models of a template file against its topics."""
    return evaluate.template(spark, _template_file(spark, sf), "topic").select("model", "n_labels", *(F.round(m, 6).alias(m) for m in metrics.MEASURES))


_ALL = (
    file_question_lines, file_question_literals, file_science, file_course_questions, file_course_rejects, file_kc_csv, file_template, file_template_only, file_template_fill, file_template_adjust,
    file_student_steps, file_merged_log, file_kc_values, file_cv_results, file_embeddings, file_log_probs, file_run, file_folder_metrics, file_template_metrics,
)
QUERIES = {f.__name__: f for f in _ALL}


def _measured(pairs: str) -> str:
    from .reference_sql import _measures

    return _measures(pairs)


_BLANK = repr(names.BLANK_VALUES)
_LOG = f"""
log AS (
  SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, anon_student_id, {', '.join(f"CASE WHEN {c} NOT IN {_BLANK} THEN {c} END AS {c}" for c in ('problem_hierarchy', 'problem_name', 'step_name', 'first_transaction_time', 'first_attempt'))} FROM student_step
)
"""
SQL = {
    "file_question_lines": _SHOWN,
    "file_question_literals": _SHOWN,
    "file_science": _SCIENCE,
    "file_course_rejects": _COURSE + "SELECT why, count(*) AS n FROM judged GROUP BY 1",
    "file_course_questions": _COURSE
    + """, once AS (
      SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS n, 'Item ' || (ord % 40) || ' of' || CASE WHEN w <> '' THEN ' ' || w ELSE '' END || chr(10) || 'a) wool' || chr(10) || 'b) iron' || chr(10) || 'c) clay' || chr(10) || 'Answer: ' || chr((97 + ord % 3)::INTEGER) AS text
      FROM judged WHERE why = 'valid' AND again = 0
    ) SELECT 'elearning-mcq-' || min(n) AS id, text, string_agg('s' || (ord % 9), '~' ORDER BY n) AS skillref, string_agg('q' || ord || '_p1', '~' ORDER BY n) AS steps, arg_min('b' || (ord % 5) || '.png', n) AS images FROM once GROUP BY text""",
    "file_kc_csv": f"WITH {RENDER} SELECT r.ord, r.id, r.txt AS question, CASE WHEN k.kc <> '' THEN k.kc END AS kc FROM rendered r JOIN kc_table k ON k.ord = r.ord",
    "file_template": f"WITH {TEMPLATE}, n AS ({_ROWS}) SELECT n.* EXCLUDE (old_id), t.lo AS kc_lo, t.topic AS kc_topic FROM n JOIN t ON t.row_id = n.old_id",
    "file_template_only": f"WITH {TEMPLATE}, n AS ({_ROWS}) SELECT n.* EXCLUDE (old_id), t.lo AS kc_lo FROM n JOIN t ON t.row_id = n.old_id",
    "file_template_fill": f"""WITH {TEMPLATE}, n AS ({_ROWS}) SELECT n.* EXCLUDE (old_id), CASE WHEN lo IS NOT NULL AND topic IS NOT NULL AND has_unique THEN s.label END AS kc_new
      FROM n JOIN t ON t.row_id = n.old_id LEFT JOIN step_kc s ON s.step_name = n.step_name""",
    "file_template_adjust": f"""WITH {TEMPLATE}, n AS ({_ROWS}), known AS (SELECT DISTINCT unnest(ds_step_name) AS step_name FROM questions), m AS (
        SELECT n.*, t.lo, t.topic, lo IS NOT NULL AND topic IS NOT NULL AND has_unique AND k.step_name IS NOT NULL AS ok FROM n JOIN t ON t.row_id = n.old_id LEFT JOIN known k ON k.step_name = n.step_name)
      SELECT row_id, problem_hierarchy, problem_name, step_name, CASE WHEN ok THEN lo END AS kc_goal, CASE WHEN ok THEN topic END AS kc_topic_new FROM m""",
    "file_student_steps": f"WITH {_LOG} SELECT * FROM log",
    "file_merged_log": f"""WITH {TEMPLATE}, u0 AS (SELECT row_id, translate(problem_hierarchy, '()', '') AS problem_hierarchy, problem_name, step_name, lo, topic FROM t),
      u AS (SELECT problem_hierarchy, problem_name, step_name, arg_min(struct_pack(lo := lo, topic := topic), row_id) AS x FROM u0 GROUP BY 1, 2, 3), {_LOG},
      merged AS (SELECT l.row_id, l.anon_student_id, u.x.lo AS lo, u.x.topic AS topic FROM log l LEFT JOIN u
        ON translate(l.problem_hierarchy, '()', '') IS NOT DISTINCT FROM u.problem_hierarchy AND l.problem_name IS NOT DISTINCT FROM u.problem_name AND l.step_name IS NOT DISTINCT FROM u.step_name)
      SELECT row_id, lo AS kc_lo, CASE WHEN lo IS NOT NULL THEN row_number() OVER (PARTITION BY anon_student_id, lo ORDER BY row_id) END AS opp_lo, topic AS kc_topic_1,
        CASE WHEN topic IS NOT NULL THEN row_number() OVER (PARTITION BY anon_student_id, topic ORDER BY row_id) END AS opp_topic_1 FROM merged""",
    "file_kc_values": "SELECT kc_name, n_steps, n_obs, intercept_logit, intercept_prob, slope, 'lo' AS model FROM kc_values",
    "file_cv_results": CV + "SELECT model, metric, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS n FROM cv GROUP BY 1, 2",
    "file_embeddings": "SELECT ord, len(embedding) AS size, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM question_vecs WHERE embedding IS NOT NULL",
    "file_log_probs": PIPELINE_SQL["pmi_raw"],
    "file_run": """SELECT * FROM (VALUES ('folder', 'Mon_Jan__1_10-00-00_2024'), ('data_path', 'some/bank.jsonl'), ('verbal', 'True'), ('cond_on_dim', '0'),
      ('model', 'a'), ('model', 'b-cosine'), ('model', 'pmi'), ('embeddings', 'question')) AS x(what, value)""",
    "file_folder_metrics": _measured("""rows_ AS (SELECT q.skill, k.kc, q.topic FROM questions q JOIN kc_table k ON k.ord = q.ord),
      pairs AS (SELECT 'own' AS model, CASE WHEN skill <> '' THEN skill END AS "true", CASE WHEN kc <> '' THEN kc END AS pred FROM rows_
        UNION ALL SELECT 'topic', CASE WHEN skill <> '' THEN skill END, CASE WHEN topic <> '' THEN topic END FROM rows_)"""),
    "file_template_metrics": _measured(TEMPLATE + """, pairs AS (SELECT 'lo' AS model, topic AS "true", lo AS pred FROM t)"""),
}
