"""Command line: concepts, pair scores, label discovery, export to steps, refinement, evaluation.

    python -m tessella.cli concept  --data_path q.jsonl --output_dir out [--verbal] [--q_embeds] [--labeler m:f] [--embedder m:f] [--batch_size 16] [--num_beams n] [--length_penalty x]
    python -m tessella.cli pmi      --data_path q.jsonl --output_dir out [--scorer m:f] [--batch_size 16]
    python -m tessella.cli build    --concept_dir out --pmi_dir out [--output_dir kcs]
    python -m tessella.cli export   --kc_dir kcs --kc_temp t.txt --step_kc u.txt [--ss_path ss.txt] [--minimal] [--multiplier m]
    python -m tessella.cli refine   --kc_path all.txt --kc_val_path v.csv --concept_dir out --pmi_dir out [--ss_path ss.txt] [--minimal] [--multiplier m]
    python -m tessella.cli evaluate --kc_dir kcs [--true_kc skill] [--random] | --kc_temp all.txt --true_kc lo [--random]

Scores, concepts and embeddings come from the native scorer.  ``--scorer``,
``--labeler`` and ``--embedder`` name a function ``module:function`` that is
called once per Python worker and gives the model: a function of contexts and
texts that returns a log-probability, a label or a vector for each.  Options a
labeler may want (beams, length penalty) are handed to that function by name.
Paths may be on any file system that Spark knows.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions import questions as q
from .operators import affinity, congruity, evaluate, kcmodel, refine, scoring, similarity, steps
from .session import durable
from .sources import files, readers, writers


def _load(spark: SparkSession, path: str) -> DataFrame:
    return durable(readers.questions(spark, path), "questions")


def _model(name: str, **options):
    """A loader of the model that ``module:function`` makes."""
    return lambda: scoring.loaded(name)(**options)


def concept(
    spark: SparkSession,
    data_path: str,
    output_dir: str,
    verbal: bool = False,
    q_embeds: bool = False,
    labeler: str | None = None,
    embedder: str | None = None,
    batch_size: int = 16,
    **generation,
) -> str:
    """A concept table and, if asked for, question embeddings; concepts' own embeddings always."""
    questions = _load(spark, data_path)
    texts = questions.select("ord", q.rendered().alias("text"))
    if labeler:
        asked = questions.select("ord", q.concept_prompt(verbal).alias("context"), F.lit("").alias("text"))
        found = scoring.external_labels(asked, _model(labeler, **generation), batch_size)
    else:
        found = scoring.key_phrase(texts, verbal)
    found = durable(found.select("ord", q.cleaned_concept(F.col("concept")).alias("KC")), "concepts")
    flat = durable(q.flat(questions.drop("extras")).join(found, "ord"), "flat")
    files.make_folder(spark, output_dir)
    base = f"{output_dir}/{writers.stem(data_path)}"
    writers.csv(flat, f"{base}-concept.csv", single=True, order="ord")
    flat.write.parquet(f"{base}-concept")

    def vectors(df: DataFrame, context) -> DataFrame:
        if embedder:
            return scoring.external_vectors(df.withColumn("context", context), _model(embedder), batch_size)
        return scoring.hashed_embedding(df)

    writers.vectors(vectors(found.select("ord", F.col("KC").alias("text")), F.lit("")), f"{base}-concept-embed")
    if q_embeds:
        asked = questions.select("ord", q.rendered().alias("text"), q.marginal_context().alias("_context"))
        writers.vectors(vectors(asked if embedder else asked.drop("_context"), F.col("_context") if embedder else F.lit("")), f"{base}-question-embed")
    writers.sidecar(spark, output_dir, "concept", data_path, {"verbal": verbal, "q_embeds": q_embeds, "labeler": labeler, "embedder": embedder, "batch_size": batch_size} | generation)
    return output_dir


def pmi(spark: SparkSession, data_path: str, output_dir: str, scorer: str | None = None, batch_size: int = 16) -> str:
    """The log-probs of all pairs."""
    questions = _load(spark, data_path)
    n = questions.count()
    if scorer:
        scores = scoring.external(scoring.prompts(questions, n), _model(scorer), batch_size)
    else:
        scores = scoring.query_likelihood(questions.select("ord", q.rendered().alias("text")), n)
    files.make_folder(spark, output_dir)
    writers.scores(scores, f"{output_dir}/scores")
    writers.sidecar(spark, output_dir, "pmi", data_path, {"cond_on_dim": 0, "scorer": scorer, "batch_size": batch_size})
    return output_dir


def _similarities(spark: SparkSession, concept_dir: str | None, pmi_dir: str | None) -> tuple[DataFrame, dict[str, DataFrame], int]:
    """Concepts, similarities by name and the number of questions."""
    out: dict[str, DataFrame] = {}
    args = readers.sidecar(spark, concept_dir)
    stem = writers.stem(args["data_path"])
    concepts = spark.read.parquet(f"{concept_dir}/{stem}-concept")
    if kcmodel.invalid_concepts(concepts).limit(1).count():
        raise ValueError("some concepts are blank")
    n = concepts.count()
    for kind in readers.artifacts(spark, concept_dir):
        vectors = readers.embeddings(spark, f"{concept_dir}/{stem}-{kind}-embed", n)
        out[f"{kind}-cosine"] = similarity.similarity(vectors, n, "cosine")
    if pmi_dir:
        own = readers.sidecar(spark, pmi_dir)
        scores = readers.log_probs(spark, f"{pmi_dir}/scores", n, own["cond_on_dim"])
        check = readers.holes(scores, n).first()
        if check.present != check.expected or check.not_finite:
            raise ValueError(f"scores are not whole: {check}")
        out["pmi"] = congruity.pmi(scores, normalize=True, symmetric=True)
    return concepts, out, n


def build(spark: SparkSession, concept_dir: str, pmi_dir: str | None = None, output_dir: str = "kcs", use_p: str = "median") -> str:
    """Label tables by concept and by clusters over every similarity there is."""
    concepts, similarities, n = _similarities(spark, concept_dir, pmi_dir)
    files.make_folder(spark, output_dir)
    writers.csv(concepts, f"{output_dir}/concept-kc.csv", single=True, order="ord")
    base = concepts.drop("KC")
    labels = concepts.select("ord", F.col("KC").alias("concept"))
    for name, edges in similarities.items():
        found = affinity.search(durable(edges, "edges"), n, use_p)
        if found is not None:
            writers.csv(kcmodel.label_clusters(base, found, labels), f"{output_dir}/{name}-kc.csv", single=True, order="ord")
    writers.sidecar(spark, output_dir, "kc", readers.sidecar(spark, concept_dir)["data_path"], {"use_p": use_p})
    return output_dir


def _merged(spark: SparkSession, template: DataFrame, ss_path: str, out: str, base: str, minimal: bool, multiplier: int) -> None:
    log = steps.merge(readers.student_steps(spark, ss_path), template, minimal, multiplier)
    back = {v: k for k, v in (("Anon Student Id", "anon_student_id"), ("First Transaction Time", "first_transaction_time"), ("First Attempt", "first_attempt"))}
    writers.tsv(writers.display_opportunities(evaluate.filed(log).withColumnsRenamed(back)), f"{out}/{writers.merged_name(base, minimal, multiplier)}")


def export(spark: SparkSession, kc_dir: str, kc_temp: str, step_kc: str, ss_path: str | None = None, minimal: bool = False, multiplier: int = 1, mask_mode: str = "sequential") -> str:
    """All label tables of a folder in the template and, with a log, in its steps."""
    tables = readers.kc_directory(spark, kc_dir)
    out = writers.run_dir(spark, kc_dir, exist_ok=False)
    template = evaluate.plain(readers.template(spark, kc_temp))
    unique = evaluate.unique_steps(spark, step_kc, template)
    models = [(name, kcmodel.step_labels(readers.with_row_id(readers.kc_csv(spark, path), "_at").withColumnRenamed("ds_step_name", "steps"), "steps", "KC", "_at")) for name, path in tables]
    filled = durable(kcmodel.fill_models(template, models, unique, mask_mode), "template")
    writers.tsv(evaluate.filed(filled), f"{out}/all-kc.txt")
    if ss_path:
        _merged(spark, filled, ss_path, out, "all-kc", minimal, multiplier)
    return out


def refined(spark: SparkSession, kc_path: str, kc_val_path: str, concept_dir: str, pmi_dir: str | None, ss_path: str | None = None, minimal: bool = False, multiplier: int = 1, base: str = "results/kc-refine", strict: bool = False) -> str:
    """New models for labels with flat curves: by concept, by question embeddings and by mutual information.

    With ``strict`` a refined row that keeps its label is an error.
    """
    column = f"KC ({names.values_model(kc_val_path)})"
    template = evaluate.plain(readers.template(spark, kc_path, drop_empty=False, only=column))
    if column not in template.columns:
        raise ValueError(f"{column} is not in {kc_path}")
    out = writers.run_dir(spark, base, exist_ok=False)
    flagged = durable(refine.flat_labels(readers.kc_values(spark, kc_val_path)), "flagged")
    if refine.count_mismatch(flagged, template, column).limit(1).count():
        raise ValueError("the template and the label values count steps differently")
    concepts, similarities, _ = _similarities(spark, concept_dir, pmi_dir)
    questions = _load(spark, readers.sidecar(spark, concept_dir)["data_path"]).select("ord", "ds_step_name")
    labels = concepts.select("ord", F.col("KC").alias("concept"))
    members = durable(refine.label_questions(flagged, template, column, questions), "members")
    ways = {"cpt": members.withColumn("exemplar", F.col("ord"))}
    for prefix, name in (("qcos", "question-cosine"), ("pmi", "pmi")):
        if name in similarities:
            ways[prefix] = durable(refine.recluster(members, similarities[name]), prefix)
    full = template
    for prefix, clusters in ways.items():
        new = refine.refined_labels(clusters, labels, questions)
        changed = durable(refine.relabel(template, column, new, prefix), "changed")
        kept = refine.unchanged(changed, template, column, prefix)
        if strict and kept.limit(1).count():
            raise ValueError(f"{prefix} leaves {kept.count()} refined rows their label")
        full = refine.widen(full, column, changed)
    full = durable(full, "refined")
    writers.tsv(evaluate.filed(full), f"{out}/refined-kc.txt")
    if ss_path:
        _merged(spark, full, ss_path, out, "refined-kc", minimal, multiplier)
    return out


def evaluated(spark: SparkSession, kc_dir: str | None = None, kc_temp: str | None = None, true_kc: str = "skill", random: bool = False) -> str:
    """Measures of all models of a folder or of a template, as a text table."""
    if (kc_dir is None) == (kc_temp is None):
        raise ValueError("a folder or a template, one of them")
    found = evaluate.folder(spark, kc_dir, true_kc, random) if kc_dir else evaluate.template(spark, kc_temp, true_kc, random)
    return found.orderBy("model").toPandas().to_string(index=False)  # a row per model


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="program", required=True)

    def program(name: str, required: list[str], optional: list[str], flags: list[str] = (), numbers: dict[str, int | float | None] | None = None):
        p = sub.add_parser(name)
        for a in required:
            p.add_argument(f"--{a}", required=True)
        for a in optional:
            p.add_argument(f"--{a}")
        for a in flags:
            p.add_argument(f"--{a}", action="store_true")
        for a, d in (numbers or {}).items():
            p.add_argument(f"--{a}", type=float if a == "length_penalty" else int, default=d)

    program("concept", ["data_path", "output_dir"], ["labeler", "embedder"], ["verbal", "q_embeds"], {"batch_size": 16, "num_beams": None, "length_penalty": None})
    program("pmi", ["data_path", "output_dir"], ["scorer"], [], {"batch_size": 16})
    program("build", ["concept_dir"], ["pmi_dir", "output_dir"])
    program("export", ["kc_dir", "kc_temp", "step_kc"], ["ss_path"], ["minimal"], {"multiplier": 1})
    program("refine", ["kc_path", "kc_val_path", "concept_dir"], ["pmi_dir", "ss_path"], ["minimal", "strict"], {"multiplier": 1})
    program("evaluate", [], ["kc_dir", "kc_temp", "true_kc"], ["random"])
    args = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    run = {"concept": concept, "pmi": pmi, "build": build, "export": export, "refine": refined, "evaluate": evaluated}[args.pop("program")]
    if run is refined:
        args.setdefault("pmi_dir", None)
    print(run(SparkSession.builder.appName("tessella").getOrCreate(), **args))


if __name__ == "__main__":
    main()
