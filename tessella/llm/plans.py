"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import durable, table
from . import canonical, clusters, groups, knn, ledger, lookalike, mixing, near, subjects, tokens


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return durable(canonical.canonical_questions(table(spark, sf, "questions")), "keyed")


def _counted(keyed: DataFrame) -> ledger.Ledger:
    return ledger.count_copies(ledger.in_batches(keyed), keyed.sparkSession)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of questions that are the same but for their formatting."""
    keyed = _keyed(spark, sf)
    return ledger.copy_pairs(keyed, _counted(keyed))


def p2_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Each question once, by its earliest copy, with the number of its copies."""
    return _counted(_keyed(spark, sf)).read().select(ledger.F.col("first_ord").alias("ord"), ledger.F.col("n").alias("n_copies"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of questions whose words overlap by 0.7 or more and that are no copies."""
    return near.near_pairs(durable(canonical.canonical_questions(table(spark, sf, "questions"), words=True), "canonical"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every question that is linked to others as a copy or near-duplicate, with its group and the number of its links.

    Links are between units of equal questions, so copies are not expanded
    into pairs.
    """
    return near.near_groups(durable(canonical.canonical_questions(table(spark, sf, "questions"), words=True), "canonical"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Stems and choice texts that hold a stand-in."""
    return lookalike.standins(table(spark, sf, "questions"))


def p4_uniform(spark: SparkSession, sf: str) -> DataFrame:
    """Every stem and choice text in its one form."""
    return lookalike.uniform_questions(table(spark, sf, "questions")).select("ord", "field_name", "pos", "uniform_text")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of questions of which one's vector is among the five nearest of the other's."""
    return knn.neighbour_pairs(table(spark, sf, "question_vecs"))


def p5_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest of every question's vector, with their cosine."""
    return knn.neighbours(table(spark, sf, "question_vecs")).select(knn.F.col("id").alias("ord"), knn.F.col("near").alias("near_ord"), knn.F.round("cos", 9).alias("cos"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.question_clusters(table(spark, sf, "questions"), table(spark, sf, "kc_table"), table(spark, sf, "kc_values"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every question, by the name most of its labelled members carry."""
    return _clusters(spark, sf)


def p7_typical(spark: SparkSession, sf: str) -> DataFrame:
    """Size and five most typical questions of every cluster."""
    return clusters.typical(table(spark, sf, "questions"), _clusters(spark, sf))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode(table(spark, sf, "documents"))


def p8_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The text of every document, decoded from its ids; null texts come back empty."""
    return tokens.decode(tokens.encode(table(spark, sf, "documents")))


def p8_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Where every token of a document starts in its UTF-8 bytes, and whether it ends inside a character."""
    return tokens.offsets(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    return mixing.unreachable(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How many times each document is used in the mixture."""
    return mixing.mix(mixing.sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached."""
    sized, targets = mixing.sizes(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets), sized, targets)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The subjects every document is about."""
    return subjects.subjects(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "subject_list"))


QUERIES = {f.__name__: f for f in (p2_found, p2_copies, p3_found, p3_groups, p4_found, p4_uniform, p5_found, p5_neighbours, p7_found, p7_typical, p8_ids, p8_roundtrip, p8_offsets, p9_found, p9_mix, p9_shares, p10_found)}
_NEAREST = """
WITH v AS (SELECT ord, CAST(embedding AS DOUBLE[]) AS e FROM question_vecs WHERE embedding IS NOT NULL),
n AS (SELECT ord, e, sqrt(list_inner_product(e, e)) AS m FROM v WHERE list_inner_product(e, e) > 0),
pairs AS (SELECT a.ord, b.ord AS near_ord, round(list_inner_product(a.e, b.e) / (a.m * b.m), 12) AS cos FROM n a JOIN n b ON a.ord <> b.ord),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY cos DESC, near_ord) AS rn FROM pairs) WHERE rn <= 5)
"""
SQL = {
    "p5_found": _NEAREST + "SELECT DISTINCT least(ord, near_ord) AS ord_a, greatest(ord, near_ord) AS ord_b FROM best",
    "p5_neighbours": _NEAREST + "SELECT ord, near_ord, round(cos, 9) AS cos FROM best",
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
