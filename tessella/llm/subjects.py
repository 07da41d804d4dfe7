"""Subjects of documents by class-association rules.

A labelled document's statements (sentences, lines) are transactions: the words
of a statement, and the document's subject as their class.  Frequent itemsets
are mined by frequent-pattern growth in parallel: words are put in order of
frequency, every statement is projected on each of its words together with the
more frequent words before it, and projections are counted by word and subject
and grown word by word, level by level.  The projected rows lie spread over all
tasks and are added up before they are shuffled, so no task gathers the
projection of one word, and repeated statements are one row with a count.

Only itemsets that can still give a better rule are grown: not those that cover
the same statements as one of their subsets, nor those that no longer word list
could make surer.  A rule is an itemset with a subject of enough confidence; it
is redundant, and pruned, if any of its proper subsets has as much confidence.
Confidence is calibrated by shrinking it to the subject's share of all
statements.

Every document is scored over all its statements: the matching rules of a
statement add their evidence (log of calibrated confidence over prior), which
is turned into the subjects' shares of the statement; the document adds up the
shares.  A document is about a subject if a fair share of its telling
statements, and more than a passing one, speak for it, so a document may have
several subjects or none.

Mining is done with the given labels, then again with these and the documents
the rules are sure of, which reaches words and languages the labels hardly
touch and outweighs wrong labels.  A subject for which a later fit has no rule
keeps its earlier ones.  Texts are parsed once; every round scores all
documents, and every fit counts all statements it is given.

Bounds: a rule has at most ``LONGEST`` words; a statement of more than
``WINDOW`` words (a text without any stop) is read as several, none of its
words is left out.

Defined results: null, empty and blank texts have no subject; labels outside
the list of subjects are ignored; without labels no document has a subject.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable, forget, width
from .lookalike import unify

SUPPORT = 3  # statements a rule is seen in, at least
# How far a share exceeds the subject's prior, of what it could: (share - prior) / (1 - prior).
GAIN = 0.55  # of a rule
WORD_GAIN = 0.28  # of a word, to be mined
SHRINK = 2.0
LONGEST = 5  # words of a rule
WINDOW = 64  # words of a statement
SHARE = 0.27  # of the telling statements
OF_ALL = 0.1  # of all statements
ENOUGH = 1.5  # shares of statements that are more than a passing mention: nearer to two than to one
SURE, SURE_STATEMENTS = 0.85, 3
ROUNDS = 2  # fits after the first

STATEMENT = regex.compile(r"(?<=[.!?])\s+|(?<=[。！？])|[\r\n]+")
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
HAN = regex.compile(r"\p{Han}+")


def statements(text: str | None) -> list[set[str]]:
    """The words of every statement; for Han, which has no blanks, pairs of characters."""
    out = []
    for part in STATEMENT.split(unify(text or "").lower()):
        items = set()
        for word in LETTERS.findall(part):
            if HAN.search(word):
                units = [run[i : i + 2] for run in HAN.findall(word) for i in range(len(run) - 1)]
            else:
                units = [word] if len(word) > 1 else []
            for unit in units:
                if len(items) == WINDOW and unit not in items:
                    out.append(items)
                    items = set()
                items.add(unit)
        if items:
            out.append(items)
    return out


def parsed(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, parts`` of ``key, text``: the words of every statement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[sorted(items) for items in statements(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.list_(pa.string())))], names=[key, "parts"])

    return documents.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, f"{key} bigint, parts array<array<string>>")


def transactions(labelled: DataFrame) -> DataFrame:
    """``subject, words`` of every statement of ``subject, parts``."""
    return labelled.select("subject", F.explode("parts").alias("words"))


def _of_classes(counts: str = "counts"):
    """Number of statements of an itemset, from its ``counts`` (array of subject and number)."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])


def _confidence(n, whole, prior):
    return (n + SHRINK * prior) / (whole + SHRINK)


def mine(given: DataFrame) -> tuple[list[tuple[tuple[str, ...], str, float]], dict[str, float]]:
    """Rules ``(words, subject, evidence)`` and the priors from transactions ``subject, words``.

    What comes to the driver are the rules that are left; they grow with the
    words that lean to a subject, not with the documents.
    """
    counts = {r.subject: r.n for r in given.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per subject
    total = sum(counts.values())
    if not total:
        return [], {}
    prior = {s: n / total for s, n in counts.items()}
    spark = given.sparkSession
    priors = F.broadcast(spark.createDataFrame(list(prior.items()), "subject string, prior double"))
    # Words that lean to a subject, numbered by frequency (ties by name): place 0 is the most frequent.
    per = given.select("subject", F.explode("words").alias("w")).groupBy("w", "subject").agg(F.count(F.lit(1)).alias("n")).join(priors, "subject")
    per = per.withColumn("whole", F.sum("n").over(Window.partitionBy("w")))
    gain = (F.col("n") / F.col("whole") - F.col("prior")) / F.greatest(1 - F.col("prior"), F.lit(1e-9))
    leaning = durable(per.where((F.col("n") >= SUPPORT) & (gain >= WORD_GAIN)).select("w", "whole").distinct(), "leaning")
    # The statements as arrays of leaning words, most frequent first; equal ones are one row.
    numbered = durable(given.select("subject", "words", F.monotonically_increasing_id().alias("row")), "statements")
    met = numbered.select("row", "subject", F.explode("words").alias("w")).join(leaning, "w")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("whole")).alias("f"), "w"))), lambda x: x["w"])  # at most WINDOW words
    projected = met.groupBy("row", "subject").agg(ordered.alias("before")).groupBy("before", "subject").agg(F.count(F.lit(1)).alias("n"))
    projected = durable(projected.select(F.array().cast("array<string>").alias("items"), "before", "subject", "n"), "projected")
    forget(numbered)
    levels: list[DataFrame] = []
    for size in range(1, LONGEST + 1):
        # Grow every itemset by each word before its first one, and count by subject.
        grown = projected.select(
            F.posexplode("before").alias("at", "w"), "items", "before", "subject", "n"
        ).select(F.concat(F.array("w"), "items").alias("items"), F.slice("before", 1, F.col("at")).alias("before"), "subject", "n")
        per_class = grown.groupBy("items", "subject").agg(F.sum("n").alias("n"))
        found = per_class.groupBy("items").agg(F.collect_list(F.struct("subject", "n")).alias("counts")).withColumn("whole", _of_classes())  # a subject each
        found = found.where(F.exists("counts", lambda c: c["n"] >= SUPPORT))
        if size > 1:
            # An itemset that covers what a subset covers, or has a subset that was not grown, gives no better rule.
            subset = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.filter("items", lambda x, j: j != i - 1)))
            below = levels[-1].where("open").select(F.col("items").alias("sub"), F.col("whole").alias("sub_whole"))
            whole = found.select("items", "whole", subset.alias("sub")).join(below, "sub").where("sub_whole > whole").groupBy("items").agg(F.count(F.lit(1)).alias("n_subs"))
            found = found.join(whole.where(F.col("n_subs") == size), "items", "left_semi")
        weighted = F.transform("counts", lambda c: F.struct(c["subject"].alias("subject"), c["n"].alias("n"), F.try_element_at(F.create_map(*(x for s, p in prior.items() for x in (F.lit(s), F.lit(p)))), c["subject"]).alias("prior")))
        found = found.withColumn("counts", weighted)
        # The surest a longer rule can be: all statements of a subject that the itemset has, and no other.
        better = F.exists("counts", lambda c: (c["n"] >= SUPPORT) & (_confidence(c["n"], c["n"], c["prior"]) > _confidence(c["n"], F.col("whole"), c["prior"]) + 1e-12))
        found = durable(found.withColumn("open", better), "itemsets")
        levels.append(found)
        if size == LONGEST or not found.where("open").limit(1).count():
            break
        # The next projections: only below itemsets that are grown, and of these only where a word is left.
        kept = grown.where(F.size("before") > 0).join(found.where("open").select("items"), "items", "left_semi")
        after = durable(kept.groupBy("items", "before", "subject").agg(F.sum("n").alias("n")), "projected")
        forget(projected)
        projected = after
    sure = levels[0]
    for more in levels[1:]:
        sure = sure.unionByName(more)
    sure = sure.select("items", "whole", F.explode("counts").alias("c")).select(F.array_sort("items").alias("words"), "c.subject", _confidence(F.col("c.n"), F.col("whole"), F.col("c.prior")).alias("confidence"), F.col("c.prior").alias("prior"), F.col("c.n").alias("n"))
    sure = durable(sure.where(F.col("n") >= SUPPORT), "confidences")
    rules = sure.where(F.col("confidence") - F.col("prior") >= GAIN * (1 - F.col("prior")))
    # Redundant: some proper subset is as sure.
    k = F.size("words")
    every = F.sequence(F.lit(1), F.pow(F.lit(2.0), k).cast("int") - 2)
    picks = F.transform(every, lambda m: F.filter("words", lambda x, j: F.floor(m / F.pow(F.lit(2.0), j)) % 2 == 1))  # the bits of m say which words
    long = rules.where(k > 1).select("words", "subject", "confidence", F.explode(picks).alias("sub"))
    worse = long.join(sure.select(F.col("words").alias("sub"), "subject", F.col("confidence").alias("held")), ["sub", "subject"]).where("held >= confidence").select("words", "subject").distinct()
    left = rules.join(worse, ["words", "subject"], "left_anti")
    return [(tuple(r.words), r.subject, log(r.confidence / r.prior)) for r in left.collect()], prior  # as many as leaning words allow


class Scorer:
    """Matches rules against statements; a rule is looked for under its rarest word."""

    def __init__(self, rules: list[tuple[tuple[str, ...], str, float]]):
        uses: dict[str, int] = defaultdict(int)
        for words, _, _ in rules:
            for w in words:
                uses[w] += 1
        self.by_word = defaultdict(list)
        for words, subject, evidence in rules:
            self.by_word[min(words, key=lambda w: (uses[w], w))].append((frozenset(words), subject, evidence))

    def statement(self, items: set[str]) -> dict[str, float]:
        """The subjects' shares of a statement: evidence adds up, shares are in its proportion as odds."""
        score: dict[str, float] = {}
        for word in items:
            for words, subject, evidence in self.by_word.get(word, ()):
                if words <= items:
                    score[subject] = score.get(subject, 0.0) + evidence
        if len(score) < 2:
            return dict.fromkeys(score, 1.0)
        top = max(score.values())
        odds = {s: exp(max(e - top, -50.0)) for s, e in score.items()}
        whole = sum(odds.values())
        return {s: o / whole for s, o in sorted(odds.items())}

    def document(self, parts: list[list[str]]) -> tuple[int, dict[str, float]]:
        """The number of statements and, per subject, the sum of its shares of them."""
        votes: dict[str, float] = {}
        for items in parts:
            for s, share in self.statement(set(items)).items():
                votes[s] = votes.get(s, 0.0) + share
        return len(parts), votes


def score(documents: DataFrame, rules: list, key: str = "doc_id") -> DataFrame:
    """``key, subject, n, telling, statements`` of ``key, parts``: for every document and subject its statements speak for."""
    given = documents.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(given.value)
        for batch in batches:
            rows = []
            for i, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, votes = scorer.document(parts)
                telling = sum(votes.values())
                rows += [(i, s, n, telling, size) for s, n in votes.items()]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=[key, "subject", "n", "telling", "statements"]
            )

    return documents.select(key, "parts").mapInArrow(run, f"{key} bigint, subject string, n double, telling double, statements double")


def succeed(rules: list, better: list) -> list:
    """The rules of a later fit, and the earlier ones of subjects it has none for."""
    told = {subject for _, subject, _ in better}
    return better + [r for r in rules if r[1] not in told]


def about(scored: DataFrame) -> DataFrame:
    """The subjects a document is about."""
    passing = (F.col("n") < ENOUGH) & (F.col("n") * 2 < F.col("statements") - 0.02)
    enough = (F.col("n") >= SHARE * F.col("telling") - 0.01) & (F.col("n") >= OF_ALL * F.col("statements") - 0.01) & ~passing
    return scored.where(enough).select("doc_id", "subject")


def subjects(documents: DataFrame, doc_labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """``doc_id, subject``: every subject each document is about."""
    labels = doc_labels.join(F.broadcast(subject_list.select("subject").distinct()), "subject").select("doc_id", "subject").distinct()
    # Texts are small in bytes and heavy in Python: they are spread over all tasks.
    spread = width(documents.sparkSession)
    texts = durable(parsed(documents.where("text is not null").select("doc_id", "text").repartition(spread)), "parsed")
    rules, _ = mine(durable(transactions(texts.join(labels, "doc_id")), "labelled"))
    for _ in range(ROUNDS):
        scored = score(texts, rules)
        sure = scored.where((F.col("n") >= SURE * F.col("telling")) & (F.col("n") >= SURE_STATEMENTS - 0.5)).select("doc_id", "subject")
        better, _ = mine(durable(transactions(texts.join(labels.unionByName(sure).distinct(), "doc_id")), "sure"))
        rules = succeed(rules, better)
    return about(score(texts, rules))
