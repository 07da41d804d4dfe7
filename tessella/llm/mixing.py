"""Mixing sources to target weights.

A source of weight ``w`` is to give ``w`` of all tokens.  Its documents are
first allocated whole copies: as many full passes as fit.  What is left is a
part of a pass, drawn by Pareto order sampling: every document has an inclusion
probability that grows with its tokens, gets a random number from its id, and
is ranked by the odds of that number divided by the odds of its inclusion; the
documents of smallest rank are taken, a fixed number of them.  Documents whose
probability would reach 1 get one more certain copy.

The cut between taken and not taken is found by counting ranks in histograms of
fixed size, refined around the cut, so no source is ever sorted in one task.

Defined results: sources are compared without case and outer blanks; documents
without a source belong to none; a source without documents, or whose documents
at ``max_repeats`` fall short, gives all it has and is reported; documents
without tokens weigh nothing and are never drawn in part; a null weight is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tokens import count_tokens

BLANKS = " \t\n\r\f\v\u00a0"
SEED = 42
BINS = 4096
ROUNDS = 4  # of 12 bits each; ranks have 48


def source_name(source: Column) -> Column:
    """Without case and outer blanks; null if nothing is left."""
    name = F.lower(F.btrim(source, F.lit(BLANKS)))
    return F.when(name != "", name)


def sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, tokens`` of the documents that have a source, written once."""
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where("source is not null")
    return durable(count_tokens(named, ["doc_id", "source"], path), "sizes")


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets`` what it has and what it owes: a row each.

    ``whole`` is the number of certain copies of every document and ``rest``
    the tokens owed beyond them.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    wanted = targets.select(
        source_name(F.col("source")).alias("source"),
        F.col("source").alias("source_as_given"),
        F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    owed = F.col("target_weight") * F.col("total")
    fits = F.when(F.col("have") > 0, F.least(F.floor(owed / F.col("have")), F.col("max_repeats"))).otherwise(0).cast("bigint")
    return (
        wanted.join(have, "source", "left")
        .crossJoin(F.broadcast(total))  # one row
        .fillna(0, ["have", "docs"])
        .withColumn("owed", owed)
        .withColumn("short", F.col("have") * F.col("max_repeats") < owed)
        .withColumn("whole", fits)
        .withColumn("rest", F.when(F.col("whole") < F.col("max_repeats"), F.greatest(owed - F.col("whole") * F.col("have"), F.lit(0.0))).otherwise(0.0))
    )


def _uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone, so a task that runs again draws the same."""
    return (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(SEED)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document that is used at least once."""
    spark = sized.sparkSession
    rows = plan(sized, targets).collect()  # a row per source of the target table
    # Inclusion is c * tokens, or 1; c solves  sum(tokens * min(1, c * tokens)) = rest.
    # A histogram of sizes (classes of 2 %) stands in for the documents while c is sought.
    kind = F.floor(F.log(F.col("tokens").cast("double")) / F.log(F.lit(1.02))).cast("int")
    by_size = (
        sized.where("tokens > 0")
        .groupBy("source", kind.alias("kind"))
        .agg(F.sum("tokens").alias("x"), F.sum(F.col("tokens") * F.col("tokens").cast("double")).alias("xx"), F.max("tokens").alias("most"))
        .collect()  # at most 2,000 classes a source
    )
    factors = []
    for r in rows:
        classes = [(b.x, b.xx, b.most) for b in by_size if b.source == r.source]
        if r.rest <= 0 or not classes:
            factors.append((r.source, r.whole, 0.0))
            continue
        lo, hi = 0.0, 1.0
        for _ in range(200):
            c = (lo + hi) / 2
            given = sum(x if c * most >= 1 else c * xx for x, xx, most in classes)
            lo, hi = (c, hi) if given < r.rest else (lo, c)
        factors.append((r.source, r.whole, hi))
    given = F.broadcast(spark.createDataFrame(factors, "source string, whole bigint, c double"))  # a row per source
    odds = lambda p: p / (1 - p)
    # The rank is squeezed to (0, 1) and cut to 48 bits: order stays.
    rank = odds(_uniform(F.col("doc_id"))) / odds(F.col("p"))
    drawn = (
        sized.join(given, "source")
        .withColumn("p", F.col("c") * F.col("tokens"))
        .withColumn("part", (F.col("p") > 0) & (F.col("p") < 1))
        .withColumn("rank", F.when(F.col("part"), F.floor(rank / (1 + rank) * F.lit(float(1 << 48))).cast("bigint")))
    )
    drawn = durable(drawn.withColumn("copies", F.col("whole") + F.when(F.col("p") >= 1, 1).otherwise(0)).select("doc_id", "source", "tokens", "copies", "p", "rank"), "drawn")
    sampled = drawn.where("rank is not null")
    need = {r.source: round(r.n) for r in sampled.groupBy("source").agg(F.sum("p").alias("n")).collect()}
    # Find, per source, the rank of its last document taken: radix by radix.
    base = dict.fromkeys(need, 0)
    left = dict(need)
    for level in range(ROUNDS):
        shift = 48 - 12 * (level + 1)
        open_ = [s for s in need if left[s] > 0]
        if not open_:
            break
        at = F.broadcast(spark.createDataFrame([(s, base[s]) for s in open_], "source string, base bigint"))
        seen = (
            sampled.join(at, "source")
            .where(F.shiftright("rank", shift + 12) == F.col("base"))
            .groupBy("source", F.shiftright("rank", shift).alias("bin"))
            .count()
            .collect()  # at most BINS a source
        )
        for s in open_:
            for b, n in sorted((r.bin, r["count"]) for r in seen if r.source == s):
                base[s] = b
                if n >= left[s]:
                    break
                left[s] -= n
    cut = F.broadcast(spark.createDataFrame([(s, base[s] if need[s] > 0 else -1) for s in need], "source string, cut bigint"))
    taken = drawn.join(cut, "source", "left").withColumn("copies", F.col("copies") + F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0))
    return taken.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def unreachable(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """The sources of ``targets`` that cannot reach their share, as the drawn mixture shows.

    A source falls short if the mixture uses every token it has as often as it
    may and is still owed some.
    """
    sized = sizes(documents, path)
    used = mix(sized, targets).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    reached = plan(sized, targets).join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    exhausted = F.col("used") >= F.col("have") * F.col("max_repeats")
    return reached.where(exhausted & (F.col("used") < F.col("owed"))).select(F.col("source_as_given").alias("source"))


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of ``targets``: its target, what it has, what is used and the share reached."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most_repeats"))
    whole = F.broadcast(used.agg(F.sum("used").alias("mixed_total")))  # one row
    return (
        plan(sized, targets)
        .join(used, "source", "left")
        .crossJoin(whole)
        .select(
            F.col("source_as_given").alias("source"),
            "target_weight",
            "max_repeats",
            "have",
            F.coalesce("used", F.lit(0)).alias("used"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            (F.coalesce("used", F.lit(0)) / F.col("mixed_total")).alias("share"),
            (F.coalesce("used", F.lit(0)) / F.col("total")).alias("share_of_corpus"),
            "short",
        )
    )
