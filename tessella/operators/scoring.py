"""Log-probability of each question given each other: prompts and a native scorer.

A scorer is anything that takes ``cond_ord, ord, context, text`` and gives
``cond_ord, ord, logp``.  ``external`` runs one in Arrow batches, loaded once
per Python worker.  The default needs no model: a query-likelihood language
model with Jelinek-Mercer smoothing, for which

    logp(q2 | q1) = |q2| ln(1 - L) + sum tf ln p(w) + sum over shared w of tf ln(1 + L p(w|q1) / ((1 - L) p(w)))

so each block of pairs is one matrix product over the words that many of its
questions have, and a few sums for each of the others.
It has the contract of a language model's score, not its values.  Next words
(``next_logits``, ``next_tokens``), text vectors (``encode``) and concepts
(``key_phrase``) come from the same counts; the ``external_...`` forms take a
model from outside, by name (``module:function``) from the command line.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import questions as q
from ..joins import broadcast_if_small, lookup
from ..session import durable
from . import pairs

MIX = 0.5
#: A word goes into the matrix product if more than this share of a cell's pairs have it.
DENSE = 0.001
TOKEN = r"[\p{L}\p{N}]+"


def views(questions: DataFrame) -> DataFrame:
    """``ord`` and the texts prompts are made of."""
    return questions.select("ord", q.header(1).alias("header1"), q.header(2).alias("header2"), q.rendered().alias("text"))


def prompts(questions: DataFrame, n: int) -> DataFrame:
    """``cond_ord, ord, context, context_len, text``: first the marginals (null ``cond_ord``), then every ordered pair.

    ``context_len`` is summed up of the lengths of either side, so nobody has to
    put a context together for its length alone.
    """
    v = views(questions)
    before, after = F.concat("header1", F.lit("\n"), "text", F.lit("\n\n")), F.concat("header2", F.lit("\n"))
    size = lambda part: F.length(part).cast("bigint")
    alone = v.select(F.lit(None).cast("bigint").alias("cond_ord"), "ord", after.alias("context"), size(after).alias("context_len"), "text")
    both = pairs.all_pairs(
        v,
        n,
        {"cond_ord": F.col("ord"), "before": before, "before_len": size(before)},
        {"ord": F.col("ord"), "after": after, "after_len": size(after), "text": F.col("text")},
    )
    return alone.unionByName(both.select("cond_ord", "ord", F.concat("before", "after").alias("context"), (F.col("before_len") + F.col("after_len")).alias("context_len"), "text"))


def external(prompts: DataFrame, load: Callable[[], Callable[[list[str], list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """Score prompts by a model that ``load`` gives: ``score(contexts, texts) -> log-probs``."""
    if batch < 1:
        raise ValueError("batch must be 1 or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for f in frames:
            f = f.iloc[f["text"].str.len().argsort(kind="stable")]  # like lengths together
            parts = [np.asarray(score(f["context"].iloc[i : i + batch].tolist(), f["text"].iloc[i : i + batch].tolist()), np.float64) for i in range(0, len(f), batch)]
            yield pd.DataFrame({"cond_ord": f["cond_ord"].astype("Int64"), "ord": f["ord"], "logp": np.concatenate(parts) if parts else np.empty(0)})

    return prompts.select("cond_ord", "ord", "context", "text").mapInPandas(run, "cond_ord bigint, ord bigint, logp double")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def bags(texts: DataFrame) -> DataFrame:
    """``ord, len, w, tf`` of ``ord, text``: the words of a text and how often it has each, as lists; no row without words, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("ws")), 0).to_numpy()
            words = batch.column("ws").flatten().dictionary_encode()
            many = max(1, len(words.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(size), dtype=np.int64), size) * many + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            own, code = np.divmod(key, many)
            has = np.flatnonzero(size)
            start = pa.array(np.append(0, np.cumsum(np.bincount(own, minlength=len(size))[has])), pa.int32())
            lists = (pa.ListArray.from_arrays(start, x) for x in (words.dictionary.take(pa.array(code)), pa.array(tf, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("ord").take(pa.array(has)), pa.array(size[has], pa.int64()), *lists], names=["ord", "len", "w", "tf"])

    return texts.select(F.col("ord").cast("bigint").alias("ord"), tokens(F.col("text")).alias("ws")).mapInArrow(run, "ord bigint, len bigint, w array<string>, tf array<bigint>")


def counts(texts: DataFrame) -> DataFrame:
    """``ord, w, tf, len, cf, df, total`` of ``ord, text``; a text without words gives no row.

    Words are counted where their text is read and stored as a row per text. A
    word that very many texts have is dealt out over tasks (``joins.lookup``)
    where words are too many to be broadcast.
    """
    held = durable(bags(texts), "bags")
    tf = held.select("ord", "len", F.explode(F.arrays_zip("w", "tf")).alias("x")).select("ord", "x.w", "x.tf", "len")
    per_word = durable(tf.groupBy("w").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")), "words")
    total = per_word.agg(F.sum("cf").alias("total"))
    size = per_word.agg(F.sum(F.length("w") + 48)).first()[0] or 0
    known = broadcast_if_small(per_word, size)
    joined = tf.join(known, "w") if known is not per_word else lookup(tf, per_word, ["w"], "ord", rows="df")
    out = joined.join(F.broadcast(total))  # total is one row
    out.__dict__["in_runs"] = known is not per_word  # rows of a text follow each other, as they are made in one task and only meet what is broadcast
    return out


def marginals(texts: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``ord, logp`` under the background model; 0 for a text without words."""
    counted = counts(texts) if counted is None else counted
    found = counted.groupBy("ord").agg(F.sum(F.col("tf") * F.log(F.col("cf") / F.col("total"))).alias("logp"))
    return texts.select("ord").join(found, "ord", "left").select("ord", F.coalesce("logp", F.lit(0.0)).alias("logp"))


PROFILE = "ord bigint, logp double, len double, w array<bigint>, tf array<int>, cf array<bigint>, total bigint"


def gathered(counted: DataFrame) -> DataFrame:
    """``PROFILE`` of the rows of ``counts``: those of one text as lists, without a shuffle where they follow each other."""
    rows = counted.select(F.col("ord").cast("bigint").alias("ord"), "len", F.xxhash64("w").alias("w"), F.col("tf").cast("int").alias("tf"), "cf", "total")
    if not counted.__dict__.get("in_runs"):
        rows = rows.repartition("ord").sortWithinPartitions("ord")

    def whole(t: pa.Table, start: np.ndarray) -> pa.RecordBatch:
        x = {c: t[c].combine_chunks() for c in ("w", "tf", "cf")}
        at, (own, size, total, tf, cf) = pa.array(np.append(start, t.num_rows), pa.int32()), (t[c].to_numpy() for c in ("ord", "len", "total", "tf", "cf"))
        logp = np.add.reduceat(tf * np.log(cf / total), start)
        return pa.RecordBatch.from_arrays([pa.array(own[start]), pa.array(logp), pa.array(size[start].astype(np.float64)), *(pa.ListArray.from_arrays(at, c) for c in x.values()), pa.array(total[start])], names=["ord", "logp", "len", "w", "tf", "cf", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            o = t["ord"].to_numpy()
            start = np.append(0, np.flatnonzero(o[1:] != o[:-1]) + 1)
            if len(start) > 1:
                yield whole(t.slice(0, start[-1]), start[:-1])
            rest = t.slice(start[-1])
        if rest is not None and rest.num_rows:
            yield whole(rest, np.array([0]))

    return rows.mapInArrow(run, PROFILE)


def profiles(texts: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``PROFILE`` of ``ord, text``: all that a score takes of either question."""
    c = counts(texts) if counted is None else counted
    none = texts.where(F.coalesce(F.size(tokens(F.col("text"))), F.lit(0)) <= 0)
    nothing = none.select(F.col("ord").cast("bigint").alias("ord"), F.lit(0.0).alias("logp"), F.lit(0.0).alias("len"), *(F.lit(None).cast(f"array<{kind}>").alias(k) for k, kind in (("w", "bigint"), ("tf", "int"), ("cf", "bigint"))), F.lit(1).cast("bigint").alias("total"))
    return durable(gathered(c).unionByName(nothing), "profiles")


def opening(block: dict, mix: float = MIX) -> dict:
    """A block of ``profiles`` for ``matrix``: its words in order, who has them, and what a word of one question adds to the score of others."""
    lists = {k: block[k] for k in ("w", "tf", "cf")}
    sizes = pc.fill_null(pc.list_value_length(lists["w"]), 0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    flat = {k: v.flatten().to_numpy(zero_copy_only=False) for k, v in lists.items()}
    flat["tf"] = flat["tf"].astype(np.float64)
    flat["gain"] = np.log(1 + mix * (flat["tf"] / block["len"][row]) / ((1 - mix) * flat["cf"] / block["total"][row]))
    order = np.argsort(flat["w"], kind="stable")
    words, start = np.unique(flat["w"][order], return_index=True)
    return {k: v for k, v in block.items() if k not in lists} | {"row": row[order], "tf": flat["tf"][order], "gain": flat["gain"][order], "words": words, "start": np.append(start, len(order))}


def matrix(a: dict, b: dict, mix: float = MIX) -> np.ndarray:
    """The log-probability of every question of ``b`` (columns) given every one of ``a`` (rows)."""
    out = np.zeros((len(a["ord"]), len(b["ord"])))
    _, at, bt = np.intersect1d(a["words"], b["words"], assume_unique=True, return_indices=True)
    pairs_of = np.diff(a["start"])[at] * np.diff(b["start"])[bt]
    common = pairs_of > DENSE * out.size  # a column of a matrix product costs less than their pairs one by one
    if common.any():

        def dense(side: dict, which: np.ndarray, column: str) -> np.ndarray:
            m = np.zeros((len(side["ord"]), len(which)))
            for j, x in enumerate(which):
                span = slice(side["start"][x], side["start"][x + 1])
                np.add.at(m[:, j], side["row"][span], side[column][span])
            return m

        out += dense(a, at[common], "gain") @ dense(b, bt[common], "tf").T
    flat, rare = out.ravel(), np.flatnonzero(~common)
    part = np.cumsum(pairs_of[rare]) // pairs.SLICE  # about so many pairs at a time
    for some in np.split(rare, np.flatnonzero(np.diff(part)) + 1):
        count = pairs_of[some]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)  # of a pair among those of its word
        x, y = np.divmod(place, np.repeat(np.diff(b["start"])[bt[some]], count))
        x += np.repeat(a["start"][at[some]], count)
        y += np.repeat(b["start"][bt[some]], count)
        np.add.at(flat, a["row"][x] * len(b["ord"]) + b["row"][y], a["gain"][x] * b["tf"][y])
    out += b["logp"] + b["len"] * np.log(1 - mix)
    return out


def query_likelihood(texts: DataFrame, n: int, mix: float = MIX, digits: int | None = None, then: tuple[Callable[[Iterator], Iterator], str] | None = None) -> DataFrame:
    """``cond_ord, ord, logp`` of all n marginals and n x n ordered pairs of ``ord, text``; ``digits`` rounds.

    ``then`` is what is made of the batches of these rows where they arise, and
    the form of that; so pairs that are only summed up never leave their cell.
    """
    rows, form = profiles(texts), "cond_ord bigint, ord bigint, logp double"

    def kernel(a: dict, b: dict):
        batches = pairs.rows_of(["cond_ord", "ord", "logp"], a["ord"], b["ord"], matrix(a, b, mix), digits=(digits,))
        yield from then[0](batches) if then else batches

    both = pairs.in_cells(rows, partial(opening, mix=mix), kernel, then[1] if then else form)
    own = F.col("logp") if digits is None else F.round("logp", digits)
    alone = rows.select(F.lit(None).cast("bigint").alias("cond_ord"), "ord", own.alias("logp"))
    return (alone.mapInArrow(*then) if then else alone).unionByName(both)


def key_phrase(texts: DataFrame, verbal: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """``ord, concept``: of each text the word of the highest tf-idf; the first by name among equals.

    Stands in for a generated concept: the top one of all candidates.  With
    ``verbal`` the word comes with the one before it where it first occurs
    (what is done to it), if there is one.
    """
    docs = texts.agg(F.count(F.lit(1)).alias("docs"))
    scored = (counts(texts) if counted is None else counted).join(F.broadcast(docs)).withColumn("score", F.round(F.col("tf") * F.log(F.col("docs") / F.col("df")), 9))
    best = scored.groupBy("ord").agg(F.min_by("w", F.struct(-F.col("score"), F.col("w"))).alias("concept"))
    if not verbal:
        return texts.select("ord").join(best, "ord", "left").select("ord", F.coalesce("concept", F.lit("")).alias("concept"))
    words = texts.select("ord", tokens(F.col("text")).alias("ws")).join(best, "ord", "left").withColumn("at", F.array_position("ws", F.col("concept")))
    both = F.when(F.col("at") > 1, F.concat(F.element_at("ws", F.col("at").cast("int") - 1), F.lit(" "), "concept")).otherwise(F.col("concept"))
    return words.select("ord", F.coalesce(both, F.lit("")).alias("concept"))


def hashed_embedding(texts: DataFrame, dim: int = 64) -> DataFrame:
    """``ord, embedding``: tf-idf folded into ``dim`` signed buckets."""
    docs = texts.agg(F.count(F.lit(1)).alias("docs"))
    h = F.xxhash64("w")
    weight = F.col("tf") * F.log((1 + F.col("docs")) / F.col("df")) * F.when(F.shiftrightunsigned(h, 63) == 1, -1.0).otherwise(1.0)
    slots = counts(texts).join(F.broadcast(docs)).groupBy("ord", F.pmod(h, F.lit(dim)).cast("int").alias("b")).agg(F.sum(weight).alias("v"))
    return texts.select("ord").join(_packed(slots, dim), "ord", "left").select("ord", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


def _packed(slots: DataFrame, dim: int) -> DataFrame:
    """``ord, embedding`` of ``ord, b, v``: at most ``dim`` rows of an ``ord`` are gathered."""
    packed = slots.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("b", "v"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return packed.select("ord", vector.alias("embedding"))


# ------------------------------------------------- what a model does besides scores
def encode(prompts: DataFrame, dim: int = 64) -> DataFrame:
    """``ord, embedding`` of ``ord, context, text``: the mean of the text's token vectors; the context has no part in it.

    A token's vector is a signed unit vector by a hash of its spelling (md5, so
    that any engine can follow it): slot from its first eight hex digits, sign
    from the ninth.  A text without words gives zeros.
    """
    each = prompts.select("ord", tokens(F.col("text")).alias("ws")).select("ord", F.size("ws").alias("n"), F.explode("ws").alias("w"))
    digest = F.md5("w")
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 1, -1.0).otherwise(1.0)
    slots = each.groupBy("ord", slot.alias("b")).agg(F.sum(sign / F.col("n")).alias("v"))
    return prompts.select("ord").join(_packed(slots, dim), "ord", "left").select("ord", F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("embedding"))


def next_logits(prompts: DataFrame, background: DataFrame, choices: DataFrame, mix: float = MIX) -> DataFrame:
    """``ord, w, logp``: the log-probability that a word follows each prompt of ``ord, context``, for the words of ``choices``.

    ``choices`` has ``w`` (the same allowed words for every prompt, a table that
    is broadcast) or ``ord, w`` (words of its own for each).  ``background`` has
    ``w, cf``.  A word the background doesn't know has no probability and no row.
    """
    total = background.agg(F.sum("cf").alias("total"))
    allowed = choices.select(*[c for c in ("ord", "w") if c in choices.columns]).distinct().join(background.select("w", "cf"), "w")
    words = prompts.select("ord", tokens(F.col("context")).alias("ws")).select("ord", F.size("ws").alias("n"), F.explode_outer("ws").alias("c"))
    own = words.where("c is not null").groupBy("ord", F.col("c").alias("w")).agg((F.count(F.lit(1)) / F.first("n")).alias("share"))
    asked = prompts.select("ord").join(allowed, "ord") if "ord" in choices.columns else prompts.select("ord").join(F.broadcast(allowed))  # the words allowed, as given by the caller
    p = mix * F.coalesce("share", F.lit(0.0)) + (1 - mix) * F.col("cf") / F.col("total")
    return asked.join(own, ["ord", "w"], "left").join(F.broadcast(total)).select("ord", "w", F.log(p).alias("logp"))


def next_tokens(prompts: DataFrame, background: DataFrame, choices: DataFrame | None = None, top_k: int = 1, mix: float = MIX) -> DataFrame:
    """``ord, rank, w, logp``: the ``top_k`` words most likely to follow each prompt; the first by name among equals.

    Without ``choices`` every word may follow.  A word the prompt has not can
    only be among the first if it is among the ``top_k`` most frequent of such
    words, so each prompt looks at its own words and a prefix of one list: no
    prompt meets the whole vocabulary.
    """
    if choices is None:
        words = prompts.select("ord", F.array_distinct(tokens(F.col("context"))).alias("own"))
        most = words.agg(F.max(F.size("own"))).first()[0] or 0
        ranked = background.orderBy(F.desc("cf"), "w").limit(top_k + most).select("w", "cf").collect()  # as many as a prompt has words, and top_k
        frequent = F.array(*(F.lit(r.w) for r in ranked)) if len(ranked) <= 2000 else None
        if frequent is None:
            head = prompts.sparkSession.createDataFrame([([r.w for r in ranked],)], "frequent array<string>")
            words, frequent = words.join(F.broadcast(head)), F.col("frequent")
        rest = F.slice(F.array_except(F.slice(frequent, 1, F.size("own") + top_k), "own"), 1, top_k) if ranked else F.array().cast("array<string>")
        choices = words.select("ord", F.explode(F.concat("own", rest)).alias("w"))
    scored = next_logits(prompts, background, choices, mix).withColumn("r", F.round("logp", 12))
    kept = scored.withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("r"), "w"))).where(F.col("rank") <= top_k)
    return kept.select("ord", F.col("rank").cast("bigint").alias("rank"), "w", "logp")


# ------------------------------------------------------------ models from outside
def loaded(name: str) -> Callable:
    """The function ``module:function`` names, imported where it is called."""
    module, _, function = name.partition(":")
    if not module or not function:
        raise ValueError(f"not module:function: {name}")
    return getattr(importlib.import_module(module), function)


def _in_batches(prompts: DataFrame, load: Callable[[], Callable], batch: int, column: str, kind: str) -> DataFrame:
    if batch < 1:
        raise ValueError("batch must be 1 or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            out: list = []
            for i in range(0, len(f), batch):
                out += list(model(f["context"].iloc[i : i + batch].tolist(), f["text"].iloc[i : i + batch].tolist()))
            yield pd.DataFrame({"ord": f["ord"], column: out})

    return prompts.select("ord", "context", "text").mapInPandas(run, f"ord bigint, {column} {kind}")


def external_labels(prompts: DataFrame, load: Callable[[], Callable], batch: int = 16) -> DataFrame:
    """``ord, concept`` of ``ord, context, text`` by a model that ``load`` gives: ``label(contexts, texts) -> texts``."""
    return _in_batches(prompts, load, batch, "concept", "string")


def external_vectors(prompts: DataFrame, load: Callable[[], Callable], batch: int = 16) -> DataFrame:
    """``ord, embedding`` of ``ord, context, text`` by a model that ``load`` gives: ``encode(contexts, texts) -> vectors``."""
    return _in_batches(prompts, load, batch, "embedding", "array<float>")
