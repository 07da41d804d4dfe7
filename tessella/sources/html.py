"""Multiple-choice questions in course pages.

A small tree is made of each page by the standard parser and read into one raw
row per question block, complete or not; which rows are valid questions is
decided by Column expressions, so what is rejected can be counted and seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import questions as q

#: Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = (
    "path string, pos int, id string, stem string, images array<string>, has_choices boolean, choices array<struct<value: string, text: string>>, "
    "responses array<struct<match: string, score: string>>, part_id string, skillref string"
)


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order; without recursion, pages may be deep."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, tag: str, cls: str | None = None) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag == tag and (cls is None or cls in (n.attrs.get("class") or "").split()))

    def text(self) -> str:
        """The texts below, stripped, blank ones left out, joined by a space."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node.strip())
            else:
                stack += reversed(node.children)
        return " ".join(t for t in out if t)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def blocks(html: str) -> Iterator[dict]:
    """The question blocks of a page as raw rows."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for pos, block in enumerate(tree.root.find("div", "oli-question")):
        body = next(block.find("div", "oli-body"), None)
        choices = next(block.find("div", "oli-multiple-choice"), None)
        part = next(block.find("div", "oli-part"), None)
        ref = next(part.find("skillref"), None) if part else None
        images = [c.attrs.get("src") or "" for c in body.children if isinstance(c, Node) and c.tag == "img"] if body else []
        yield {
            "pos": pos,
            "id": block.attrs.get("id"),
            "stem": "\n".join(p.text() for p in body.find("p")).strip() if body else "",
            "images": images,
            "has_choices": choices is not None,
            "choices": [{"value": c.attrs.get("value"), "text": c.text()} for c in choices.find("div")] if choices else [],
            "responses": [{"match": r.attrs.get("match"), "score": r.attrs.get("score")} for r in block.find("div", "oli-response")],
            "part_id": part.attrs.get("id") if part else None,
            "skillref": ref.attrs.get("idref") if ref else None,
        }


def raw_blocks(pages: DataFrame) -> DataFrame:
    """A raw row per question block of ``path, html``; pages of any markup pass."""
    columns = [c.split()[0] for c in RAW.replace("array<struct<value: string, text: string>>", "x").replace("array<struct<match: string, score: string>>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [{"path": p} | b for p, h in zip(f["path"], f["html"]) for b in blocks(h)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("path", "html").mapInPandas(run, RAW)


def _correct() -> Column:
    return F.filter("responses", lambda r: r["score"] != "0")


def verdict() -> Column:
    """Why a raw row is no valid question; null for a valid one."""
    texts = F.transform("choices", lambda c: names.clean_choice(c["text"]))
    values = F.split(_correct()[0]["match"], ",")
    return (
        F.when(F.coalesce("stem", F.lit("")) == "", "no stem")
        .when(~F.col("has_choices"), "no choices")
        .when(F.exists(texts, lambda t: t == ""), "blank choice")
        .when(F.exists("responses", lambda r: F.coalesce(r["score"], F.lit("")) == ""), "no score")
        .when(F.size(_correct()) != 1, "not one answer")
        .when(F.size(values) != 1, "several values")
        .when(~F.exists("choices", lambda c: F.coalesce(c["value"] == values[0], F.lit(False))), "unknown value")
    )


def questions(raw: DataFrame) -> DataFrame:
    """Valid questions with ``id, q_type, question, answer_key, images, skillref, step_name``, in page order (``path, pos``)."""
    at = F.array_position(F.transform("choices", lambda c: c["value"]), F.split(_correct()[0]["match"], ",")[0]) - 1
    choices = F.transform("choices", lambda c, i: F.struct(q.choice_letter(i).alias("label"), names.clean_choice(c["text"]).alias("text")))
    return raw.where(verdict().isNull()).select(
        "path",
        "pos",
        "id",
        F.lit(q.MULTIPLE_CHOICE).alias("q_type"),
        F.struct("stem", choices.alias("choices")).alias("question"),
        q.choice_letter(at.cast("int")).alias("answer_key"),
        F.when(F.size("images") > 0, F.transform("images", names.base_name)).alias("images"),
        F.btrim("skillref").alias("skillref"),
        F.concat_ws("_", "id", "part_id").alias("step_name"),
    )


def fold(found: DataFrame) -> DataFrame:
    """One question per rendered text: the first, with the skills and steps of all, in order.

    Exact repeats go first; ids number the questions after that and before
    folding, so they have gaps.
    """
    content = [c for c in found.columns if c not in ("path", "pos")]
    same = F.to_json(F.struct(*content))
    first = found.withColumn("_same", same).groupBy("_same").agg(F.min_by(F.struct(*found.columns), F.struct("path", "pos")).alias("x")).select("x.*")
    from ..sources.readers import with_ord

    numbered = with_ord(first.withColumn("_key", F.concat_ws("\x01", F.col("path"), F.lpad(F.col("pos").cast("string"), 9, "0"))), "_key", "n").drop("_key")
    whole = numbered.withColumn("_text", q.rendered())
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce(c, F.lit("")).alias("v")))), lambda x: x["v"])
    out = whole.groupBy("_text").agg(F.min_by(F.struct("q_type", "question", "answer_key", "images"), "n").alias("x"), F.min("n").alias("n"), ordered("skillref").alias("skillref"), ordered("step_name").alias("step_name"))
    placed = out.select("n", F.concat(F.lit("elearning-mcq-"), F.col("n").cast("string")).alias("id"), "x.*", "skillref", "step_name")
    return with_ord(placed, "n").drop("n")


__all__ = ["raw_blocks", "verdict", "questions", "fold", "blocks"]
