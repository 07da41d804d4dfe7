"""Encoding and decoding of a corpus with a public byte-level tokenizer.

Texts are encoded as they are stored, in Arrow batches, by the ``tokenizers``
library; special tokens' strings are ordinary text and none are added.  The
tokenizer's file is a parameter and is loaded once per Python worker.

A byte-level vocabulary spells each byte as one printable character.  Decoding
reverses that table: the bytes of all tokens are put together before they are
read as UTF-8, so characters split between tokens come back whole.

Defined results: null and empty texts have no ids; a text is never cut.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k.json"
#: Characters of texts given to the library at once, which bounds its memory.
CHUNK = 1 << 20


def tokenizer_file(name: str = NAME, folder: str | None = None) -> str:
    """The path of a tokenizer's file; ``TOKENIZER_DIR`` or ``folder`` override the usual folder."""
    folder = folder or os.environ.get("TOKENIZER_DIR", FOLDER)
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            pass
    return path


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def byte_characters() -> dict[int, str]:
    """Byte to character: printable bytes stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in out)
    return out | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    back = {c: b for b, c in byte_characters().items()}
    with open(path, encoding="utf8") as f:
        model = json.load(f)
    special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    return {i: special.get(i) or bytes(back[c] for c in t) for t, i in model["model"]["vocab"].items()} | special


def _groups(texts: list) -> Iterator[list]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > CHUNK:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def _encoded(texts: list, path: str) -> Iterator[list]:
    """Encodings of texts, in order; None for null."""
    t = _tokenizer(path)
    for group in _groups(texts):
        yield from t.encode_batch_fast([x or "" for x in group], add_special_tokens=False)


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every row."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(e.ids, np.int32) for e in _encoded(batch.column(1).to_pylist(), path)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """``keep`` columns and ``tokens``, the number of ids of every row."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(e) for e in _encoded(batch.column(batch.num_columns - 1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    kinds = dict(documents.dtypes)
    return documents.select(*keep, text).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", tokens bigint")


def offsets(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, first_byte, split``: where each token starts in the UTF-8 text and whether it ends inside a character."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            ids, starts, splits = [], [], []
            texts = batch.column(1).to_pylist()
            for t, e in zip(texts, _encoded(texts, path)):
                raw = (t or "").encode()
                sizes = np.array([len(known[i]) for i in e.ids], np.int64)
                ends = np.cumsum(sizes)
                ids.append(e.ids)
                starts.append(ends - sizes)
                inside = np.frombuffer(raw + b" ", np.uint8)[np.minimum(ends, len(raw))] & 0xC0 == 0x80
                splits.append(inside)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())), pa.array(splits, pa.list_(pa.bool_()))],
                names=[key, "ids", "first_byte", "split"],
            )

    return documents.select(key, text).mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, ids array<int>, first_byte array<bigint>, split array<boolean>")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """``key, text`` of ``key, ids``."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            texts = [b"".join(known[i] for i in ids or []).decode("utf8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {dict(encoded.dtypes)[key]}, text string")
