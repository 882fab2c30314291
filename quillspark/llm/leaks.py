"""Problem 8: documents that show at least 40 consecutive letters and digits of a held-out passage.

Method: Wu-Manber search. All stretches of 40 characters of the passages are the patterns. A table over blocks of
eight characters says how far the search may jump; where it says nothing, the block's bucket gives the patterns that
end in it, and a direct comparison confirms. The passages go out in slices of bounded size, the documents are read
by every slice; the hidden passages of this project fill one slice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

SHARED_CHARS, BLOCK = 40, 8
#: Characters of passages that one slice holds at most; its tables take about 330 bytes a character in each worker.
SLICE_CHARS = 400_000
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def letters_and_digits(text: str) -> str:
    """Compatibility form, case folded, without anything but letters and digits."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


class Patterns:
    """Shift table and suffix buckets of all stretches of ``length`` characters of the passages."""

    def __init__(self, passages: list[tuple[int, str]], length: int = SHARED_CHARS, block: int = BLOCK):
        self.length, self.block = length, block
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, set[int]]] = {}
        for item, passage in passages:
            for start in range(len(passage) - length + 1):
                pattern = passage[start : start + length]
                self.bucket.setdefault(pattern[-block:], {}).setdefault(pattern, set()).add(item)
            # A block at position p of the passage ends a pattern if p is far enough in; before, it is so far from the first pattern's end.
            for p in range(len(passage) - block + 1 if len(passage) >= length else 0):
                key, way = passage[p : p + block], max(0, length - block - p)
                if way < self.shift.get(key, length):
                    self.shift[key] = way

    def items_in(self, text: str) -> set[int]:
        found: set[int] = set()
        at, block, length = self.length, self.block, self.length
        far, shift = length - block + 1, self.shift
        while at <= len(text):
            key = text[at - block : at]
            way = shift.get(key, far)
            if way == 0:
                hit = self.bucket[key].get(text[at - length : at])
                if hit:
                    found |= hit
                way = 1
            at += way
        return found


def _slices(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The passages in lists of bounded size; the driver reads one partition and holds one list at a time."""
    own, size = [], 0
    for item, evidence in items.where(F.length("evidence") >= 1).select("item_id", "evidence").toLocalIterator():
        passage = letters_and_digits(evidence)
        if len(passage) < SHARED_CHARS or item is None:
            continue
        if own and size + len(passage) > limit:
            yield own
            own, size = [], 0
        own.append((item, passage))
        size += len(passage)
    yield own


_tables: dict[str, Patterns] = {}


def _patterns(name: str, passages) -> Patterns:
    """The tables of a slice, made once in each worker, which holds those of one slice at a time."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = Patterns(passages.value)
    return _tables[name]


def leaked(documents: DataFrame, items: DataFrame, limit: int = SLICE_CHARS) -> DataFrame:
    """Each (doc_id, item_id) once whose texts share a stretch; needs doc_id, text and item_id, evidence.

    Null and short texts and passages under 40 letters and digits have no pair. Repeated rows give one pair.
    """

    def search(passages):
        shared, name = documents.sparkSession.sparkContext.broadcast(passages), uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            patterns = _patterns(name, shared)
            for batch in batches:
                rows = [(doc, item) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for item in patterns.items_in(letters_and_digits(text))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        return run

    texts = spread(documents.select("doc_id", "text").where(F.length("text") >= 1), "doc_id")
    parts = [texts.mapInPandas(search(s), "doc_id long, item_id long") for s in _slices(items, limit)]
    return reduce(DataFrame.unionByName, parts).distinct()


def p8_found(spark, folder: str) -> DataFrame:
    return leaked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/eval_items.parquet"))


def p8_report(spark, folder: str) -> DataFrame:
    """Items that leaked, with the number of documents that show them."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
