"""Problem 7: token ids of whole texts by a public byte-level BPE.

Method: monoid tree reduction. An element is a stretch of text with its ids; halves are encoded on their own and
neighbours are joined by encoding a window around the seam again, grown until the ids outside it are fixed.

Why the outside is fixed: the word pattern of this tokenizer scans forward without looking back, and a run of
letters always ends where a character that is no letter follows, whatever stands before. Such a place is a word
end in every text that holds the two characters, so ids before it and after it don't depend on each other. The
window runs from the last such place left of the seam to the first right of it, both with the two characters
inside their half; it grows up to the whole halves where there is none. Joining is associative, the empty text is
its neutral element, and decoding the ids of a node gives its text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, spread

LEAF_CHARS = 2048
#: Texts over this many characters are spread over tasks as segments of this length.
SEGMENT_CHARS = 65536
#: Only letters and following characters that every version of the Unicode tables classes alike.
_LETTER_END = regex.compile(r"[A-Za-zÀ-ÖØ-öα-ωА-яא-תا-ي一-龥](?=[\s0-9.,;:!?'()\-。，、！？：；“”…—])")
_encoders: dict[str, object] = {}


def vocabulary_path(path: str | None = None) -> str:
    return path or os.environ.get("TOKENIZER_FILE") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


def encoder(path: str):
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _encoders:
        import tiktoken

        #: Fixed value: the word pattern that belongs to this vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def encode_plain(text: str, path: str) -> np.ndarray:
    return np.asarray(encoder(path).encode_ordinary(text), dtype=np.int32)


Node = tuple[str, np.ndarray]


def join(left: Node, right: Node, path: str, window: int = 64) -> Node:
    """The element of both stretches together."""
    (a, ids_a), (b, ids_b) = left, right
    if not a or not b:
        return right if not a else left
    begin = end = None
    size = window
    while begin is None or end is None:
        if begin is None:
            low = max(0, len(a) - size)
            places = [m.end() for m in _LETTER_END.finditer(a, low)]
            begin = places[-1] if places else (0 if low == 0 else None)
        if end is None:
            found = _LETTER_END.search(b, 0, min(len(b), size))
            end = found.end() if found else (len(b) if size >= len(b) else None)
        size *= 2
    drop_a = len(encode_plain(a[begin:], path))
    drop_b = len(encode_plain(b[:end], path))
    seam = encode_plain(a[begin:] + b[:end], path)
    return a + b, np.concatenate((ids_a[: len(ids_a) - drop_a], seam, ids_b[drop_b:]))


def encode_tree(text: str, path: str, leaf: int = LEAF_CHARS) -> np.ndarray:
    def node(t: str) -> Node:
        if len(t) <= leaf:
            return t, encode_plain(t, path)
        middle = len(t) // 2
        return join(node(t[:middle]), node(t[middle:]), path)

    return node(text)[1] if text else np.empty(0, dtype=np.int32)


def reduce_nodes(nodes: list[Node], path: str) -> np.ndarray:
    """Pairs of neighbours level by level, so that each text is copied once a level."""
    while len(nodes) > 1:
        nodes = [join(*nodes[k : k + 2], path) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0][1] if nodes else np.empty(0, dtype=np.int32)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode_documents(documents: DataFrame, path: str | None = None, segment: int = SEGMENT_CHARS, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids of every row; null and empty texts give an empty list, repeated rows their own row each.

    Needs doc_id and text, ignores other columns. Strings that look like special tokens are plain text. Long texts
    are cut into segments that are encoded in several tasks and joined by the same operation.
    """
    path = vocabulary_path(path)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_tree(t, path, leaf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("part").to_pylist()
            ids = _lists([encode_tree(t, path, leaf) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "no", "part")] + [ids], names=["row", "doc_id", "no", "part", "ids"])

    def together(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("no")
        nodes = [(t.as_py(), np.asarray(i.values)) for t, i in zip(group["part"], group["ids"], strict=True)]
        return pa.table({"doc_id": group["doc_id"].slice(0, 1), "ids": _lists([reduce_nodes(nodes, path)])})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                texts = [text[k : k + segment] for k in range(0, len(text), segment)]
                for first in range(0, len(texts), 64):  # a few MB at once
                    some = texts[first : first + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([doc] * len(some), pa.int64()), pa.array(range(first, first + len(some)), pa.int32()), pa.array(some, pa.string())], names=["row", "doc_id", "no", "part"])

    short = spread(rows.where(F.length("text") <= segment), "doc_id").mapInArrow(whole, "doc_id long, ids array<int>")
    # Numbered once and for all before the shuffle, so that a task that runs again doesn't number its rows otherwise.
    long = cut_lineage(rows.where(F.length("text") > segment).withColumn("row", F.monotonically_increasing_id()))
    pieces = long.select("row", "doc_id", "text").mapInArrow(cut, "row long, doc_id long, no int, part string")
    encoded = pieces.repartition("row", "no").mapInArrow(parts, "row long, doc_id long, no int, part string, ids array<int>")
    return short.unionByName(encoded.groupBy("row").applyInArrow(together, "doc_id long, ids array<int>"))


def p7_ids(spark, folder: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{folder}/documents.parquet"))
