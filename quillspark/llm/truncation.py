"""Problem 9: text values that were cut off, and how often each source cuts.

Method: intact values are cut artificially to get positives; a logistic regression on hashed features of the closing
characters, the punctuation and the length against the source's limits is trained and scores every record. Limits
are found in the lengths of all rows: a length (in characters, or in bytes up to a split character) that far more
texts of a source have than the lengths around it. Only the training rows are a sample; its bound is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage

#: Rows the classifier is fitted on, at most.
TRAIN_ROWS = 12_000
HASH_BITS, THRESHOLD = 14, 0.4
#: Marks of omission and the broken ends of character references, escapes and tags.
OMISSION = r"(?:…+|\.{3,}|。{3,})\s*$"
MARKUP = r"(?:\x{fffd}+|%[0-9A-Fa-f]{0,2}(?:%[0-9A-Fa-f]{0,2})*|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|&#?[A-Za-z0-9]{0,8}|</?[A-Za-z]*[^<>]{0,60})$"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_END = "。！？!?.…”\"’』」）)】]"
_STOPS = "。！？!?…\n"
_SPIKE_ROWS, _SPIKE_TIMES, _AROUND = 5, 6.0, 25


def _measured(rows: DataFrame) -> DataFrame:
    """The end of each text without marks of omission and broken markup, and the lengths of the rest.

    Each step is a column of its own, so that none is worked out again inside the next.
    """
    col = F.col
    return (
        rows.withColumn("shown", F.rtrim("text", F.lit(_BLANKS))).withColumn("raw", F.right("shown", F.lit(160))).withColumn("end", F.regexp_replace("raw", r"(?U)\s+$", ""))
        .withColumn("omitted", col("end").rlike(OMISSION) & ~col("end").rlike(r"[。！？!?”\"]\s*" + OMISSION))
        .withColumn("plain", F.when(col("omitted"), F.regexp_replace("end", OMISSION, "")).otherwise(col("end")))
        .withColumn("broken", col("plain").rlike(MARKUP))
        .withColumn("core", F.when(col("broken"), F.regexp_replace("plain", MARKUP, "")).otherwise(F.regexp_replace("plain", r"[ \t]+$", "")))
        .withColumn("chars", F.length("shown") - F.length("raw") + F.length("core"))
        .withColumn("bytes", F.octet_length("shown") - F.octet_length("raw") + F.octet_length("core"))
        .drop("shown", "raw", "end", "plain")
    )


def length_limits(rows: DataFrame) -> DataFrame:
    """(source, unit, size, texts) of the lengths that stand out in a source, over all its rows.

    For bytes, a size counts the texts that end at it or up to three bytes before, as the cut may split a character.
    """
    sizes = rows.select("source", F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")),
        F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")),
    )).alias("m")).groupBy("source", "m.unit", "m.size").agg(F.count(F.lit(1)).alias("n"))
    reach = F.when(F.col("unit") == "bytes", 3).otherwise(0)
    near = sizes.select("source", "unit", "n", F.col("size").alias("own"), F.explode(F.sequence(F.col("size") - _AROUND, F.col("size") + _AROUND)).alias("size"))
    inside = (F.col("own") <= F.col("size")) & (F.col("own") >= F.col("size") - reach)
    around = near.groupBy("source", "unit", "size").agg(F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("texts"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("others"))
    width = 1 + F.when(F.col("unit") == "bytes", 3).otherwise(0)
    usual = F.col("others") * width / (2 * _AROUND + 1 - width)
    return around.where((F.col("texts") >= _SPIKE_ROWS) & (F.col("texts") >= _SPIKE_TIMES * F.greatest(usual, F.lit(0.25)))).select("source", "unit", "size", "texts")


def _class(char: str) -> str:
    """One sign for the kind of a character."""
    if "㐀" <= char <= "鿿":
        return "H"
    for kind, chars in ((".", "。！？!?."), (",", "，、：；,:;"), (")", "”’』」）)】]\""), ("n", "\n")):
        if char in chars:
            return kind
    if char.isspace():
        return "_"
    return "9" if char.isnumeric() else "U" if char.isupper() else "l" if char.isalpha() else "*"


def tokens(core: str, omitted: bool, broken: bool, at_limit: bool) -> list[str]:
    """What the classifier sees of a text's end: always as many tokens."""
    stop = max(core.rfind(c) for c in _STOPS)
    tail, line = core[stop + 1 :], core[core.rfind("\n") + 1 :]
    before, last = core[stop : stop + 1] if stop >= 0 else "", core[-1:]
    shape = "".join(map(_class, core[-4:]))
    kind, ended = shape[-1:], last in _END if last else False
    opened = sum(core.count(c) for c in "“「『（【(") > sum(core.count(c) for c in "”」』）】)")
    closing = tail[-8:]
    size = min(int(math.log2(1 + len(tail))), 6)
    return [
        f"last|{last}", f"shape|{shape}", f"size|{size}|{before}", f"ended|{ended}|{at_limit}", f"open|{opened}|{ended}", f"limit|{at_limit}|{kind}", f"mark|{omitted}|{broken}|{ended}",
        f"start|{tail[:2]}", f"line|{min(len(line) // 6, 8)}|{kind}|{before}", f"begin|{line[:1]}|{min(len(line) // 12, 3)}", *[f"g|{closing[k : k + 2]}" for k in range(7)],
    ]


def hashed(rows: pd.DataFrame) -> np.ndarray:
    """Places of each row's tokens in the table of weights."""
    mask = (1 << HASH_BITS) - 1
    each = zip(rows["core"], rows["omitted"], rows["broken"], rows["at_limit"], strict=True)
    return np.array([[crc32(t.encode("utf-8", "surrogatepass")) & mask for t in tokens(*row)] for row in each], dtype=np.int64).reshape(len(rows), -1)


def fit(places: np.ndarray, labels: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights and, last, the constant of a logistic regression, by gradient steps scaled to each weight."""
    weights, seen = np.zeros((1 << HASH_BITS) + 1), np.full((1 << HASH_BITS) + 1, 1e-8)
    for _ in range(rounds):
        error = _probability(weights, places) - labels
        slope = np.bincount(places.ravel(), np.repeat(error, places.shape[1]), minlength=len(weights)) / len(labels) + decay * weights
        slope[-1] = error.mean()
        seen += slope**2
        weights -= 0.3 * slope / np.sqrt(seen)
    return weights


def _probability(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[places].sum(axis=1) + weights[-1], -30, 30)))


def _prepared(documents: DataFrame) -> DataFrame:
    usable = documents.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    measured = cut_lineage(_measured(usable).select("doc_id", "source", "omitted", "broken", "core", "chars", "bytes"))
    limits = length_limits(measured)
    flat = lambda unit: limits.where(F.col("unit") == unit).select("source", F.col("size").alias(unit), F.lit(True).alias(f"at_{unit}"))
    marked = measured.join(flat("chars"), ["source", "chars"], "left").join(flat("bytes"), ["source", "bytes"], "left")
    return marked.withColumn("at_limit", F.coalesce("at_chars", "at_bytes", F.lit(False)))


def _training(marked: DataFrame, rows: int) -> DataFrame:
    """Intact rows, and the same rows cut at a place and in a way drawn from the row's hash."""
    intact = marked.where(~F.col("at_limit") & ~F.col("broken") & ~F.col("omitted"))
    drawn = intact.select("doc_id", "core", F.xxhash64("doc_id").alias("draw"))
    share = min(1.0, 1.5 * rows / max(1, intact.count()))  # so that no task sorts more than the sample needs
    chosen = drawn.where(F.pmod("draw", F.lit(1_000_003)) < int(share * 1_000_003) + 1).orderBy("draw", "doc_id").limit(rows)
    dice = lambda k, sides: F.pmod(F.xxhash64("draw", F.lit(k)), F.lit(sides))
    # Some intact texts end at a limit by chance.
    as_is = chosen.select("core", F.lit(False).alias("omitted"), F.lit(False).alias("broken"), (dice(6, 8) == 0).alias("at_limit"), F.lit(0.0).alias("label"))
    length = F.length("core")
    cut = chosen.where((length >= 30) & F.right("core", F.lit(1)).isin("。", ".", "”", '"')).where(dice(1, 2) == 0).select(
        F.left("core", (length * (40 + dice(2, 56)) / 100).cast("int")).alias("core"), (dice(3, 4) == 0).alias("omitted"), (dice(4, 6) == 0).alias("broken"), (dice(5, 2) == 0).alias("at_limit"), F.lit(1.0).alias("label"),
    ).where(~F.right("core", F.lit(1)).isin(*"。！？!?\n"))
    return as_is.unionByName(cut)


def scored(documents: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, source, at_limit and the probability that the text lacks its end, for every usable row.

    Needs doc_id, text and source. Null, empty and blank texts are no cases and have no row; a null source counts
    as one source. With no intact row to learn from the result is empty.
    """
    marked = _prepared(documents)
    training = _training(marked, train_rows).toPandas()  # bounded by train_rows
    if not (training["label"] == 1).any():
        return marked.select("doc_id", "source", "at_limit", F.lit(0.0).alias("probability")).where(F.lit(False))
    weights = fit(hashed(training), training["label"].to_numpy())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[["doc_id", "source", "at_limit"]].assign(probability=_probability(weights, hashed(batch)))

    ends = marked.select("doc_id", "source", "core", "omitted", "broken", "at_limit")
    return ends.mapInPandas(score, "doc_id long, source string, at_limit boolean, probability double")


def p9_found(spark, folder: str) -> DataFrame:
    return scored(spark.read.parquet(f"{folder}/documents.parquet")).where(F.col("probability") >= THRESHOLD).select("doc_id")


def p9_sources(spark, folder: str) -> DataFrame:
    """Rows, truncated rows and their share of each source."""
    all_rows = scored(spark.read.parquet(f"{folder}/documents.parquet"))
    cut = F.sum((F.col("probability") >= THRESHOLD).cast("long"))
    return all_rows.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), cut.alias("truncated"), (cut / F.count(F.lit(1))).alias("share"))
