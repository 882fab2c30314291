"""What is misread as what in a corpus: the channel's probabilities, learnt from the corpus alone.

A place is odd where a character is unlikely beside both neighbours; a word is odd where it is rare. Every reading that
would be much likelier is a candidate. Expectation-maximization over all odd places tells misreadings, which come
again and again as the same pair, from rare text, whose candidates are scattered: each round weighs a place's
candidates by the pairs' probabilities and counts the pairs anew by these weights.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.encodings import without_suspects
from quillspark.llm.language import Language, codes_of, same_digits
from quillspark.session import cut_lineage, spread

#: Usual misreadings, which count as if each had been seen once; the corpus decides.
USUAL = {"的": "旳", "了": "孑", "天": "夭", "白": "自", "口": "囗", "水": "永", "石": "右", "人": "入", "日": "曰", "一": "—", "问": "间", "风": "凤", "心": "必", "。": "o", "，": "‚", "己": "已", "大": "犬", "土": "士", "未": "末", "刀": "力", "千": "干", "木": "本"}
USUAL_LETTERS = {"m": ("rn", "ni"), "rn": ("m",), "d": ("cl", "c1"), "h": ("b", "li"), "w": ("vv",), "l": ("1", "I"), "o": ("0",), "O": ("0",), "e": ("c",), "c": ("e",), "n": ("u",), "u": ("n",), "I": ("l", "1"), "S": ("5",), "B": ("8",), "rm": ("tm",), "i": ("1",)}
#: A place is odd if its two pairs are as rare as the rarest of this share of all text; nats that a candidate has to gain.
ODD_SHARE, LEAST_GAIN, NEAR_BEST, ROUNDS = 0.02, 6.0, 6.0, 4
#: Probability of a misreading before anything is seen, times a pair has to be expected, different neighbours it has to have on either side, and the least count of a character that something is read for.
FIRST, LEAST_SEEN, LEAST_BESIDE, LEAST_KNOWN = 1e-3, 4.0, 3, 20
#: A misreading that is rarer can't be told from rare text, nor one that has a smaller share in what its sign is taken for.
LEAST_SHARE = 0.15
LEAST_PROBABILITY, LEAST_LETTERS = 2e-4, 2e-5
#: How much more frequent the right word has to be, how often it has to occur, and nats by which a word is rarer than its one occurrence says.
TIMES, LEAST_WORD, UNSEEN = 20, 20, 5.0
_STOPS = "，。"
#: Signs that Chinese text has itself, and stray marks.
_OWN_SIGNS = set("“”‘’…·《》（）()【】、；：？！,.;:?!\"'-~`^|¦□■")
CANDIDATES = "place string, before string, after string, wrong string, right string, gain double, n long, total double"


def is_han(codes: np.ndarray) -> np.ndarray:
    return (codes >= 0x3400) & (codes <= 0x9FFF)


def _may_be_misread(code: int) -> bool:
    """Ideographs and signs that aren't another form of a sign, which is no misreading."""
    char = chr(code)
    if 0x3400 <= code <= 0x9FFF or char == "—":
        return True
    category = unicodedata.category(char)
    return char not in _OWN_SIGNS and category != "Pd" and (category[0] == "P" or code < 128 and char.isalnum()) and unicodedata.normalize("NFKC", char) == char


_MAY = np.array([not 0xD800 <= c < 0xE000 and _may_be_misread(c) for c in range(1 << 16)])


def odd_places(texts: DataFrame, shared) -> DataFrame:
    """before, own, after (code points) and n of what is unlikely on both sides."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = shared.value
        limit = 2 * language.rare(ODD_SHARE)
        for batch in batches:
            codes = same_digits(codes_of("\n" + "\n".join(map(without_suspects, batch["text"])) + "\n"))
            pairs = language.log_pair(codes[:-1], codes[1:])
            places = np.flatnonzero(pairs[:-1] + pairs[1:] < limit) + 1
            places = places[(codes[places] < 1 << 16) & _MAY[np.minimum(codes[places], 0xFFFF)]]
            han = is_han(codes[places])
            beside = is_han(codes[places - 1]).astype(int) + is_han(codes[places + 1])
            places = places[np.where(han, beside >= 1, is_han(codes[places - 1]))]
            found, n = np.unique(np.stack((codes[places - 1], codes[places], codes[places + 1])), axis=1, return_counts=True)
            yield pd.DataFrame({"before": found[0].astype(np.int32), "own": found[1].astype(np.int32), "after": found[2].astype(np.int32), "n": n})

    rows = spread(texts.select("text").where(F.length("text") >= 2), "text").mapInPandas(run, "before int, own int, after int, n long")
    return rows.groupBy("before", "own", "after").agg(F.sum("n").alias("n"))


def character_candidates(places: DataFrame, shared) -> DataFrame:
    """Of each odd place the characters that would be likelier there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = shared.value
        known = np.flatnonzero(language.singles >= LEAST_KNOWN).astype(np.uint32)
        letters = known[is_han(known)]
        stops = np.array([ord(c) for c in _STOPS], dtype=np.uint32)
        dash, one = ord("—"), np.array([ord("一")], dtype=np.uint32)
        for batch in batches:
            rows = []
            triples = batch[["before", "own", "after"]].to_numpy().astype(np.uint32)
            kinds = np.where(is_han(triples[:, 1]), 0, np.where(triples[:, 1] == dash, 1, 2))
            for kind, readings in enumerate((letters, one, stops)):
                of_kind = np.flatnonzero(kinds == kind)
                for first in range(0, len(of_kind) if len(readings) else 0, 500):
                    at = of_kind[first : first + 500]
                    before, own, after = triples[at].T
                    score = language.log_pair(before[:, None], readings[None, :]) + language.log_pair(readings[None, :], after[:, None])
                    gain = score - (language.log_pair(before, own) + language.log_pair(own, after))[:, None]
                    gain[own[:, None] == readings[None, :]] = -np.inf
                    keep = np.argwhere((gain >= LEAST_GAIN) & (gain >= gain.max(axis=1, keepdims=True) - NEAR_BEST))
                    for k, r in keep:
                        rows.append((" ".join(map(str, triples[at[k]])), chr(before[k]), chr(after[k]), chr(own[k]), chr(readings[r]), float(gain[k, r]), int(batch["n"].iloc[at[k]]), float(language.singles[readings[r]])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

    return places.mapInPandas(run, CANDIDATES)


def word_candidates(words: DataFrame) -> DataFrame:
    """Of each rare word the frequent words that differ in one or two neighbouring letters; words are word and n.

    Words are joined by what is left of them without one or two letters at a place.
    """
    length = F.length("word")
    holes = lambda size: F.transform(F.sequence(F.lit(1), length - size + 1), lambda i: F.struct(F.concat(F.left("word", i - 1), F.lit("|"), F.substr("word", i + size)).alias("key"), F.substr("word", i, F.lit(size)).alias("part")))
    cut = words.where(length.between(3, 64)).select("word", "n", F.explode(F.concat(holes(1), holes(2))).alias("h")).select("word", "n", "h.key", "h.part")
    cut = cut.where(F.length(F.replace(F.col("key"), F.lit("|"))) >= 1)
    right = cut.where(F.col("n") >= LEAST_WORD).select("key", F.col("part").alias("right"), F.col("n").alias("often"), F.col("word").alias("known"))
    totals = right.groupBy("right").agg(F.sum("often").cast("double").alias("total"))
    wrong = cut.select("key", F.col("part").alias("wrong"), "n", "word")
    joined = wrong.join(right, "key").where((F.col("wrong") != F.col("right")) & (F.col("often") >= TIMES * F.col("n")) & ~((F.length("wrong") == 2) & (F.length("right") == 2)))
    gained = joined.select(F.col("word").alias("place"), F.col("word").alias("before"), F.col("word").alias("after"), "wrong", "right", (F.log(F.col("often") / F.col("n")) + UNSEEN).cast("double").alias("gain"), "n")
    return gained.join(totals, "right").select("place", "before", "after", "wrong", "right", "gain", "n", "total")


def confusions(characters: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> tuple[pd.DataFrame, pd.DataFrame]:
    """wrong, right and log probability of the characters and of the letters that are misread often.

    Different places have to be many, and what stands before and after has to vary: a phrase that is repeated, or has a
    gap for a name, is no misreading. Nor is it where a sign would stand for many others about as often, as in verse.
    """
    spark = characters.sparkSession
    kind = F.when(F.col("letters"), LEAST_LETTERS).otherwise(LEAST_PROBABILITY)
    rows = cut_lineage(characters.withColumn("letters", F.lit(False)).unionByName(words.withColumn("letters", F.lit(True))).repartition("letters", "place"))
    usual = [(False, w, r) for r, w in USUAL.items()] + [(True, w, r) for r, ws in USUAL_LETTERS.items() for w in ws]
    listed = F.broadcast(spark.createDataFrame([(*u, 1.0) for u in usual], "letters boolean, wrong string, right string, prior double"))
    pair = ["letters", "wrong", "right"]
    weighed = rows.withColumn("p", F.lit(FIRST))
    for step in range(rounds):
        own = weighed.withColumn("weight", F.exp("gain") * F.col("p"))
        share = own.withColumn("share", F.col("weight") / (1 + F.sum("weight").over(Window.partitionBy("letters", "place"))))  # a place has few candidates
        beside = [F.count_distinct(F.when(F.col("share") >= 0.5, F.col(c))).alias(f"{c}s") for c in ("before", "after")] if step == rounds - 1 else []
        counted = share.groupBy(*pair).agg(F.sum("share").alias("seen"), F.sum(F.col("n") * F.col("share")).alias("times"), F.max("total").alias("total"), *beside)
        counted = counted.join(listed, pair, "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))
        counted = counted.where(F.col("seen") + F.col("prior") >= 0.5).withColumn("p", F.least((F.col("times") + F.col("prior")) / F.greatest("total", F.col("times") + F.col("prior")), F.lit(0.5)))
        if step < rounds - 1:
            weighed = rows.join(counted.select(*pair, "p"), pair)
    counted = counted.withColumn("all", F.sum("seen").over(Window.partitionBy("letters", "right")))
    often = (F.least("befores", "afters") >= LEAST_BESIDE) & (F.col("seen") >= LEAST_SEEN) & (F.col("p") >= kind) & (F.col("seen") >= LEAST_SHARE * F.col("all"))
    found = counted.where(often | (F.col("prior") > 0)).select(*pair, F.log("p").alias("p"), "seen").toPandas()  # pairs of signs only
    return found[~found["letters"]], found[found["letters"]]
