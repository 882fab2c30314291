"""Character statistics of all texts, in two tables of fixed size."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

PAIR_BITS, SINGLE_BITS, WORD_BITS = 20, 16, 18
_WORD = re.compile("[A-Za-z]+")
_FLOOR = 1e-9


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _pair_place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _single_place(codes: np.ndarray) -> np.ndarray:
    return (codes & np.uint32((1 << SINGLE_BITS) - 1)).astype(np.int64)


class Language:
    """Probability of a character after another; counts of all digits are shared among the digits."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, words: np.ndarray, joints: dict[str, np.ndarray] | None = None, followers: np.ndarray | None = None):
        self.pairs, self.singles, self.words, self.joints, self.followers = pairs, singles, words, joints or {}, followers
        self.total = max(1.0, float(singles.sum()))

    def rare(self, share: float) -> float:
        """The log probability under which the rarest pairs lie that make up this share of all text."""
        order = np.sort(self.pairs)
        upto = np.cumsum(order)
        n = order[min(len(order) - 1, int(np.searchsorted(upto, share * upto[-1])))]
        return float(np.log(n / self.total + _FLOOR))

    def log_pair(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of two neighbours among all neighbours, so that what always follows a rare character stays rare."""
        together = self.pairs[_pair_place(first, second)] / self.total
        apart = self.singles[_single_place(first)] * self.singles[_single_place(second)] / self.total**2
        return np.log(0.95 * together + 0.05 * apart + _FLOOR).astype(np.float32)

    def log_pairs(self, text: str) -> np.ndarray:
        """Of each character with the one before it, the first with a line break."""
        codes = same_digits(codes_of(text))
        return self.log_pair(np.concatenate((np.array([10], dtype=np.uint32), codes[:-1])), codes)


@cache
def ends_of(encoding: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each character of the basic plane that takes two or three bytes; 0 for the others."""
    first, last = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        raw = chr(code).encode(encoding, "ignore")
        if 2 <= len(raw) <= 3:
            first[code], last[code] = raw[0], raw[-1]
    return first, last


def same_digits(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)


def word_place(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS)


def follower_place(before: str, word: str) -> int:
    return crc32(f"{before} {word}".encode("utf-8", "surrogatepass")) >> (32 - PAIR_BITS)


def learn(texts: DataFrame, column: str = "text", words: bool = False, changed: Callable[[str], str] | None = None, encodings: tuple[str, ...] = ()) -> Language:
    """Counts over every row; the driver gets no more rows than the tables have places, whatever the input.

    With ``words`` two more tables count the words of ASCII letters and which follows which; ``changed`` gives what is counted of a text. For each
    of the encodings a table counts which byte begins a character after which byte ended the one before.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, singles = np.zeros(1 << PAIR_BITS, dtype=np.int64), np.zeros(1 << SINGLE_BITS, dtype=np.int64)
        joints = [np.zeros(1 << 16, dtype=np.int64) for _ in encodings]
        seen: Counter[str] = Counter()
        following: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            values = batch[column].tolist()
            if changed:
                values = [changed(v) for v in values]
            for start in range(0, len(values), 500):
                codes = same_digits(codes_of("\n" + "\n".join(values[start : start + 500])))
                pairs += np.bincount(_pair_place(codes[:-1], codes[1:]), minlength=len(pairs))
                singles += np.bincount(_single_place(codes), minlength=len(singles))
                plane = np.where(codes < 1 << 16, codes, 0)
                for encoding, joint in zip(encodings, joints, strict=True):
                    first, last = ends_of(encoding)
                    before, after = last[plane[:-1]], first[plane[1:]]
                    both = (before > 0) & (after > 0)
                    joint += np.bincount(before[both] * 256 + after[both], minlength=len(joint))
                if words:
                    found = _WORD.findall("\n".join(values[start : start + 500]))
                    seen.update(found)
                    following.update(zip(found, found[1:]))
        spelled = np.zeros(1 << WORD_BITS, dtype=np.int64)
        for word, n in seen.items():
            spelled[word_place(word)] += n
        next_to = np.zeros(1 << PAIR_BITS, dtype=np.int64)
        for (before, word), n in following.items():
            next_to[follower_place(before, word)] += n
        for kind, table in enumerate([pairs, singles, spelled, next_to, *joints]):
            place = np.flatnonzero(table)
            yield pd.DataFrame({"kind": np.full(len(place), kind, dtype=np.int32), "place": place, "n": table[place]})

    rows = spread(texts.select(column).where(F.length(column) >= 1), column).mapInPandas(count, "kind int, place long, n long")
    got = rows.groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (np.asarray(got[c]) for c in ("kind", "place", "n"))
    pairs, singles = np.zeros(1 << PAIR_BITS, dtype=np.float32), np.zeros(1 << SINGLE_BITS, dtype=np.float32)
    pairs[place[kind == 0]], singles[place[kind == 1]] = n[kind == 0], n[kind == 1]
    spelled = np.zeros(1 << WORD_BITS, dtype=np.float32)
    spelled[place[kind == 2]] = n[kind == 2]
    followers = np.zeros(1 << PAIR_BITS, dtype=np.float32)
    followers[place[kind == 3]] = n[kind == 3]
    between = {}
    for no, encoding in enumerate(encodings, 4):
        joint = np.zeros(1 << 16)
        joint[place[kind == no]] = n[kind == no]
        between[encoding] = joint.reshape(256, 256)
    return Language(pairs, singles, spelled, between, followers)
