"""Problem 1: cut texts over the chunk limits into overlapping pieces at natural boundaries.

Method: recursive bisection. A span that is over the limit is cut at the strongest boundary near its midpoint;
halves are cut again while, with the overlap attached, they exceed a limit. The overlaps are attached last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import spread

MAX_CHARS, MAX_TOKENS, OVERLAP = 672, 480, 50
HAN_WEIGHT, WORD_WEIGHT, OTHER_WEIGHT = 0.72, 1.3, 0.35
#: No text can hold more estimated tokens a character than one-letter words between single other characters.
MOST_TOKENS_A_CHAR = (WORD_WEIGHT + OTHER_WEIGHT) / 2

_LATIN = re.compile("[A-Za-z]+")
_PARAGRAPH = re.compile(r"\n+\s*")
_SENTENCE = re.compile(r"""[。！？…；!?;]+[”’」』）】》"')]*|\.+["')”’]*(?=\s)""")
_CLAUSE = re.compile(r"[，、：,:]+[”’」』）】》]*|——+|\s+")
PIECES = "rec_id long, piece_no int, start_pos int, end_pos int, shared int, piece string, piece_chars int, piece_tokens int"


class Measure:
    """Character and token counts of any span of one text from running sums."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        han = ((codes >= 0x3400) & (codes <= 0x4DBF)) | ((codes >= 0x4E00) & (codes <= 0x9FFF)) | ((codes >= 0xF900) & (codes <= 0xFAFF))
        latin = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
        first = latin & ~np.concatenate(([False], latin[:-1]))
        run = lambda flags: np.concatenate(([0], np.cumsum(flags)))
        self.codes, self.latin, self.han, self.letters, self.words = codes, latin, run(han), run(latin), run(first)

    def tokens(self, a: int, b: int) -> int:
        if b <= a:
            return 0
        han, letters = int(self.han[b] - self.han[a]), int(self.letters[b] - self.letters[a])
        words = int(self.words[b] - self.words[a + 1]) + bool(self.latin[a])
        return int(round(han * HAN_WEIGHT + words * WORD_WEIGHT + max(0, b - a - han - letters) * OTHER_WEIGHT))


def _joined(code: int) -> bool:
    """Characters that belong to the one before them: combining marks, joiners, variation selectors, skin tones."""
    return 0x300 <= code <= 0x36F or 0x20D0 <= code <= 0x20FF or code in (0x200C, 0x200D) or 0xFE00 <= code <= 0xFE0F or 0x1F3FB <= code <= 0x1F3FF


def _cuts(text: str, measure: Measure, max_chars: int, max_tokens: int, overlap: int) -> list[int]:
    levels = [np.array([m.end() for m in rule.finditer(text)], dtype=np.int64) for rule in (_PARAGRAPH, _SENTENCE, _CLAUSE)]

    def fits(a: int, b: int) -> bool:
        whole = max(0, a - overlap)
        return b - whole <= max_chars and measure.tokens(whole, b) <= max_tokens

    def nearest(a: int, b: int) -> int:
        middle = (a + b) // 2
        for share in (0.25, 0.4):
            low, high = middle - int((b - a) * share), middle + int((b - a) * share)
            for ends in levels:
                near = ends[np.searchsorted(ends, max(low, a + 1)) : np.searchsorted(ends, min(high, b - 1), "right")]
                if near.size:
                    return int(near[np.argmin(np.abs(near - middle))])
        cut = middle
        while cut < b - 1 and (_joined(int(measure.codes[cut])) or measure.codes[cut - 1] == 0x200D):
            cut += 1
        return cut if cut < b - 1 else middle

    ends, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= 1 or fits(a, b):
            ends.append(b)
        else:
            cut = nearest(a, b)
            todo += [(cut, b), (a, cut)]
    return ends


def bisect(text: str, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, shared) of the pieces; one piece where the text is within both limits."""
    measure = Measure(text)
    if len(text) <= max_chars and measure.tokens(0, len(text)) <= max_tokens:
        return [(0, len(text), 0)]
    pieces, begin = [], 0
    for end in _cuts(text, measure, max_chars, max_tokens, overlap):
        shared = min(overlap, begin)
        pieces.append((begin - shared, end, shared))
        begin = end
    return pieces


def split_oversized(records: DataFrame, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every record whose text is over a limit; needs rec_id and text, ignores other columns.

    Null, empty and short texts give no row. A repeated rec_id gives its pieces once for each row. Both limits
    include the overlap. The texts that are short enough to be within the token limit whatever they hold are left
    in the scan (a bound that follows from the weights); all others are measured as they are stored.
    """
    least = min(max_chars, int(max_tokens / MOST_TOKENS_A_CHAR) - 2)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rec, text in zip(batch["rec_id"], batch["text"], strict=True):
                found = bisect(text, max_chars, max_tokens, overlap)
                if len(found) > 1:
                    for no, (a, b, shared) in enumerate(found, 1):
                        rows.append((rec, no, a, b, shared, text[a:b], b - a, Measure(text[a:b]).tokens(0, b - a)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    long = records.select("rec_id", "text").where(F.length("text") > least)
    return spread(long, "rec_id").mapInPandas(pieces, PIECES)


def p1_pieces(spark, folder: str) -> DataFrame:
    return split_oversized(spark.read.parquet(f"{folder}/metadata.parquet"))


def p1_found(spark, folder: str) -> DataFrame:
    return p1_pieces(spark, folder).where(F.col("piece_no") == 1).select("rec_id")


P1_FOUND_SQL = """
with m as (
  select rec_id, text, length(text) as n,
         length(regexp_replace(text, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g')) as han,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters,
         length(regexp_replace(regexp_replace(text, '[A-Za-z]+', '~W', 'g'), '[^W]', '', 'g')) as words
  from metadata where text is not null)
select rec_id from m
where n > 672 or round_even(han * 0.72 + words * 1.3 + greatest(0, n - han - letters) * 0.35, 0) > 480
"""
