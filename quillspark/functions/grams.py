"""Grams of two to four ideographs as whole numbers, so that tasks count and compare them without making strings."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import BLANKS, col

#: Bits of a character, the most characters, and what is taken from a code point so that 0 stands for none.
BITS, MOST, BEFORE_FIRST = 15, 4, 0x4DFF
_ENDS = re.compile("[。！？；…]+")


def numbered_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number, first place and size of each gram in the text's runs of ideographs; numbers are in the order of strings."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.where((codes > BEFORE_FIRST) & (codes <= 0x9FFF), codes - np.uint32(BEFORE_FIRST), 0).astype(np.int64)
    numbers, places, sizes = [], [], []
    whole, inside = chars << BITS * (MOST - 1), chars > 0
    for more in range(1, MOST):
        inside = inside[:-1] & (chars[more:] > 0)
        whole = whole[:-1] | chars[more:] << BITS * (MOST - 1 - more)
        at = np.flatnonzero(inside)
        numbers.append(whole[at])
        places.append(at)
        sizes.append(np.full(len(at), more + 1, dtype=np.int8))
    return np.concatenate(numbers), np.concatenate(places), np.concatenate(sizes)


def gram_of(number: Column) -> Column:
    """The string of a number."""
    code = lambda i: F.shiftright(number, BITS * (MOST - 1 - i)).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.decode(F.unhex(F.concat(*[F.when(code(i) > 0, F.hex(code(i) + BEFORE_FIRST)).otherwise("") for i in range(MOST)])), "UTF-16BE")


def number_of(gram: Column | str) -> Column:
    """The number of a string of up to four ideographs."""
    code = lambda i: F.conv(F.hex(F.encode(F.substring(col(gram), i + 1, 1), "UTF-16BE")), 16, 10).cast("long") - BEFORE_FIRST
    parts = [F.when(F.length(gram) > i, F.shiftleft(code(i), BITS * (MOST - 1 - i))).otherwise(F.lit(0).cast("long")) for i in range(MOST)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def sentences_of(text: str) -> list[str]:
    """As cut_into_sentences."""
    return [s for s in (part.strip(BLANKS) for part in _ENDS.split(text)) if s]
