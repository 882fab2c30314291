"""Column helpers for text: white space, lines, tokens, runs of ideographs and n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character as Python's str.strip() sees it; valid in Java and in RE2.
WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters of WS.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def squeeze(c: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), f"{WS}+", "")


def lines(c: Column | str) -> Column:
    return F.split(col(c), "\n")


def unlines(c: Column) -> Column:
    return F.array_join(c, "\n")


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def estimate_tokens(c: Column | str) -> Column:
    """Ideographs .72, Latin words 1.3, other characters .35, rounded half to even; 0 for null and empty text."""
    text = F.coalesce(col(c), F.lit(""))
    han, letters = count_matches(text, f"[{HAN}]"), count_matches(text, "[A-Za-z]")
    words = count_matches(text, "[A-Za-z]+")
    other = F.greatest(F.lit(0), F.length(text) - han - letters)
    return F.rint(han * F.lit(0.72) + words * F.lit(1.3) + other * F.lit(0.35)).cast("long")


def han_runs(c: Column | str, least: int = 1) -> Column:
    runs = F.regexp_extract_all(col(c), F.lit(f"({HAN_RUN})"))
    return runs if least <= 1 else F.filter(runs, lambda r: F.length(r) >= least)


def grams_of(run: Column, size: int) -> Column:
    """All stretches of so many characters, in order; none in a shorter text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(run) - size + 1, F.lit(1)))
    return F.when(F.length(run) >= size, F.transform(places, lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def keyword_tokens(c: Column | str) -> Column:
    """Distinct lower-case words and runs of ideographs, with the bigrams of runs over two characters."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([\p{L}\p{N}_]+)"))
    pure = F.filter(words, lambda w: w.rlike(f"^{HAN_RUN}$") & (F.length(w) > 2))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(pure, lambda w: grams_of(w, 2)))))


def cut_into_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "[。！？；…]+"), strip), lambda s: s != "")
