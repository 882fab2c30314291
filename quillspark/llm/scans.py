"""Problem 5: marks of scanned pages in texts, and their repair into continuous paragraphs.

Method: a noisy channel. What is misread as what, and how often, is learnt from the corpus (channel.py): characters by
expectation-maximization over places that are unlikely on both sides, letters over rare words that a small change
makes frequent ones. A line is decoded by Viterbi over its characters and over its words: each may stand for what it
is misread for, at the cost of the misreading's probability, and the best sequence by the corpus's character pairs and
word pairs counts. A place with one reading only parts the sequence, so that only what lies between is searched.
Line breaks are candidates too: a break is repaired where the line was full and the corpus likes the two characters
better together. Headings and page numbers are lines of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import channel
from quillspark.llm.encodings import without_suspects
from quillspark.llm.language import Language, codes_of, follower_place, learn, same_digits, word_place
from quillspark.session import spread

#: How much likelier (in nats) another reading of a character or a word must be; a break against the pairs it makes.
LEAST, BREAK = 0.5, 1.0
#: Log share of scanned texts. Misreadings happen in these only, so that they are as much likelier there, and a text
#: without another mark of a scan pays this once.
SCANNED = -3.9
_NOT_WORDS = 1e-8
#: A run of more letters isn't a word of any language.
LONGEST_WORD = 64

_NUMERAL = "0-9０-９一二三四五六七八九十百千零〇○两"
_EDGE = r"[\s\-—–·~～\[\]()（）|/.●•*=]*"
_EDGES = " \t\r\v\f\u3000-—–·~～[]()（）|/.●•*="
_PAGE = re.compile(rf"^{_EDGE}(?:第\s*[{_NUMERAL} ]+\s*页|[Pp]age\s*\d{{1,5}}|PAGE\s*\d{{1,5}}|[PpＰｐ]\.?\s*\d{{1,5}}|\d{{1,4}}(?:\s*/\s*\d{{1,4}})?){_EDGE}$")
_TRAILING_PAGE = re.compile(rf"(?:第[{_NUMERAL}]+页|[Pp]age\d{{1,5}}|PAGE\d{{1,5}}|[PpＰｐ]\.?\d{{1,5}}|\d{{1,5}})$")
_HAN = r"㐀-鿿"
_STRAY = re.compile(rf"(?<=[{_HAN}，。：“”A-Za-z])[`^~|¦□■](?=[{_HAN}，。：“”A-Za-z])|(?<=[{_HAN}，。])['·](?=[{_HAN}，。])|(?<=[a-z])[·](?=[a-z])")
_GAP = re.compile(rf"(?<=[{_HAN}，。]) +(?=[{_HAN}，。])")
_HYPHEN = re.compile(r"(?<=[A-Za-zÀ-ÿ])[-‐¬\xad]\n\s*(?=[a-zÀ-ÿ])")
_ENDS = "。！？!?.…”\"’』」）)】]:：；;—"
_WORDS = re.compile(r"(?<![A-Za-z0-9À-ÿ\xad\u200b-\u200f\u2060\ufeff])[A-Za-z0158]*[A-Za-z][A-Za-z0158]*(?![A-Za-z0-9À-ÿ\xad\u200b-\u200f\u2060\ufeff])")
_NARROW = re.compile("[\0-⺀]+")
_TWO_LETTERS = re.compile("[A-Za-z]{2}")
#: What has to be there where _STRAY and _HYPHEN find anything; these are found faster.
_MAY_BE_STRAY = re.compile("[`^~|¦□■'·]")
_HYPHENATED = ("-\n", "‐\n", "¬\n", "\xad\n")
PAGE, HEADING, BROKEN, MISREADS, STRAY, GAPS = 1, 2, 4, 8, 16, 32
REPAIRED = "rec_id long, marks int, text string"


class Reader:
    """Repairs texts by one corpus's statistics; remembers the candidates of the words it has met."""

    def __init__(self, language: Language, characters: list[tuple[str, str, float]], letters: list[tuple[str, str, float]]):
        self.language = language
        self.known: dict[str, list[tuple[str, float]]] = {}
        self.after: dict[tuple[str | None, str], float] = {}
        self.liked: dict[tuple[str, str], float] = {}
        self.word_total = max(1.0, float(language.words.sum()))
        self.readings: dict[int, list[tuple[int, float]]] = {}
        for wrong, right, p in characters:
            self.readings.setdefault(ord(wrong), []).append((ord(right), p - SCANNED))
        flat = [(ord(wrong), ord(right), p) for wrong, right, p in characters]
        self.suspect = np.zeros(1 << 16, dtype=bool)
        self.suspect[list(self.readings)] = True
        self.wrong, self.right = (np.array([f[i] for f in flat], dtype=np.uint32) for i in (0, 1))
        self.cost = np.array([f[2] for f in flat], dtype=np.float32) - SCANNED
        self.letters: dict[str, list[tuple[str, float]]] = {}
        for wrong, right, p in letters:
            self.letters.setdefault(wrong, []).append((right, p - SCANNED))

    def _word(self, word: str) -> float:
        return float(np.log(self.language.words[word_place(word)] / self.word_total + _NOT_WORDS))

    def _follows(self, before: str | None, word: str) -> float:
        """Log probability of a word after another."""
        if (before, word) not in self.after:
            if len(self.after) > 500_000:
                self.after.clear()
            self.after[before, word] = self._after(before, word)
        return self.after[before, word]

    def _after(self, before: str | None, word: str) -> float:
        alone = float(self.language.words[word_place(word)]) / self.word_total
        if before is None:
            return float(np.log(alone + _NOT_WORDS))
        both = float(self.language.followers[follower_place(before, word)]) / max(1.0, float(self.language.words[word_place(before)]))
        return float(np.log(0.5 * min(1.0, both) + 0.5 * alone + _NOT_WORDS))

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """The word and what it may be misread for at up to two places, with the costs."""
        if word in self.known:
            return self.known[word]
        costs, own = {word: 0.0}, self._word(word) if word.isalpha() else np.log(_NOT_WORDS)
        first = {word: 0.0} if len(word) <= LONGEST_WORD else {}
        for _ in (1, 2):
            following: dict[str, float] = {}
            for base, paid in first.items():
                for size in (1, 2):
                    for at in range(len(base) - size + 1):
                        for right, p in self.letters.get(base[at : at + size], ()):
                            changed = base[:at] + right + base[at + size :]
                            if paid + p > following.get(changed, -np.inf):
                                following[changed] = paid + p
            for changed, cost in following.items():
                # A word that is rarer by more than the context can make good is no candidate.
                if changed.isalpha() and changed not in costs and self._word(changed) + cost > own - 2:
                    costs[changed] = cost
            first = following
        if len(self.known) < 500_000:
            self.known[word] = list(costs.items())
        return list(costs.items())

    def words(self, line: str) -> tuple[str, int, float]:
        """The line's words in their likeliest sequence, how many were misread, and by how much that is likelier."""
        options = [self.candidates(word) for word in _WORDS.findall(line)]
        if all(len(o) == 1 for o in options):
            return line, 0, 0.0
        found = list(_WORDS.finditer(line))
        states: dict[str | None, tuple[float, tuple]] = {None: (0.0, ())}
        for match, choice in zip(found, options, strict=True):
            following = {}
            for word, cost in choice:
                price = cost - (LEAST if word != match.group() else 0.0)
                score, way = max(((s + self._follows(last, word) + price, w) for last, (s, w) in states.items()), key=lambda x: x[0])
                following[word] = (score, (way, word))
            states = following
        score, way = max(states.values(), key=lambda x: x[0])
        own = sum(self._follows(last, word) for last, word in zip([None, *(m.group() for m in found)], (m.group() for m in found)))
        path = []
        while way:
            way, word = way
            path.append(word)
        changed = 0
        for match, word in zip(reversed(found), path, strict=True):
            if word != match.group():
                line, changed = line[: match.start()] + word + line[match.end() :], changed + 1
        return line, changed, score - own

    def _fixed(self, codes: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Places that are read as they are: dashes side by side, letters that don't stand between ideographs, signs beside none."""
        before, own, after = codes[places - 1], codes[places], codes[places + 1]
        dash = (own == 0x2014) & ((before == 0x2014) | (after == 0x2014))
        latin = (own < 128) & ((before < 0x2E80) | ((after < 0x2E80) & (after != 10) & (after != 0x201D)))
        return dash | latin | ~(channel.is_han(own) | channel.is_han(before) | channel.is_han(after))

    def suspect_places(self, codes: np.ndarray) -> np.ndarray:
        """Places that have another reading, and are likelier misread or stand beside another such place."""
        places = np.flatnonzero(self.suspect[np.minimum(codes, 0xFFFF)])
        places = places[(places > 0) & (places < len(codes) - 1)]
        places = places[~self._fixed(codes, places)] if places.size else places
        if not places.size:
            return places
        low, high = np.searchsorted(self.wrong, codes[places]), np.searchsorted(self.wrong, codes[places], "right")
        each = np.repeat(np.arange(len(places)), high - low)
        option = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]
        before, own, after, right = codes[places - 1][each], codes[places][each], codes[places + 1][each], self.right[option]
        pair = self.language.log_pair
        gain = pair(before, right) + pair(right, after) - pair(before, own) - pair(own, after) + self.cost[option]
        likely = np.zeros(len(places), dtype=bool)
        likely[each[gain > LEAST]] = True
        near = np.diff(places) == 1
        likely[:-1] |= near
        likely[1:] |= near
        return places[likely]

    def line(self, line: str, doubtful: bool = True) -> tuple[str, int, float]:
        """The line in its likeliest reading, the number of places that were misread, and by how much it is likelier.

        doubtful says that a character of the text may be misread, as suspect_places found.
        """
        fixed, changed, gain = line, 0, 0.0
        codes = same_digits(codes_of("\n" + line + "\n")) if doubtful else None
        places = self.suspect_places(codes) if doubtful else np.zeros(0, dtype=int)
        if places.size:
            chars = list(line)
            for group in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                path, more = self._viterbi(codes, int(group[0]), int(group[-1]) + 1)
                gain += more
                for place, code in zip(group, path, strict=True):
                    if code != codes[place]:
                        chars[place - 1] = chr(code)
                        changed += 1
            fixed = "".join(chars)
        if _TWO_LETTERS.search(fixed):
            fixed, words, more = self.words(fixed)
            changed, gain = changed + words, gain + more
        return fixed, changed, gain

    def _viterbi(self, codes: np.ndarray, start: int, end: int) -> tuple[list[int], float]:
        pair = lambda a, b: float(self.language.log_pair(np.array([a], dtype=np.uint32), np.array([b], dtype=np.uint32))[0])
        states: dict[int, tuple[float, list[int]]] = {int(codes[start - 1]): (0.0, [])}
        for place in range(start, end):
            own = int(codes[place])
            following = {}
            for code, cost in ((own, 0.0), *((right, p - LEAST) for right, p in self.readings[own])):
                following[code] = max((score + pair(last, code) + cost, way + [code]) for last, (score, way) in states.items())
            states = following
        score, path = max((score + pair(last, int(codes[end])), way) for last, (score, way) in states.items())
        return path, score - float(self.language.log_pair(codes[start - 1 : end], codes[start : end + 1]).sum())

    def likes(self, last: str, first: str) -> float:
        """By how much the two characters are likelier together than with a line break between them."""
        if (last, first) not in self.liked:
            if len(self.liked) > 500_000:
                self.liked.clear()
            a, b, n = (np.array([ord(c)], dtype=np.uint32) for c in (last, first, "\n"))
            pair = self.language.log_pair
            self.liked[last, first] = float(pair(a, b)[0] - (pair(a, n)[0] + pair(n, b)[0]) / 2)
        return self.liked[last, first]


def _width(line: str) -> int:
    return len(line) + len(_NARROW.sub("", line))


def _bare(text: str | None) -> str:
    return "".join((text or "").split()).lower()


def _kind(line: str, names: set[str]) -> int:
    """PAGE, HEADING, or 0 for a line of text."""
    if not line.strip():
        return 0
    if _PAGE.match(line):
        return PAGE
    bare = _bare(line)
    if bare in names:
        return HEADING
    stem = bare.rstrip(_EDGES)
    if not stem or stem[-1] != "页" and not stem[-1].isdecimal():
        return 0
    cut = _TRAILING_PAGE.sub("", stem).rstrip(_EDGES)
    return HEADING if cut and cut != stem and cut in names else 0


def _names(title: str | None, *chapters: str | None) -> set[str]:
    titles, rest = {_bare(title)}, {_bare(c) for c in chapters}
    names = titles | rest | {a + b for a in titles for b in rest}
    return {n for n in names if len(n) >= 2}


def _single_breaks(lines: list[str], widths: list[int], full: list[int], scanned: bool, reader: Reader) -> set[int]:
    """Lines that go on in the next one, where too few are broken to tell by their number.

    Such a line is about as wide as the widest, and the next isn't indented. In a text with other marks of a scan that
    is enough; else the corpus has to like the two characters, both ideographs, better together. Verse is narrower.
    """
    most, found = max(widths, default=0), set()
    for k in full:
        last, first = lines[k].rstrip()[-1], lines[k + 1][0]
        if not 24 <= widths[k] <= 120 or first.isspace():
            continue
        liked = all("㐀" <= c <= "鿿" for c in (last, first)) and reader.likes(last, first) > BREAK
        if liked and (scanned or widths[k] >= 0.85 * most) or scanned and widths[k] >= 0.85 * most:
            found.add(k)
    return found


def repair(text: str, names: set[str], reader: Reader, screened: bool = True, doubtful: bool = True) -> tuple[int, str]:
    """The marks found and the text without them, in paragraphs."""
    lines = text.split("\n")
    kinds = [_kind(line, names) for line in lines]
    marks = 0
    for kind in kinds:
        marks |= kind
    kept = [line for line, kind in zip(lines, kinds, strict=True) if not kind]
    body = "\n".join(kept)
    if any(h in body for h in _HYPHENATED) and _HYPHEN.search(body):
        marks |= BROKEN
    full = [k for k in range(len(kept) - 1) if kept[k].strip() and kept[k + 1].strip() and kept[k].rstrip()[-1] not in _ENDS]
    widths = [_width(line.rstrip()) for line in kept] if full else []
    middle = [k for k in full if kept[k].rstrip()[-1] not in "，、,-‐¬" or kept[k].rstrip()[-1] == "," and re.match("[a-z]", kept[k + 1])]
    if len(middle) >= 2:
        most = float(np.median([widths[k] for k in middle]))
        even = [k for k in middle if abs(widths[k] - most) <= max(5, 0.08 * most)]
        liked = sum(reader.likes(kept[k].rstrip()[-1], kept[k + 1].lstrip()[0]) > BREAK for k in even)
        if len(even) >= 2 and len(even) >= 0.6 * len(middle) and 24 <= most <= 120 and liked >= 0.34 * len(even):
            marks |= BROKEN
    wrapped, single = marks & BROKEN, set()
    if not wrapped:
        single = _single_breaks(kept, widths, full, bool(marks & (PAGE | HEADING)), reader)
        marks |= BROKEN if single else 0
    if " " in body and len(_GAP.findall(body)) >= 3:
        marks |= GAPS
    if _MAY_BE_STRAY.search(body) and _STRAY.search(body):
        marks |= STRAY
    if screened:
        fixed, changed, gains = zip(*[reader.line(line, doubtful) for line in kept], strict=True) if kept else ((), (), ())
        if sum(changed) and (marks or sum(gains) > -SCANNED):
            marks |= MISREADS
            kept = list(fixed)
    if not marks:
        return 0, text
    if marks & STRAY:
        kept = [_STRAY.sub("", line) for line in kept]
    if marks & GAPS:
        kept = [_GAP.sub("", line) for line in kept]
    if marks & BROKEN:
        most = max((_width(line.rstrip()) for line in kept), default=0)
        out: list[str] = []
        for k, line in enumerate(kept):
            indented = line.startswith(("　　", "  "))
            tail = out[-1].split("\n")[-1].rstrip() if out else ""
            if tail and line.strip() and not indented and (_width(tail) >= 0.6 * most if wrapped else k - 1 in single):
                if tail[-1] in "-‐¬\xad" and re.search("[A-Za-zÀ-ÿ].$", tail):
                    out[-1] = out[-1].rstrip()[:-1] + "\n" + line.lstrip()
                elif re.search(r"[A-Za-zÀ-ÿ,.;:!?\"'”’]$", tail) and re.match(r"[A-Za-zÀ-ÿ“\"'‘]", line.lstrip()):
                    out[-1] = out[-1].rstrip() + " \n" + line.lstrip()
                else:
                    out[-1] = out[-1].rstrip() + "\n" + line.lstrip()
            else:
                out.append(line)
        kept = [line.replace("\n", "") for line in out]
    return marks, "\n".join(kept)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch["text"]:
            seen.update(_WORDS.findall(text))
    yield pd.DataFrame(list(seen.items()), columns=["word", "n"])


def learnt(records: DataFrame) -> tuple:
    """The corpus's language (broadcast, tables of fixed size) and what is misread in it: wrong, right, log probability."""
    language = records.sparkSession.sparkContext.broadcast(learn(records, words=True, changed=without_suspects))
    places = channel.odd_places(records, language)
    texts = spread(records.select("rec_id", "text").where(F.col("text").rlike("[A-Za-z]{2}")).select("text"), "text")
    words = texts.mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    characters, letters = channel.confusions(channel.character_candidates(places, language), channel.word_candidates(words))
    flat = lambda rows: list(rows[["wrong", "right", "p"]].sort_values(["wrong", "right"]).itertuples(index=False, name=None))
    return language, flat(characters), flat(letters)


def repaired(records: DataFrame) -> DataFrame:
    """rec_id, marks (a sum of 1 page, 2 heading, 4 broken lines, 8 misread, 16 stray signs, 32 gaps) and the repaired text of every record with marks.

    Needs rec_id, text, book_title, chapter and chapter_title. Records without marks, null and empty texts have no
    row. A repeated rec_id has its row each time.
    """
    language, characters, letters = learnt(records)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(language.value, characters, letters)
        for batch in batches:
            texts = batch["text"].tolist()
            codes = same_digits(codes_of("\n" + "\n".join(texts) + "\n"))
            starts = np.cumsum([1] + [len(t) + 1 for t in texts])
            doubtful = set(np.searchsorted(starts, reader.suspect_places(codes), "right") - 1)
            rows = []
            for k, (rec, text, title, chapter, chapter_title) in enumerate(zip(batch["rec_id"], texts, batch["book_title"], batch["chapter"], batch["chapter_title"], strict=True)):
                screened = k in doubtful or _TWO_LETTERS.search(text) is not None
                if not screened and "\n" not in text and not _STRAY.search(text) and not _GAP.search(text):
                    continue
                marks, whole = repair(text, _names(title, chapter, chapter_title), reader, screened, k in doubtful)
                if marks:
                    rows.append((rec, marks, whole))
            yield pd.DataFrame(rows, columns=["rec_id", "marks", "text"])

    needed = records.select("rec_id", "text", "book_title", "chapter", "chapter_title").where(F.length("text") >= 1)
    return spread(needed, "rec_id").mapInPandas(run, REPAIRED)


def p5_found(spark, folder: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{folder}/metadata.parquet")).select("rec_id")


def p5_paragraphs(spark, folder: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{folder}/metadata.parquet"))
