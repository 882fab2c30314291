"""Where to cut one text: small helpers that run inside Spark's tasks.

All boundaries of a text are found once; a cut is a search in sorted places, so that long texts stay linear.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

#: Sizes in characters, characters a token, and the share and bounds of overlaps.
MIN_CHARS, TARGET_CHARS, MAX_CHARS, CHARS_PER_TOKEN = 210, 560, 672, 1.4
OVERLAP_CHARS, OVERLAP_MOST, OVERLAP_RATIO = 50, 100, 0.125
#: Closing signs and pairs that a cut should not tear apart.
CLOSERS = "”’」』\"')）】》"
PAIRS = ("“”", "「」", "『』", "‘’", "（）", "《》", "【】", "()")

_FIRST, _SECOND, _SPACE = re.compile("[。！：？]"), re.compile("[；;：:，,、]"), re.compile(r"\s+")
_SENTENCE, _COMMA, _BREAK = re.compile("([。！？…；!?;]+)[”’」』）】]*"), re.compile("([，、：,:]+)"), re.compile("(\n+)")
_STOP = re.compile("[。！？…]")


@dataclass(frozen=True)
class Spec:
    """Sizes of chunks; ``of`` puts what is asked for within its bounds."""

    min_chars: int = MIN_CHARS
    target_chars: int = TARGET_CHARS
    max_chars: int = MAX_CHARS
    overlap_chars: int = OVERLAP_CHARS
    overlap_ratio: float = OVERLAP_RATIO
    overlap_most: int = OVERLAP_MOST

    @classmethod
    def of(cls, chunk_size=None, overlap=None, target=None, ratio=None) -> Spec:
        def number(x, kind, default):
            try:
                return default if x is None else kind(x)
            except (TypeError, ValueError):
                return default

        size = number(chunk_size, int, 0)
        most = size if MIN_CHARS < size <= MAX_CHARS else MAX_CHARS
        least = min(MIN_CHARS, most)
        return cls(least, min(max(least, number(target, int, TARGET_CHARS)), most), most, max(0, number(overlap, int, OVERLAP_CHARS)), min(max(0.0, number(ratio, float, OVERLAP_RATIO)), 0.5))

    def tokens(self) -> tuple[int, int, int]:
        return tuple(max(1, round(n / CHARS_PER_TOKEN)) for n in (self.min_chars, self.target_chars, self.max_chars))


def overlap_of(length: int, least: int, ratio: float) -> int:
    return max(least, int(length * ratio))


def _places(pattern: re.Pattern, text: str) -> list[int]:
    return [m.start() for m in pattern.finditer(text)]


def _lesser(text: str, second: list[int], spaces: list[tuple[int, int]], low: int, high: int) -> int:
    """After the first clause sign in the window, else after its first white space, else -1."""
    k = bisect_left(second, low)
    if k < len(second) and second[k] < high:
        return second[k] + 1
    k = bisect_left(spaces, (low, 0))
    if k and spaces[k - 1][1] > low:
        k -= 1
    return spaces[k][1] if k < len(spaces) and max(spaces[k][0], low) < high else -1


def recursive(text: str, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, target: int | None = None, ratio: float | None = None) -> list[tuple[int, int]]:
    """(start, end) of chunks cut at first-rank signs, else at lesser ones, else at the limit, each with an overlap."""
    least = max(1, int(least))
    most = max(least, int(most))
    overlap = 0 if overlap >= most else max(0, int(overlap))
    aim_chars = min(max(int(target), least), most) if target else 0
    first, second = _places(_FIRST, text), _places(_SECOND, text)
    spaces = [m.span() for m in _SPACE.finditer(text)]
    chunks, start, last, n = [], 0, 0, len(text)
    while start < n:
        if n - start <= least:
            chunks.append((start, n))
            break
        high, low = min(n, start + most), max(start + least, last)
        cut = -1
        if aim_chars:
            aim = min(max(start + aim_chars, low), high)
            k = bisect_left(first, aim)
            right = first[k] if k < len(first) and first[k] < high else None
            left = first[k - 1] if k and first[k - 1] >= low else None
            if right is not None and (left is None or right - aim <= aim - left):
                cut = right + 1
            elif left is not None:
                cut = left + 1
        else:
            k = bisect_left(first, low)
            cut = first[k] + 1 if k < len(first) and first[k] < high else -1
        if cut < 0:
            cut = _lesser(text, second, spaces, low, high)
        if cut <= start:
            cut = high
        chunks.append((start, cut))
        if cut >= n:
            break
        last = cut
        back = min(overlap_of(cut - start, overlap, ratio), most - 1) if ratio else overlap
        start = max(cut - back, start + 1)
    return [(a, b) for a, b in chunks if text[a:b].strip()]


def oversized(text: str, most: int, least: int = 1) -> list[tuple[int, int]]:
    """(start, end) of adjoining pieces of at most so many characters, cut at lesser signs or white space."""
    most = max(1, int(most))
    least = max(1, min(int(least), most))
    second, spaces = _places(_SECOND, text), [m.span() for m in _SPACE.finditer(text)]
    pieces, start, n = [], 0, len(text)
    while n - start > most:
        high = start + most
        cut = _lesser(text, second, spaces, min(start + least, high - 1), high)
        cut = cut if cut > start else high
        pieces.append((start, cut))
        start = cut
    if start < n:
        pieces.append((start, n))
    return [(a, b) for a, b in pieces if text[a:b].strip()]


class Cutter:
    """Cuts a chapter near the aimed length: at blank lines or paragraphs, sentences, clauses, else hard."""

    def __init__(self, text: str, spec: Spec):
        self.text, self.spec = text, spec
        self.levels = [[(m.start(), m.end(1), m.end()) for m in rule.finditer(text)] for rule in (_BREAK, _SENTENCE, _COMMA)]
        self.stops = [m.start() for m in _STOP.finditer(text)]

    def whole(self, start: int, end: int) -> bool:
        part = self.text[start:end]
        return all(part.count(a) == part.count(b) for a, b in PAIRS)

    def _ends(self, level: int, low: int, high: int) -> list[int]:
        runs, found = self.levels[level], []
        k = max(0, bisect_left(runs, (low, 0, 0)) - 1)
        for begin, signs, end in runs[k:]:
            if begin >= high:
                break
            if max(begin, low) >= min(signs, high):
                continue
            place = min(end, high)
            if level == 0:
                while place < high and self.text[place] in " \t":
                    place += 1
            if place > low:
                found.append(place)
        return found

    def cut(self, start: int) -> int:
        text, spec = self.text, self.spec
        high, low = min(len(text), start + spec.max_chars), start + spec.min_chars
        if high <= low:
            return high
        aim = min(max(start + spec.target_chars, low), high)
        for level in range(3):
            near = sorted(self._ends(level, low, high), key=lambda p: (abs(p - aim), p))[:8]
            place = next((p for p in near if self.whole(start, p)), None)
            if place is not None:
                return place
        if not self.whole(start, aim):
            closing = [p for p in (text.find(c, aim, min(high + 30, len(text))) for c in CLOSERS) if p >= 0]
            if closing:
                return min(closing) + 1
        return aim

    def back(self, start: int, cut: int) -> int:
        """Where the next chunk begins: an overlap back, at a sentence's begin if that is near enough."""
        spec = self.spec
        size = min(max(spec.overlap_chars, int(round((cut - start) * spec.overlap_ratio))), spec.overlap_most)
        place = max(cut - size, start)
        k = bisect_left(self.stops, place) - 1
        if k >= 0 and self.stops[k] >= start:
            begin = self.stops[k] + 1
            while begin < cut and self.text[begin] in CLOSERS:
                begin += 1
            if begin > start and cut - begin <= int(size * 1.5) + 20:
                return begin
        return place

    def chunks(self) -> list[tuple[int, int]]:
        spec, n = self.spec, len(self.text)
        found, start = [], 0
        while start < n and self.text.strip():
            if n - start <= spec.min_chars:
                found.append((start, n))
                break
            cut = self.cut(start)
            found.append((start, cut))
            if cut >= n:
                break
            start = max(self.back(start, cut), start + 1)
        found = [(a, b) for a, b in found if self.text[a:b].strip()]
        if len(found) > 1:
            (a, b), (c, e) = found[-2:]
            short, before = len(self.text[c:e].strip()), len(self.text[a:b].strip())
            if short < spec.min_chars and short + before <= spec.max_chars:
                found[-2:] = [(a, e)]
        return found
