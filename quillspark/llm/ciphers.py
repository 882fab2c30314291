"""Unknown code pages as substitution ciphers: which byte each character stands for, learnt from text alone.

The plain text is the bytes of an encoding, whose bigrams the corpus gives; a state knows the place of its byte in the
character, so that the bigrams hold what is valid, too. Expectation-maximization over the bigrams of the cipher's
characters learns the probability of each character for each byte, from a page's own table as the prior or, where no
page explains a source, from random beginnings of which the likeliest counts.
"""

from __future__ import annotations

from encodings.aliases import aliases
from functools import cache

import numpy as np

from quillspark.llm.language import Language, ends_of

#: Weight of a known page against what is seen, rounds from a known page, random beginnings, their rounds, rounds of the best.
PRIOR, ROUNDS, BEGINNINGS, FIRST_ROUNDS, LAST_ROUNDS = 3.0, 3, 10, 40, 80
#: Log probability of a pair with a character that the page doesn't have.
OFF_PAGE = -16.0


@cache
def pages() -> tuple[list[str], np.ndarray]:
    """Names of all single-byte pages that Python has and that keep ASCII, and the byte of each character of the basic plane (0 if none)."""
    names, tables, seen = [], [], set()
    ascii_text = "".join(map(chr, range(32, 127)))
    first = ["latin_1", "cp1252"]  # where pages agree, the usual one is named
    for name in first + sorted(set(aliases.values()) - set(first)):
        try:
            chars = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
            plain = bytes(range(32, 127)).decode(name) == ascii_text
        except (LookupError, TypeError, UnicodeError, AssertionError):
            continue
        if not plain or any(len(c) != 1 for c in chars) or sum(c >= "\x80" and c != "�" for c in chars) < 80 or tuple(chars) in seen:
            continue
        seen.add(tuple(chars))
        table = np.zeros(1 << 16, dtype=np.uint8)
        if name != "latin_1":
            table[128:160] = np.arange(128, 160)  # places without a sign are often kept as control characters
        for byte, char in enumerate(chars, 128):
            if char != "�":
                table[ord(char)] = byte
        names.append(name)
        tables.append(table)
    return names, np.array(tables)


#: What follows an encoding's name where its bytes were read as cp1252 and written in UTF-8 once more.
TWICE = "*2"


def _again(byte: int) -> bytes:
    """A byte read as cp1252 (or kept as a control character) and written in UTF-8."""
    try:
        return bytes([byte]).decode("cp1252").encode()
    except UnicodeDecodeError:
        return chr(byte).encode()


class ByteModel:
    """Joint probabilities of neighbouring bytes of an encoding, by states (byte and place) and by bytes alone."""

    def __init__(self, language: Language, written: str):
        encoding = written.removesuffix(TWICE)
        first, last = ends_of(encoding)
        codes = np.flatnonzero((first > 0) & (language.singles > 0))
        n, a, b = language.singles[codes].astype(float), first[codes], last[codes]
        three = (codes >= 0x800) & (encoding == "utf-8")
        middle = 256 + a * 64 + ((codes >> 6) & 63)
        ends = 256 + 256 * 64
        joint = language.joints[encoding]
        before, after = np.nonzero(joint)
        source = np.concatenate((a[~three], a[three], middle[three], before + ends))
        target = np.concatenate((b[~three] + ends, middle[three], b[three] + ends, after))
        weight = np.concatenate((n[~three], n[three], n[three], joint[before, after]))
        states = np.unique(np.concatenate((source, target))) if len(source) else np.zeros(1, dtype=int)
        self.byte = np.where(states < 256, states, np.where(states < ends, 128 + (states - 256) % 64, states - ends))
        source, target = np.searchsorted(states, source), np.searchsorted(states, target)
        if written != encoding:
            source, target, weight = self._doubled(source, target, weight)
        self.pairs = np.zeros((len(self.byte),) * 2)
        np.add.at(self.pairs, (source, target), weight)
        self.pairs /= max(1.0, self.pairs.sum())
        self.pairs = 0.999 * self.pairs + 0.001 * np.outer(self.pairs.sum(axis=1), self.pairs.sum(axis=0))
        self.pairs = self.pairs.astype(np.float32)
        self.of_byte = np.zeros((256, len(self.byte)), dtype=np.float32)
        self.of_byte[self.byte, np.arange(len(self.byte))] = 1
        plain = self.of_byte @ self.pairs @ self.of_byte.T
        self.plain = np.log(np.maximum(plain, np.exp(OFF_PAGE))).astype(np.float32)
        self.plain[0], self.plain[:, 0] = OFF_PAGE, OFF_PAGE

    def _doubled(self, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each state becomes the bytes that its own byte is written as."""
        spelled = [_again(int(b)) for b in self.byte]
        begins = np.concatenate(([0], np.cumsum([len(x) for x in spelled])))
        own = np.bincount(source, weight, minlength=len(spelled))
        inside = [(begins[k] + i, begins[k] + i + 1, own[k]) for k, x in enumerate(spelled) for i in range(len(x) - 1)]
        one, two, n = (np.array(x) for x in zip(*inside, strict=True)) if inside else (np.zeros(0, dtype=int),) * 3
        self.byte = np.frombuffer(b"".join(spelled), dtype=np.uint8).astype(int)
        return np.concatenate((begins[1:][source] - 1, one)), np.concatenate((begins[:-1][target], two)), np.concatenate((weight, n))

    def learn(self, chars: np.ndarray, counts: np.ndarray, known: np.ndarray | None, seed: int = 5) -> tuple[np.ndarray, float]:
        """The byte of each character and the mean log probability of a pair.

        counts holds how often the character of a row stands before that of a column. known gives the bytes of a
        page's characters (0 where it has none); without it the table is learnt from random beginnings.
        """
        ascii_char = chars < 128
        allowed = np.zeros((256, len(chars)))
        allowed[128:, ~ascii_char] = 1
        allowed[chars[ascii_char], np.flatnonzero(ascii_char)] = 1
        prior = np.zeros_like(allowed)
        if known is not None:
            has = np.flatnonzero(known > 0)
            prior[known[has], has] = PRIOR
            start = allowed / 128 * 0.02 + prior
            return self._maximize(start, counts, allowed, prior, ROUNDS)[:2]
        random, best = np.random.default_rng(seed), None
        for _ in range(BEGINNINGS):
            got = self._maximize(allowed * (1 + 0.1 * random.random(allowed.shape)), counts, allowed, prior, FIRST_ROUNDS)
            if best is None or got[1] > best[1]:
                best = got
        return self._maximize(best[2], counts, allowed, prior, LAST_ROUNDS)[:2]

    def _maximize(self, start: np.ndarray, counts: np.ndarray, allowed: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
        table = (start / np.maximum(start.sum(axis=1, keepdims=True), 1e-30)).astype(np.float32)
        counts, prior = counts.astype(np.float32), (prior + 1e-3 * allowed).astype(np.float32)
        for _ in range(rounds):
            emitted = table[self.byte]
            after = self.pairs @ emitted
            likely = np.maximum(emitted.T @ after, 1e-30)
            ratio = counts / likely
            expected = self.of_byte @ (emitted * (after @ ratio.T + self.pairs.T @ (emitted @ ratio))) + prior
            table = expected / np.maximum(expected.sum(axis=1, keepdims=True), 1e-30)
        mean = float((counts * np.log(likely)).sum() / max(1.0, counts.sum()))
        return expected.argmax(axis=0), mean, table


_models: dict[str, tuple[Language, ByteModel]] = {}


def byte_model(language: Language, written: str) -> ByteModel:
    """The model of an encoding, made once in each worker for a language."""
    if written not in _models or _models[written][0] is not language:
        _models[written] = (language, ByteModel(language, written))
    return _models[written][1]
