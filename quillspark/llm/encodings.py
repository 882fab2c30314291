"""Problem 6: text that was decoded with the wrong encoding.

Method: a wrong code page is a substitution cipher: each character stands for a byte. Runs of characters that seldom
stand side by side are set against the bigrams of an encoding's bytes under every page; each source's runs are counted
by the page that explains them best, and those that none explains together. Expectation-maximization then learns the
source's own table of characters to bytes for each of these (see ciphers.py), from the page as a prior or from nothing.
The learnt tables alone decipher the source's records, by translate(). Which of them holds for a record, or none, is
the likeliest by the language's character pairs and by how often the source uses each, learnt by the same method.

A reading with a page of two bytes a character has no table of 256 places that could be learnt; these swaps are the
known ones, weighed in the same mixture.

The pairs are learnt from the texts without the stretches that look like bytes of another encoding, whatever they say,
so that garbled text doesn't count as language, however much of it there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ciphers import TWICE, ByteModel, byte_model, pages
from quillspark.llm.language import Language, codes_of, learn, same_digits
from quillspark.session import cut_lineage, spread

#: Pages of two bytes that texts were read with, and encodings they were written in.
DOUBLE = ("gb18030", "cp950", "cp932", "cp949")
WRITTEN = ("utf-8", "gb18030", "big5")
CIPHERS = ("utf-8", "gb18030", "utf-8" + TWICE, "big5")
#: Nats by which a deciphered record must be likelier, and each of its pairs; the mean of pairs below which a result is no language; rounds.
LEAST_GAIN, LEAST_RISE, SURE_RISE, WORST, ROUNDS = 1.5, 1.2, 0.3, -12.5, 2
#: A pair is rare if such pairs make up this share of all text; so many rare pairs in a row are looked into.
RARE_SHARE, RARE_RUN = 0.05, 5
#: Log probability of a pair of bytes that a page has to reach, the sum over a record's runs above it, and pairs from which a table is learnt from nothing.
EXPLAINED, LEAST_EXPLAINED, FREE_PAIRS = -11.5, 2.0, 1_200
#: Characters that a byte can be read as, and those among them that Chinese text has itself.
_HIGH, _USUAL = r"\x80-\u2e7f\ue000-\uf8ff\ufb00-\ufeff", "‘’“”—…·×°"
_RUN = re.compile(f"[{_HIGH}]{{2,}}")
#: The same with the second bytes of two that are ASCII.
_MIXED = re.compile(f"(?:[{_HIGH}][@-~]?){{3,}}")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}){2,}")
_GB = re.compile(rb"(?:[\xa1-\xa9\xb0-\xf7][\xa1-\xfe]){2,}")
_LOOKS = {
    "utf-8": re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+"),
    "gb18030": _GB, "big5": re.compile(rb"(?:[\xa1-\xc6\xc9-\xf9][@-~\xa1-\xfe]){2,}"),
}
_LOST = re.compile("�|锟斤拷")
DOUBLE_SWAPS = [(page, written) for page in DOUBLE for written in WRITTEN[:2] if page != written]
FOUND = "rec_id long, source string, swap string, gain double, stretches int, restored string"
LOOKED = FOUND + ", cipher string, rest string"


def odd_runs(text: str, pattern: re.Pattern = _RUN) -> list[tuple[int, int]]:
    """Runs of characters that bytes can be read as, but for those of usual signs and words in a usual case."""
    return [m.span() for m in pattern.finditer(text) if m.group().strip(_USUAL) and not _is_word(m.group())]


def _single_stretches(text: str, table: dict[int, int], written: str) -> list[tuple[int, int, str]]:
    """Characters from and to that can be bytes of the other encoding by the table, and what these say."""
    found = []
    for first, last in [m.span() for m in (_MIXED if written == "big5" else _RUN).finditer(text)]:
        raw = text[first:last].translate(table).encode("latin-1", "replace")
        for match in _LOOKS[written].finditer(raw):
            said = match.group().decode(written, "ignore")
            if said:
                found.append((first + match.start(), first + match.end(), said))
    return found


@cache
def _known(page: str) -> dict[int, int]:
    """translate() table of a page."""
    names, tables = pages()
    table = tables[names.index(page)]
    return {int(c): int(table[c]) for c in np.flatnonzero(table)}


def _chars(page: str, leads: bytes, tails: bytes) -> str:
    """The characters of a page that have such bytes."""
    raw = (bytes([a, b]).decode(page, "ignore") for a in leads for b in tails)
    return "".join(sorted({c for c in raw if len(c) == 1 and c >= "\x80"}))


_HIGHEST, _TAILS = bytes([*range(0xE3, 0xEA), 0xEF]), bytes(range(0x80, 0xC0))
#: Characters of cp950 that bytes of gb18030 give and Chinese text seldom has, and bytes of its usual characters and signs in UTF-8.
_RARE_950 = frozenset(_chars("cp950", bytes(range(0xC9, 0xD8)), bytes(range(0xA1, 0xFF)))) - {*_chars("gb2312", bytes(range(0xB0, 0xD8)), bytes(range(0xA1, 0xFF)))}
_SURE_UTF8 = re.compile(rb"(?:[\xe3-\xe9\xef][\x80-\xbf]{2}){2,}")
#: What only texts with such stretches are likely to have.
_FOREIGN = re.compile("[가-힣｡-ﾟ{}]|[{}][{}]|[{}][^\n]{{0,4}}[{}]".format(*map(re.escape, (
    _chars("cp950", _HIGHEST, _TAILS), _chars("gb18030", _HIGHEST, _TAILS), _chars("gb18030", _TAILS, _HIGHEST), *["".join(sorted(_RARE_950))] * 2,
))))
#: What a stretch of a page has to hold, else it isn't looked for.
_SIGNS = {"cp932": re.compile("[\uff61-\uff9f]"), "cp949": re.compile("[가-힣]"), "cp950": re.compile(f"[{re.escape(''.join(sorted(_RARE_950)))}]")}
#: Characters up to which a text's bytes are kept for the next search.
_KEPT = 65_536
#: Suspect stretches with no more characters between them are one.
_BETWEEN = 6


def _is_word(part: str) -> bool:
    """Letters in a usual case, as words of other scripts have them and bytes hardly."""
    return part.isalpha() and (part[1:] == part[1:].lower() or part == part.upper())


def without_suspects(text: str) -> str:
    """The text with line breaks for the stretches that look like another encoding's bytes by their form alone."""
    found = odd_runs(text)
    if _FOREIGN.search(text):
        whole = [(0, len(text))]
        for page in DOUBLE:
            found += [s[:2] for s in _double_stretches(text, page, "utf-8", whole, _SURE_UTF8)]
            for start, end, _ in _double_stretches(text, page, "gb18030", whole) if page in _SIGNS and len(_SIGNS[page].findall(text)) > (page == "cp950") else ():
                part = text[start:end]
                if page == "cp932":
                    sure = re.search("[\uff61-\uff9f]", part)
                elif page == "cp949":
                    sure = re.search("[가-힣]", part) and re.search("[㐀-鿿豈-\ufaff]", part)
                else:
                    sure = len(part) >= 4 and sum(c in _RARE_950 for c in part) >= max(2, 0.2 * len(part))
                if sure:
                    found.append((start, end))
    if not found:
        return text
    kept, at = [], 0
    for start, end in sorted(found):
        if not kept or start - at > _BETWEEN:
            kept.append(text[at:start])
        at = max(at, end)
    return "\n".join([*kept, text[at:]])


@cache
def _written(char: str, page: str) -> bytes:
    try:
        return char.encode(page)
    except UnicodeEncodeError:
        return b"\0"


@cache
def _page_bytes(page: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character of the basic plane in a page, filled up to four, and how many they are."""
    parts = [_written.__wrapped__(chr(code), page) for code in range(1 << 16)]
    filled = np.frombuffer(b"".join(p.ljust(4, b"\0") for p in parts), dtype=np.uint8).reshape(-1, 4)
    return filled, np.array([len(p) for p in parts], dtype=np.uint8)


@lru_cache(maxsize=16)
def _as_bytes(text: str, page: str) -> tuple[bytes, np.ndarray]:
    """The text's bytes in a page, a zero for what it doesn't have, and where each character's begin."""
    codes = codes_of(text)
    filled, sizes = _page_bytes(page)
    plain = np.minimum(codes, 0xFFFF)
    each, size = filled[plain], sizes[plain]
    for k in np.flatnonzero(codes > 0xFFFF):
        part = _written(text[k], page)
        each[k], size[k] = np.frombuffer(part.ljust(4, b"\0"), dtype=np.uint8), len(part)
    return each[np.arange(4) < size[:, None]].tobytes(), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _double_stretches(text: str, page: str, written: str, spans: list[tuple[int, int]], looks: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """The same for a page with characters of two bytes, inside the spans only."""
    found = []
    for first, last in spans:
        part = text[first:last]
        raw, places = (_as_bytes if len(part) <= _KEPT else _as_bytes.__wrapped__)(part, page)
        met = [m.span() for m in (looks or (_UTF8 if written == "utf-8" else _GB)).finditer(raw)]
        if not met:
            continue
        starts, ends = places.searchsorted([m[0] for m in met]), places.searchsorted([m[1] for m in met], "right") - 1
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start >= 2:
                said = raw[places[start] : places[end]].decode(written, "ignore")
                if said:
                    found.append((first + start, first + end, said))
    return found


def _gains(text: str, stretches: list[tuple[int, int, str]], written: str, single: bool, language: Language, own: np.ndarray) -> list[tuple[int, int, str, float]]:
    """Stretches that the language finds likelier deciphered, with the difference in nats."""
    if not stretches:
        return []
    framed = [(text[start - 1 : start] or "\n", said, text[end : end + 1]) for start, end, said in stretches]
    best = [(mean, said, size) if said.strip("�") else None for (_, said, _), (mean, size) in zip(framed, _means(framed, language), strict=True)]
    twice = []
    for k, (before, said, after) in enumerate(framed) if single and written == "utf-8" else ():
        again = _single_stretches(said, _known("cp1252"), "utf-8") if _RUN.search(said) else []
        for a, b, deeper in reversed(again):  # garbled twice
            said = said[:a] + deeper + said[b:]
        if again and said.strip("�"):
            twice.append((k, (before, said, after)))
    for (k, (_, said, _)), (mean, size) in zip(twice, _means([f for _, f in twice], language), strict=True):
        if best[k] is None or mean > best[k][0]:
            best[k] = (mean, said, size)
    stops = np.minimum([end + 1 for _, end, _ in stretches], len(own))
    each = np.array([start for start, _, _ in stretches])
    kept = []
    for (start, end, _), found, was in zip(stretches, best, (_sums(own, each, stops) / (stops - each)).tolist(), strict=True):
        if found:
            mean, said, size = found
            least = SURE_RISE if single and written == "utf-8" and end - start >= 3 else LEAST_RISE
            if mean > WORST and mean > was + least:
                kept.append((start, end, said, (mean - was) * size))
    return kept


def _sums(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The sum of the values from each start to its stop."""
    return np.add.reduceat(np.append(values, 0).astype(np.float64), np.stack((starts, stops), axis=1).ravel())[::2]


def _means(framed: list[tuple[str, str, str]], language: Language) -> list[tuple[float, int]]:
    """Of each text, with what stands before and after it, the mean log probability of its pairs and how many these are."""
    if not framed:
        return []
    sizes = np.array([sum(map(len, f)) for f in framed])
    stops = np.cumsum(sizes) - 1
    codes = same_digits(codes_of("".join(map("".join, framed))))
    sums = _sums(language.log_pair(codes[:-1], codes[1:]), stops - sizes + 1, stops)
    return list(zip((sums / (sizes - 1)).tolist(), (sizes - 1).tolist(), strict=True))


def _put(text: str, kept: list[tuple[int, int, str, float]]) -> str:
    for start, end, said, _ in reversed(kept):
        text = text[:start] + said + text[end:]
    return text


def _with_rare_runs(usual: np.ndarray, texts: list[str]) -> set[int]:
    """Which of the texts, line breaks between them, have a run that _rare_spans finds."""
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    usual = np.append(usual, True)
    usual[ends] = True
    places = np.flatnonzero(usual)
    return set(np.searchsorted(ends, places[np.flatnonzero(np.diff(places, prepend=-1) > RARE_RUN)]).tolist())


def _rare_spans(own: np.ndarray, rare: float) -> list[tuple[int, int]]:
    """Stretches of text around runs of rare pairs."""
    usual = np.flatnonzero(np.concatenate(([True], own >= rare, [True])))
    long = np.flatnonzero(np.diff(usual) > RARE_RUN)
    spans: list[tuple[int, int]] = []
    for k in long:
        a, b = max(0, int(usual[k]) - 3), min(len(own), int(usual[k + 1]) + 3)
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b)
        else:
            spans.append((a, b))
    return spans


def _explained(texts: list[str], models: dict[str, ByteModel]) -> list[tuple[str, str, str]]:
    """Of each text the swap whose bytes explain its odd runs best, these runs, and the runs that it doesn't explain."""
    names, tables = pages()
    owner, runs, scores = [], [], []
    for pattern, encodings in ((_RUN, CIPHERS[:3]), (_MIXED, CIPHERS[3:])):
        own, mine = [], []
        for k, text in enumerate(texts):
            for start, end in odd_runs(text, pattern):
                own.append(k)
                mine.append(text[start:end])
        owner.append(np.array(own, dtype=int))
        runs.append(mine)
        sums = np.zeros((len(encodings) * len(names), len(mine)), dtype=np.float32)
        for first in range(0, len(mine), 2000):  # so that a few MB are worked on at once
            part = mine[first : first + 2000]
            codes = np.minimum(codes_of("".join(part)), 0xFFFF)
            ends = np.cumsum([len(r) for r in part])
            starts = np.concatenate(([0], ends[:-1])) - np.arange(len(part))
            inside = np.ones(len(codes) - 1, dtype=bool)
            inside[ends[:-1] - 1] = False
            for p, table in enumerate(tables):
                bytes_ = np.where(codes < 128, codes, table[codes]).astype(np.int64)
                place = (bytes_[:-1] * 256 + bytes_[1:])[inside]
                for e, encoding in enumerate(encodings):
                    sums[e * len(names) + p, first : first + len(part)] = np.add.reduceat(models[encoding].plain.ravel()[place] - EXPLAINED, starts)
        scores.append(sums)
    swaps = [f"{w}>{n}" for w in CIPHERS for n in names]
    whole = np.zeros((len(swaps), len(texts)))
    first = len(scores[0])
    for rows, own, sums in ((slice(0, first), owner[0], scores[0]), (slice(first, None), owner[1], scores[1])):
        for r, line in zip(whole[rows], np.maximum(sums, 0), strict=True):
            r += np.bincount(own, line, minlength=len(texts))
    best = whole.argmax(axis=0)
    out = [[swaps[b] if whole[b, k] >= LEAST_EXPLAINED else "", [], []] for k, b in enumerate(best)]
    for kind in (0, 1):
        for n, k in enumerate(owner[kind]):
            b = best[k]
            mixed = int(b >= first)
            if out[k][0] and mixed == kind and scores[kind][b - mixed * first, n] > 0:
                out[k][1].append(runs[kind][n])
            elif kind == 0 and not (out[k][0] and mixed):
                out[k][2].append(runs[kind][n])
    return [(swap, "\n".join(good), "\n".join(rest)) for swap, good, rest in out]


def looked_at(records: DataFrame, language: Language) -> DataFrame:
    """A row for each record and swap of two-byte pages that makes it likelier, one without swap for each record with
    lost bytes, and one with stretches -1 for each record with odd runs: its text, the runs a page explains, the rest."""
    shared = records.sparkSession.sparkContext.broadcast(language)  # tables of fixed size
    columns = [c.split()[0] for c in LOOKED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        rare = model.rare(RARE_SHARE)
        bytes_ = {w: byte_model(model, w) for w in CIPHERS}
        for batch in batches:
            rows, odd = [], []
            texts = batch["text"].tolist()
            scores, at = model.log_pairs("\n".join(texts)), 0
            strange = _with_rare_runs(scores >= rare, texts)
            for k, (rec, source, text) in enumerate(zip(batch["rec_id"], batch["source"], texts, strict=True)):
                own = scores[at : at + len(text)]
                at += len(text) + 1
                if _LOST.search(text):
                    rows.append((rec, source, "", 0.0, 0, None, None, None))
                spans = _rare_spans(own, rare) if k in strange else []
                for page, written in DOUBLE_SWAPS if spans else ():
                    kept = _gains(text, _double_stretches(text, page, written, spans), written, False, model, own)
                    gain = sum(k[3] for k in kept)
                    if gain >= LEAST_GAIN:
                        rows.append((rec, source, f"{written}>{page}", gain, len(kept), _put(text, kept), None, None))
                if odd_runs(text):
                    odd.append((rec, source, text))
            if odd:
                for (rec, source, text), (swap, good, rest) in zip(odd, _explained([o[2] for o in odd], bytes_), strict=True):
                    rows.append((rec, source, swap, 0.0, -1, text, good, rest))
            yield pd.DataFrame(rows, columns=columns)

    texts = records.select("rec_id", F.coalesce("book_id", F.lit("")).alias("source"), "text").where(F.length("text") >= 1)
    return spread(texts, "rec_id").mapInPandas(run, LOOKED)


def learnt_tables(suspects: DataFrame, language: Language) -> DataFrame:
    """source, swap, chars and bytes: the table that each source's runs give for each swap, and for what no page explains.

    The runs' pairs of characters are counted first, so that a group has at most as many rows as there are different
    pairs, however many records its source has.
    """
    shared = suspects.sparkSession.sparkContext.broadcast(language)  # tables of fixed size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (source, swap), part in batch.groupby(["source", "swap"]):
                codes = codes_of("\n".join(part["runs"])).astype(np.int64)
                place = (codes[:-1] << 21 | codes[1:])[(codes[:-1] != 10) & (codes[1:] != 10)]
                pair, n = np.unique(place, return_counts=True)
                yield pd.DataFrame({"source": source, "swap": swap, "pair": pair, "n": n.astype(np.int64)})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        source, swap = group["source"].iloc[0], group["swap"].iloc[0]
        model, rows = shared.value, []
        first, second = group["pair"].to_numpy() >> 21, group["pair"].to_numpy() & 0x1FFFFF
        chars, at = np.unique(np.concatenate((first, second)), return_inverse=True)
        counts = np.zeros((len(chars), len(chars)))
        counts[at[: len(first)], at[len(first) :]] = group["n"]
        if swap:
            names, tables = pages()
            written, page = swap.split(">")
            known = np.where(chars < 128, chars, tables[names.index(page)][np.minimum(chars, 0xFFFF)])
            rows.append((swap, byte_model(model, written).learn(chars, counts, known)[0]))
        elif counts.sum() >= FREE_PAIRS:
            got = [(*byte_model(model, w).learn(chars, counts, None), f"{w}>learnt") for w in CIPHERS]
            rows += [(name, table) for table, mean, name in got if mean >= EXPLAINED]
        text = "".join(map(chr, chars))
        return pd.DataFrame([(source, name, text, bytes(table.astype(np.uint8))) for name, table in rows], columns=["source", "swap", "chars", "bytes"])

    both = suspects.select("source", F.explode(F.array(F.struct("swap", F.col("cipher").alias("runs")), F.struct(F.lit("").alias("swap"), F.col("rest").alias("runs")))).alias("x"))
    runs = both.select("source", "x.swap", "x.runs").where("runs <> ''")
    pairs = runs.mapInPandas(count, "source string, swap string, pair long, n long").groupBy("source", "swap", "pair").agg(F.sum("n").alias("n"))
    return pairs.groupBy("source", "swap").applyInPandas(fit, "source string, swap string, chars string, bytes binary")


def decipherings(suspects: DataFrame, tables: DataFrame, language: Language) -> DataFrame:
    """A row for each record with odd runs and each of its source's tables that makes it likelier."""
    shared = suspects.sparkSession.sparkContext.broadcast(language)  # tables of fixed size
    columns = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tables = shared.value, {}
        for batch in batches:
            rows = []
            for rec, source, text, learnt in zip(batch["rec_id"], batch["source"], batch["text"], batch["tables"], strict=True):
                own = model.log_pairs(text)
                for swap, chars, values in ((t["swap"], t["chars"], bytes(t["bytes"])) for t in learnt):
                    if (chars, values) not in tables:
                        if len(tables) > 1000:
                            tables.clear()
                        tables[chars, values] = {ord(c): b for c, b in zip(chars, values, strict=True) if b}
                    written = swap.split(">")[0].removesuffix(TWICE)
                    kept = _gains(text, _single_stretches(text, tables[chars, values], written), written, True, model, own)
                    gain = sum(k[3] for k in kept)
                    if gain >= LEAST_GAIN:
                        rows.append((rec, source, swap, gain, len(kept), _put(text, kept)))
            yield pd.DataFrame(rows, columns=columns)

    each = tables.groupBy("source").agg(F.collect_list(F.struct("swap", "chars", "bytes")).alias("tables"))  # as many as there are swaps
    # A few bytes are much work: as many tasks as the suspects have, which are a checkpoint's partitions.
    tasks = max(suspects.rdd.getNumPartitions(), suspects.sparkSession.sparkContext.defaultParallelism)
    return suspects.select("rec_id", "source", "text").join(each, "source").repartition(tasks, "rec_id").mapInPandas(run, FOUND)


def _learn_swaps(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each found row with the probability of its swap against the others and against none, learnt for each source."""
    rows = found.where("swap != ''").select("rec_id", "source", "swap", "gain")
    none = rows.select("rec_id", "source").distinct().select("rec_id", "source", F.lit("none").alias("swap"), F.lit(0.0).alias("gain"))
    rows = rows.unionByName(none)
    top = rows.groupBy("rec_id").agg(F.max("gain").alias("top"))
    rows = rows.join(top, "rec_id").select("rec_id", "source", "swap", F.exp(F.col("gain") - F.col("top")).alias("joint"))
    for step in range(rounds):
        whole = rows.groupBy("rec_id").agg(F.sum("joint").alias("evidence"))
        rows = rows.join(whole, "rec_id").withColumn("posterior", F.col("joint") / F.col("evidence")).drop("evidence")
        if step < rounds - 1:
            weights = rows.groupBy("source", "swap").agg((F.sum("posterior") + 0.1).alias("weight"))
            rows = rows.join(weights, ["source", "swap"]).select("rec_id", "source", "swap", (F.col("joint") * F.col("weight")).alias("joint"))
    return rows.where("swap != 'none'").select("rec_id", "swap", "posterior")


def _found(records: DataFrame) -> DataFrame:
    language = learn(records, changed=without_suspects, encodings=WRITTEN)
    looked = cut_lineage(looked_at(records, language))
    suspects = looked.where("stretches = -1").select("rec_id", "source", "swap", F.col("restored").alias("text"), "cipher", "rest")
    tables = cut_lineage(learnt_tables(suspects, language))
    known = looked.where("stretches >= 0").select(*[c.split()[0] for c in FOUND.split(", ")])
    return cut_lineage(known.unionByName(decipherings(suspects, tables, language)))


def restored(records: DataFrame) -> DataFrame:
    """rec_id, swap, text and lost of every garbled record; all other records have no row.

    Needs a unique rec_id, book_id and text. Null and empty texts are never garbled; a null book is a source of its
    own. lost says that characters are missing for good; text then holds what could be restored, or the text as it is.
    """
    found = _found(records)
    best = _learn_swaps(found).groupBy("rec_id").agg(F.max_by("swap", F.struct("posterior", "swap")).alias("swap"), F.sum("posterior").alias("sum")).where("sum >= 0.5").drop("sum")
    texts = best.join(found.select("rec_id", "swap", "restored"), ["rec_id", "swap"])
    gone = found.where("swap = ''").select("rec_id", F.lit(True).alias("lost")).distinct()
    marked = texts.join(gone, "rec_id", "full")
    own = records.select("rec_id", "text")
    return marked.join(own, "rec_id").select("rec_id", F.coalesce("swap", F.lit("")).alias("swap"), F.coalesce("restored", "text").alias("text"), (F.coalesce("lost", F.lit(False)) | F.coalesce("restored", "text").rlike("�|锟斤拷")).alias("lost"))


def p6_found(spark, folder: str) -> DataFrame:
    found = _found(spark.read.parquet(f"{folder}/metadata.parquet"))
    likely = _learn_swaps(found).groupBy("rec_id").agg(F.sum("posterior").alias("posterior")).where("posterior >= 0.5").select("rec_id")
    return likely.unionByName(found.where("swap = ''").select("rec_id")).distinct()


def p6_restored(spark, folder: str) -> DataFrame:
    return restored(spark.read.parquet(f"{folder}/metadata.parquet"))
