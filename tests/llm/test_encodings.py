import random

import numpy as np

from quillspark.llm import ciphers, encodings
from quillspark.llm.encodings import p6_found, restored

PARTS = ["外乡人", "守夜的老人", "把信烧成灰", "没有回答", "只是", "从孤舟城到雾隐关", "一共十二枚铜钱", "没有人走完过", "若有所思", "霁枝晚", "渡口结冰之前", "据说", "下面埋着", "发亮的石匣"]


def text(rnd):
    return "".join(rnd.choice(PARTS) + rnd.choice("，，。") for _ in range(14))


def test_round_trip(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    swaps = [("utf-8", "latin-1"), ("utf-8", "koi8-r"), ("gb18030", "latin-1"), ("utf-8", "cp437")]
    for i in range(600):
        t = text(rnd)
        if i < 8:
            written, read = swaps[i % 4]
            want[i] = t
            t = t.encode(written).decode(read) if i < 4 else t[:20] + t[20:60].encode(written).decode(read) + t[60:]
        rows.append((i, "b", t))
    rows += [(1000, None, "Ça va, répondit-elle, déjà vu à l’été."), (1001, "b", None), (1002, "b", ""), (1003, "b", "«Тихо», — сказал Орвин."), (1004, "b", text(rnd) + "��" + text(rnd))]
    got = {r.rec_id: r for r in restored(spark.createDataFrame(rows, "rec_id long, book_id string, text string")).collect()}
    assert set(got) == set(want) | {1004} and got[1004].lost
    assert all(got[i].text == t and not got[i].lost for i, t in want.items())


def garbled(t, written, read):
    if read in ("latin-1", "cp1252"):
        return "".join(bytes([b]).decode(read) if read == "latin-1" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in t.encode(written))
    return t.encode(written).decode(read, "replace")


def test_a_third_is_garbled(spark):
    """What is restored doesn't depend on how much of the source is garbled."""
    for swap in (("utf-8", "cp1252"), ("gb18030", "latin-1"), ("gb18030", "cp949"), ("gb18030", "cp950"), ("utf-8", "gb18030")):
        rnd = random.Random(9)
        rows = [(i, "b", text(rnd)) for i in range(450)] + [(900, "b", "«Тихо», — сказал Орвин."), (901, "b", "——……“" + text(rnd) + "”")]
        bad = {i: t for i, _, t in rows if i % 3 == 0 and i < 450}
        got = {r.rec_id: r for r in restored(spark.createDataFrame([(i, b, garbled(t, *swap) if i in bad else t) for i, b, t in rows], "rec_id long, book_id string, text string")).collect()}
        assert set(got) == set(bad), swap
        assert all(r.lost or r.text == bad[i] for i, r in got.items()), swap
        assert swap[1] in ("gb18030", "cp950", "cp949") or not any(r.lost for r in got.values()), swap


def corpus(rnd, n):
    """Texts of many different characters, as a language has them."""
    base = [chr(0x4E00 + k * 17) for k in range(700)]
    words = ["".join(rnd.choices(base, weights=[1 / (k + 2) for k in range(700)], k=rnd.choice((1, 2, 2, 3)))) for _ in range(900)]
    odds = [1 / (k + 3) for k in range(900)]
    return ["".join(w + ("，" if rnd.random() < 0.2 else "。" if rnd.random() < 0.1 else "") for w in rnd.choices(words, weights=odds, k=150)) for _ in range(n)]


def test_page_that_nobody_knows(spark):
    """A page of 128 characters in an order of its own is learnt from the source's texts alone; so are unusual real pages."""
    rnd = random.Random(4)
    texts = corpus(rnd, 900)
    signs = [chr(c) for c in [*range(0x1400, 0x1440), *range(0x10A0, 0x10C0), *range(0x2C00, 0x2C20)]]
    rnd.shuffle(signs)
    reads = {"own": lambda t: "".join(chr(b) if b < 128 else signs[b - 128] for b in t.encode())}
    for page in ("cp855", "iso8859_5", "cp1256", "cp852"):
        reads[page] = lambda t, page=page: "".join(bytes([b]).decode(page, "replace").replace("\ufffd", chr(b)) for b in t.encode())
    rows, want = [], {}
    for i, t in enumerate(texts):
        name = [None, *reads][i % 45] if i % 45 < 6 else None
        if name:
            want[i] = (name, t)
        rows.append((i, name or f"s{i % 7}", reads[name](t) if name else t))
    got = {r.rec_id: r for r in restored(spark.createDataFrame(rows, "rec_id long, book_id string, text string")).collect()}
    for name in reads:
        mine = [i for i, (n, _) in want.items() if n == name]
        assert sum(i in got for i in mine) >= 0.9 * len(mine), name
        assert np.mean([sum(a == b for a, b in zip(got[i].text, want[i][1])) / len(want[i][1]) for i in mine if i in got]) > 0.9, name
    assert all(got[i].swap.endswith(">learnt") for i, (n, _) in want.items() if n == "own" and i in got)
    assert set(got) <= set(want)


def test_nothing_is_found_without_learning(spark, monkeypatch, tmp_path):
    rnd = random.Random(8)
    texts = [text(rnd) for _ in range(300)]
    spark.createDataFrame([(i, "b", garbled(t, "utf-8", "cp1252") if i < 30 else t) for i, t in enumerate(texts)], "rec_id long, book_id string, text string").write.parquet(str(tmp_path / "metadata.parquet"))
    assert {r.rec_id for r in p6_found(spark, str(tmp_path)).collect()} == set(range(30))
    monkeypatch.setattr(encodings, "learnt_tables", lambda suspects, language: suspects.where("false").selectExpr("source", "swap", "'' as chars", "cast('' as binary) as bytes"))
    assert p6_found(spark, str(tmp_path)).count() == 0


def test_table_from_a_random_beginning():
    """Of a shuffled page every byte that is seen often comes out right."""
    rnd = random.Random(2)
    texts = corpus(rnd, 300)
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(int)
    first, last = ciphers.ends_of("utf-8")
    joint = np.zeros((256, 256))
    np.add.at(joint, (last[codes[:-1]], first[codes[1:]]), 1)
    model = ciphers.ByteModel(encodings.Language(np.zeros(1), np.bincount(codes, minlength=1 << 16), np.zeros(1), {"utf-8": joint}), "utf-8")
    raw = np.frombuffer("".join(texts[:40]).encode(), dtype=np.uint8).astype(int)
    seen, at = np.unique(raw, return_inverse=True)
    order = np.random.default_rng(1).permutation(len(seen))
    counts = np.zeros((len(seen),) * 2)
    np.add.at(counts, (order[at[:-1]], order[at[1:]]), 1)
    table, _ = model.learn(np.arange(0x400, 0x400 + len(seen)), counts, None)
    right = seen[np.argsort(order)]
    assert (counts.sum(axis=0) * (table == right)).sum() / counts.sum() > 0.95


def test_empty(spark):
    assert restored(spark.createDataFrame([], "rec_id long, book_id string, text string")).count() == 0
