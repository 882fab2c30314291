import random

from quillspark.llm import channel, scans
from quillspark.llm.scans import BROKEN, HEADING, MISREADS, PAGE, repaired

PARTS = ["外乡人", "守夜的老人", "把信烧成灰", "没有回答", "只是", "从孤舟城到雾隐关", "一共十二枚铜钱", "没有人走完过", "若有所思", "霁枝晚的石匣", "渡口结冰之前", "据说", "听见了水声", "发亮的石匣"]


def body(rnd, n=24):
    return "".join(rnd.choice(PARTS) + rnd.choice("，，。") for _ in range(n)) + "完了。"


def test_marks_and_repair(spark):
    rnd = random.Random(6)
    rows = [(i, body(rnd), "书名在此", "第三章 夜", None) for i in range(400)]
    clean = body(rnd)
    wrapped = [clean[k : k + 30] for k in range(0, len(clean), 30)]
    rows += [
        (900, "\n".join([*wrapped[:2], "- 12 -", "书名在此　第三章 夜", *wrapped[2:]]), "书名在此", "第三章 夜", None),
        (901, clean.replace("的", "旳", 2), "书名在此", None, None),
        (902, "月落山空，\n风起水寒，\n人在远舟，\n灯在孤城。", "书名在此", None, None),
        (903, None, None, None, None), (904, "", None, None, None), (905, clean + "\n第九页\n" + clean, None, None, None),
    ]
    got = {r.rec_id: r for r in repaired(spark.createDataFrame(rows, "rec_id long, text string, book_title string, chapter string, chapter_title string")).collect()}
    assert set(got) == {900, 901, 905}
    assert got[900].marks == PAGE | HEADING | BROKEN and got[900].text == clean
    assert got[901].marks == MISREADS and got[901].text == clean
    assert got[905].marks == PAGE and got[905].text == clean + "\n" + clean


def test_one_break(spark):
    """A record with one broken line: within a word, or after a comma beside a page number; verse and paragraphs stay."""
    rnd = random.Random(6)
    rows = [(i, body(rnd), None, None, None) for i in range(400)]
    word, comma = "只是，守夜的老人把信烧成灰，守夜的老", "只是，守夜的老人把信烧成灰，没有回答，"
    rows += [
        (900, word + "\n人没有回答。", None, None, None), (901, comma + "\n守夜的老人据说。\n- 12 -", None, None, None), (902, word + "\n人没有回答。\n- 12 -", None, None, None),
        (903, "月落山空风起，\n水寒人在远舟。\n- 12 -", None, None, None), (904, comma + "\n守夜的老人据说。", None, None, None), (905, comma[:-1] + "。\n人没有回答。", None, None, None),
    ]
    got = {r.rec_id: r for r in repaired(spark.createDataFrame(rows, "rec_id long, text string, book_title string, chapter string, chapter_title string")).collect()}
    assert set(got) == {900, 901, 902, 903}
    assert got[900].marks == BROKEN and got[900].text == word + "人没有回答。"
    assert got[901].marks == PAGE | BROKEN and got[901].text == comma + "守夜的老人据说。"
    assert got[902].marks == PAGE | BROKEN and got[902].text == word + "人没有回答。"
    assert got[903].marks == PAGE and got[903].text == "月落山空风起，\n水寒人在远舟。"


def test_misreadings_nobody_listed(spark):
    """What is misread is learnt from the corpus: pairs on no list, with the clean texts left alone."""
    rnd = random.Random(12)
    base = [chr(0x4E00 + k * 23) for k in range(500)]
    words = ["".join(rnd.choices(base, weights=[1 / (k + 4) for k in range(500)], k=rnd.choice((2, 3, 4)))) for _ in range(300)]
    odds = [1 / (k + 5) for k in range(300)]
    texts = ["".join(w + ("，" if rnd.random() < 0.15 else "。" if rnd.random() < 0.1 else "") for w in rnd.choices(words, weights=odds, k=150)) for _ in range(2000)]
    swaps = {base[3]: chr(0x9000), base[6]: chr(0x9001), base[12]: base[320]}
    assert not set(swaps) & set(channel.USUAL)
    rows, bad = [], {}
    for i, t in enumerate(texts):
        if i % 60 == 0:
            places = [k for k, c in enumerate(t) if c in swaps]
            for k in rnd.sample(places, min(4, len(places))):
                t = t[:k] + swaps[t[k]] + t[k + 1 :]
            bad[i] = texts[i]
        rows.append((i, t, None, None, None))
    got = {r.rec_id: r.text for r in repaired(spark.createDataFrame(rows, "rec_id long, text string, book_title string, chapter string, chapter_title string")).where("marks & 8 > 0").collect()}
    wrong = sum(a != b for i in bad for a, b in zip(rows[i][1], bad[i], strict=True))
    left = sum(a != b for i in bad for a, b in zip(got.get(i, rows[i][1]), bad[i], strict=True))
    assert left <= 0.2 * wrong
    assert len(set(got) - set(bad)) <= 0.01 * len(texts)


def test_channel_decides(spark, monkeypatch):
    """Without confusions nothing counts as misread."""
    rnd = random.Random(6)
    rows = [(i, body(rnd), None, None, None) for i in range(400)] + [(900, body(rnd).replace("的", "旳", 2), None, None, None)]
    df = spark.createDataFrame(rows, "rec_id long, text string, book_title string, chapter string, chapter_title string")
    assert [r.rec_id for r in repaired(df).collect()] == [900]
    whole = scans.learnt(df)
    monkeypatch.setattr(scans, "learnt", lambda records: (whole[0], [], []))
    assert repaired(df).count() == 0


def test_empty(spark):
    assert repaired(spark.createDataFrame([], "rec_id long, text string, book_title string, chapter string, chapter_title string")).count() == 0
