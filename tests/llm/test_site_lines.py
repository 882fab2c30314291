import random
import re
from collections import defaultdict

from quillspark.llm.site_lines import flagged_lines, repeated_lines, without_site_lines


def brute(rows):
    seen, places = defaultdict(set), defaultdict(list)
    for rec, book, text in rows:
        if book is None or text is None:
            continue
        for no, line in enumerate(text.split("\n"), 1):
            key = re.sub(r"[\s\d]+", "", line)
            if sum(c.isalpha() for c in key) >= 8:
                seen[book, key].add(rec)
                places[book, key].append((rec, no))
    return sorted({p for k, v in seen.items() if len(v) >= 5 for p in places[k]})


def data():
    rnd = random.Random(3)
    notices = ["登录后可发表评论共{}条哦哦", "未经许可任何人不得复制本作品", "上一章 目录 下一章 书签吗啊"]
    rows = []
    for i in range(240):
        book = rnd.choice(["a", "a", "b", "c", "d", None])
        lines = [f"正文第{i}段" + "".join(rnd.choice("甲乙丙丁戊己庚辛") for _ in range(20)) for _ in range(3)]
        if rnd.random() < 0.3:
            lines.insert(rnd.randrange(4), " " + notices[rnd.randrange(3)].format(rnd.randrange(99)) + "　")
        rows.append((i, book, "\n".join(lines)))
    return rows + [(900, "b", None), (901, "b", ""), (902, None, notices[1]), (903, "zz", notices[1])]


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_id long, book_id string, text string, line_no int")
    assert sorted((r.rec_id, r.line_no) for r in flagged_lines(df).collect()) == brute(rows)


def test_texts_without_the_lines(spark):
    rows = data()
    df = spark.createDataFrame(rows, "rec_id long, book_id string, text string")
    gone = defaultdict(set)
    for rec, no in brute(rows):
        gone[rec].add(no)
    want = {r: t if t is None or r not in gone else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in gone[r]) for r, _, t in rows}
    assert {r.rec_id: r.text for r in without_site_lines(df).collect()} == want


def test_chance_is_not_significant(spark):
    """A line that stands as often in every book is in many records of one by chance: the test leaves it, though the count of five would take it."""
    line = "到处都一样的一行文字啊"
    rows = [(i, "big" if i % 2 else f"b{i}", line if i // 2 % 4 == 0 else "".join(chr(0x4E00 + (i * 37 + 101 * k * k) % 5000) for k in range(12))) for i in range(800)]
    df = spark.createDataFrame(rows, "rec_id long, book_id string, text string")
    got = repeated_lines(df).collect()
    assert [(r.book_id, r.n_in, r.n_out, r.significant) for r in got] == [("big", 100, 100, False)]
    assert flagged_lines(df).count() == 0
    assert flagged_lines(df.limit(0)).count() == 0
