import re
from collections import Counter

from quillspark.operators import context as X


def test_character_table_and_ties(spark):
    text = "叶凡踏入山门。叶凡与庞博同行。叶凡看着庞博，庞博说道。"
    df = spark.createDataFrame([("b", 1, text), ("b", 2, None), (None, 3, "")], "book_id string, rec_id long, text string")
    rows = X.character_table(df).where("book_id = 'b'").orderBy("place").collect()
    freq: Counter = Counter()
    for run in re.findall(r"[一-鿿]{2,}", text):
        for at in range(len(run)):
            for n in (2, 3):
                if at + n <= len(run):
                    freq[run[at : at + n]] += 1
    want = [w for w in sorted((w for w, c in freq.items() if c >= 3 and w not in X.NOT_NAMES and w[-1] not in X.NOT_ENDINGS), key=lambda w: -freq[w])][:30]
    assert [r.name for r in rows] == want == ["叶凡", "庞博"]


def brute(chunks, names):
    subjects, last = {}, None
    for rec, text in chunks:
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        found, referred = None, False
        for line in lines:
            if line.startswith(("他", "她", "它", "自己")):
                referred = True
                found = next((n for n in names if n in line), None) or last
                if found:
                    break
        if referred:
            subjects[rec] = found
        for line in lines:
            if re.search(r"[」』”\"']$", line) and len(line) < 80:
                continue
            head = line[: max(10, len(line) // 3)]
            here = sorted(((head.find(n), i, n) for i, n in enumerate(names) if n in head))
            if here:
                last = here[-1][2]
    return subjects


def test_subjects_carry_over_blocks(spark):
    import random

    rnd = random.Random(2)
    names = ["叶凡", "庞博", "黑皇"]
    pool = ["叶凡踏入山门。", "他捡到一块石头。", "庞博与叶凡同行。", "“黑皇在此”", "她走了。", "自己想起黑皇。", "", "天色已晚，这时候黑皇才慢慢走来，很久都没有说话，山下的人都知道。"]
    chunks = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 3)))) for i in range(1, 120)]
    df = spark.createDataFrame([("b", i, i, t) for i, t in chunks] + [("none", 900, 1, "他走了。"), ("none", 901, 2, None)], "book_id string, rec_id long, chunk_id int, text string")
    table = spark.createDataFrame([("b", i + 1, n) for i, n in enumerate(names)], "book_id string, place int, name string")
    want = brute(chunks, names) | {900: None}
    for block in (1000, 7):
        assert {r.rec_id: r.subject for r in X.coref_subjects(df, table, block).collect()} == want


def test_grams_of_empty(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "一")], "id int, text string")
    assert X.grams(df, ["id"]).count() == 0
