from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import grams as G
from quillspark.operators import evaluate as E


def test_numbers_of_grams(spark):
    numbers, places, sizes = G.numbered_grams("一乙丙丁a鿿一")
    text = [("一乙丙丁a鿿一"[p : p + s]) for p, s in zip(places, sizes, strict=True)]
    assert sorted(text) == sorted(["一乙", "乙丙", "丙丁", "鿿一", "一乙丙", "乙丙丁", "一乙丙丁"])
    assert [t for _, t in sorted(zip(numbers.tolist(), text, strict=True))] == sorted(text)
    df = spark.createDataFrame([(int(n), t) for n, t in zip(numbers, text, strict=True)], "n long, t string")
    assert df.select((G.gram_of(F.col("n")) == F.col("t")).alias("a"), (G.number_of("t") == F.col("n")).alias("b")).distinct().collect() == [(True, True)]
    assert all(len(x) == 0 for t in ("", "一", "a\n") for x in G.numbered_grams(t))


def test_long_chapters_count_once(monkeypatch):
    rows = [("b", "c", "甲乙丙丁" * 9), ("b", "c", "甲乙"), ("b", "c", "丙丁戊" * 3), ("b", None, "甲乙"), (None, None, "甲乙丙" * 20), (None, None, "乙"), ("d", "c", "")]
    want = defaultdict(Counter)
    for book, chapter, text in rows:
        for size in (2, 3, 4):
            for i in range(len(text) - size + 1):
                want[text[i : i + size]][book, chapter] += 1
    for characters, grams in ((5, 7), (13, 1), (1000, 1000)):
        monkeypatch.setattr(E, "CHARACTERS_AT_ONCE", characters)
        monkeypatch.setattr(E, "GRAMS_AT_ONCE", grams)
        frame = pd.DataFrame(rows, columns=["book_id", "chapter_id", "text"])
        got = pd.concat(E._count_by_chapter(iter([frame[:2], frame[2:]]))).groupby("number")[["n", "span"]].sum()
        number = {t[p : p + s]: n for _, _, t in rows for n, p, s in zip(*(x.tolist() for x in G.numbered_grams(t)), strict=True)}
        assert {t: tuple(got.loc[n]) for t, n in number.items()} == {t: (sum(c.values()), len(c)) for t, c in want.items()}


def test_local_terms_make_no_string_of_each_gram(spark):
    records = spark.createDataFrame([("b", "c", "青石镇" * 30), ("b", "d", None)], "book_id string, chapter_id string, text string")
    df = E.local_terms(records)
    assert {(r.gram, r.n, r.span) for r in df.collect()} == {(g, n, 1) for g, n in {"青石": 30, "石镇": 30, "镇青": 29, "青石镇": 30, "石镇青": 29, "镇青石": 29, "青石镇青": 29, "石镇青石": 29, "镇青石镇": 29}.items()}
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_one_question_of_a_chapter_and_a_term(spark):
    lead, said = "那天夜里下了一场很大很大的雨", "他们一直走到青石镇的城门口才停下来歇脚"
    text = f"{lead}。{said}！ {said}。"
    rows = [(3, "b", "c", text), (1, "b", "c", text), (1, "b", "c", text), (2, "b", "d", text), (4, "b", "", text), (5, "b", "e", None), (6, "b", "f", said)]
    records = spark.createDataFrame(rows, "rec_id long, book_id string, chapter string, text string")
    terms = spark.createDataFrame([("青石镇", 30, 1), ("青石", 30, 1), ("城门口", 30, 2), ("雨夜", 90, 1)], "gram string, n long, span long")
    got = [tuple(r) for r in E.natural_questions(records, terms).collect()]
    assert got == [(1, "c", 1, f"{lead}，{E.TAILS[got[0][5]]}", "青石镇", "place", said)]
    assert E.natural_questions(records.limit(0), terms).count() == E.natural_questions(records, terms.limit(0)).count() == 0
