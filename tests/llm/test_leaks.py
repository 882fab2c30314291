import random

from quillspark.llm.leaks import Patterns, leaked, letters_and_digits


def brute(docs, items, n):
    def grams(t):
        return {t[i : i + n] for i in range(len(t) - n + 1)}

    return sorted({(d, i) for d, t in docs for i, e in items if t and e and grams(letters_and_digits(t)) & grams(letters_and_digits(e))})


def test_search_against_brute_force():
    rnd = random.Random(4)
    items = [(i, "".join(rnd.choice("甲乙丙ab1") for _ in range(rnd.randint(5, 60)))) for i in range(40)]
    patterns = Patterns([x for x in items if len(x[1]) >= 12], 12, 4)
    for _ in range(300):
        text = "".join(rnd.choice("甲乙丙ab1") for _ in range(rnd.randint(0, 40)))
        i, e = rnd.choice(items)
        a = rnd.randrange(len(e))
        text = text[:15] + e[a : a + rnd.randint(5, 30)] + text[15:]
        assert sorted(patterns.items_in(text)) == sorted({i for _, i in brute([(0, text)], items, 12)})


def test_table(spark):
    passage = "The letter to Ysolde said only this: 真正开启雾隐关的并不是残破的竹简，而是汀川临临终前缝进衣领的半句口诀。"
    docs = [(1, "x " + passage.upper().replace("，", ",\n")), (2, passage[:50]), (3, None), (4, ""), (5, "ｔｈｅ" + passage[3:60]), (1, passage), (6, "无关")]
    items = [(70, passage), (71, None), (72, "短"), (73, passage[8:])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long")
    it = spark.createDataFrame(items, "item_id long, evidence string")
    want = brute(docs, items, 40)
    assert sorted((r.doc_id, r.item_id) for r in leaked(df, it).collect()) == want and want
    assert sorted((r.doc_id, r.item_id) for r in leaked(df, it, limit=60).collect()) == want
    assert leaked(df, it.limit(0)).count() == 0 and leaked(df.limit(0), it).count() == 0
