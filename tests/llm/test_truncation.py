import random

from quillspark.llm.truncation import scored

PARTS = ["外乡人", "守夜的老人", "把信烧成灰", "没有回答", "只是", "从孤舟城到雾隐关", "一共十二枚铜钱", "没有人走完过", "若有所思", "霁枝晚的石匣", "渡口结冰之前", "据说"]


def text(rnd, n):
    return "".join(rnd.choice(PARTS) + rnd.choice("，，。") for _ in range(n)) + "走了。"


def test_held_out_accuracy(spark):
    rnd = random.Random(9)
    rows, cut = [], set()
    for i in range(1500):
        t, source = text(rnd, rnd.randint(5, 60)), rnd.choice(["a", "b", "limited", None])
        if source == "limited" and len(t) > 200:
            t = t[:200]
            if t[-1] not in "。":
                cut.add(i)
        elif i % 9 == 0:
            t += rnd.choice(["\n（全书完）", "\n【完】"])
        elif i % 60 == 1:
            t = t[: int(len(t) * 0.7)].rstrip("，。") + rnd.choice(["", "……", "�"])
            cut.add(i)
        rows.append((i, t, source, "x"))
    rows += [(9000, None, "a", "x"), (9001, "", "a", "x"), (9002, " \n　", "a", "x")]
    got = {r.doc_id: r.probability for r in scored(spark.createDataFrame(rows, "doc_id long, text string, source string, core string")).collect()}
    assert set(got) == set(range(1500))
    found = {i for i, p in got.items() if p >= 0.4}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert scored(df).count() == 0
    assert scored(spark.createDataFrame([(1, "短。", "a")], "doc_id long, text string, source string")).count() <= 1
