from quillspark.llm.lookalikes import one_form, same_reading


def pairs(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "rec_id long, text string, clean string")
    return sorted((r.rec_id_a, r.rec_id_b) for r in same_reading(df).collect()), {r.rec_id: r.form for r in one_form(df).collect()}


def test_what_reads_the_same(spark):
    texts = ["一只Ａ，café 12", "一只A,café 12", "⼀只А，café 1​2", "一只A，cafe 12", "一只a，café 12", None, "", "，。", "，.", "一只Ａ，café 12", "見⻅", "見见"]
    found, forms = pairs(spark, texts)
    assert found == [(0, 1), (0, 2), (1, 2), (1, 9), (2, 9), (10, 11)]
    assert forms[0] == forms[1] == forms[2] == forms[9] and forms[3] != forms[0] and forms[4] != forms[0]
    assert forms[5] is None and forms[6] == ""


def test_many_copies_give_only_their_pairs(spark):
    texts = ["同一段文字"] * 300 + ["同一段文字​"] * 2 + [f"别的{i}" for i in range(50)]
    found, _ = pairs(spark, texts)
    assert len(found) == 600


def test_empty(spark):
    assert same_reading(spark.createDataFrame([], "rec_id long, text string")).count() == 0
