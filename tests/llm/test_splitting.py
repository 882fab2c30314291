from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.text import estimate_tokens
from quillspark.llm.splitting import Measure, bisect, split_oversized


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="汉字。，！？\n ab.Á👍", max_size=3000), st.integers(80, 200))
def test_pieces_keep_the_limits_and_give_the_text_back(text, limit):
    pieces = bisect(text, limit, limit, 20)
    assert "".join(text[a + shared : b] for a, b, shared in pieces) == text
    if len(pieces) > 1:
        for k, (a, b, shared) in enumerate(pieces):
            assert b - a <= limit and Measure(text[a:b]).tokens(0, b - a) <= limit
            assert k == 0 or (shared == min(20, a + shared) and pieces[k - 1][1] - a == shared)


def test_cuts_at_sentences():
    text = ("甲" * 49 + "。") * 30
    assert all(text[b - 1] == "。" for _, b, _ in bisect(text))


def test_dense_words_are_over_by_tokens(spark):
    text = "a " * 295
    assert len(text) < 672 and len(bisect(text)) > 1
    rows = [(1, text, 5), (2, None, 1), (3, "", 1), (4, "短", 1), (1, text, 5), (5, "a " * 280, 9)]
    df = spark.createDataFrame(rows, "rec_id long, text string, piece_no int")
    got = split_oversized(df).groupBy("rec_id").count().collect()
    assert [r.rec_id for r in got] == [1] and got[0]["count"] == 2 * len(bisect(text))
    assert split_oversized(df.limit(0)).count() == 0


def test_measure_is_the_estimate(spark):
    texts = ["", "汉字 ab cd。", "a" * 30, "１２ x汉y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(estimate_tokens("t").alias("n"))
    assert [r.n for r in df.collect()] == [Measure(t).tokens(0, len(t)) for t in texts]
