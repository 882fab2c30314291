from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as C


def out(spark, rule, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", rule.alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_encoding_runs_rules_in_order(spark):
    assert out(spark, C.fix_encoding("text"), "入马夭空竞然", "镇龘压龘鑫", "夭入马", None) == ["人马天空竟然", "镇压压金", "天人马", None]


def test_pinyin_inside_words(spark):
    assert out(spark, C.remove_pinyin("text"), "血sè的rì", "plain") == ["血色的日", "plain"]


def test_page_numbers_and_blank_lines(spark):
    text = "一\n 12 \n第十页\n-3-\n第3回\n\n　\n二"
    assert out(spark, C.remove_page_numbers("text"), text) == ["一\n第3回\n\n　\n二"]
    assert out(spark, C.remove_empty_lines("text"), text) == ["一\n 12 \n第十页\n-3-\n第3回\n二"]


def test_ads_keep_body_and_blank_lines(spark):
    text = "正文免费下载也在\n\n本站首发\n他走了（本章未完，请翻页）\n（本章未完）\n" + "长" * 201 + "www.\n月票多多"
    assert out(spark, C.remove_ads("text", ["月票"]), text) == ["正文免费下载也在\n\n他走了\n" + "长" * 201 + "www."]


def test_merge_keeps_headings_apart(spark):
    assert out(spark, C.merge_paragraphs("text"), "甲\n乙\n\n第一章 始\n丙\n丁") == ["甲乙\n\n第一章 始\n丙丁"]
    assert out(spark, C.merge_paragraphs("text"), "第一章 a\n第二章 b\n丙", "", None) == ["第一章 a\n\n第二章 b\n丙", "", None]


def test_normalize(spark):
    assert out(spark, C.normalize_structure("text"), "\r\n a\t　b \r\r\n\n\nc d\n\n", None, "") == ["a b\n\nc\nd", "", ""]


def test_title_rules(spark):
    texts = ["第一章 起始", "番外 一", "他说第三章。", "第三章到此。", "第一章" + "长" * 40, "  第12回 x", "", "第147章 赵家，雷家！"]
    assert out(spark, C.is_title("text"), *texts) == [True, True, False, False, False, True, False, True]


def test_clean_runs_all_and_rejects_unknown(spark):
    df = spark.createDataFrame([(0, "入马\n\n12\n本站\n好"), (1, None)], "i int, text string")
    assert [r.out for r in C.clean(df).orderBy("i").collect()] == ["人马\n好", ""]
    try:
        C.clean(df, ["nothing"])
    except ValueError:
        return
    raise AssertionError


def test_markdown(spark):
    assert out(spark, C.strip_markdown("text"), "# T\n**b** and *i* `c`\n![x](y)\n[l](u)\n---\n> q\n- a\n1. b") == ["T\nb and i c\n\nl\n\nq\na\nb"]


def test_tokens_round_half_even(spark):
    assert out(spark, T.estimate_tokens("text"), "", None, "汉字ab c1", "a" * 10) == [0, 0, round(2 * 0.72 + 2 * 1.3 + 2 * 0.35), 1]


def test_keyword_tokens(spark):
    assert out(spark, T.keyword_tokens("text"), "叶凡在哪 Été_1") == [["叶凡在哪", "été_1", "叶凡", "凡在", "在哪"]]


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a\n\nb", "x")], "line int, text string, l string")
    assert C.clean(df, to="o").select(F.col("o")).first().o == "a\nb"
