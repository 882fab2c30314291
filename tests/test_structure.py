from quillspark.operators import structure as S
from quillspark.operators import cleaning  # noqa: F401

NOVEL = "序\n第一章 起始\n甲。乙\n\n丙\n第二章 转折\n丁\n第一章 回退\n戊\n第三章 a\n第四章 b\n己\n番外 一\n庚"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_numbers(spark):
    cases = {"十": 10, "二十三": 23, "一百零五": 105, "一千零二十八": 1028, "一万": 10000, "两千": 2000, "三万五": 30005, "x": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select("raw", S.written_number("raw").alias("n"))
    assert {r.raw: r.n for r in df.collect()} == cases
    heads = spark.createDataFrame([("第 12 章 x",), ("第二十回",), ("番外",), (None,)], "t string").select(S.chapter_number("t").alias("n"))
    assert [r.n for r in heads.collect()] == [12, 20, None, None]


def test_boundaries_drop_restart_and_join_neighbours(spark):
    rows = S.chapter_boundaries(docs(spark, NOVEL, "no heading", "", None)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.title) for r in rows] == [(1, 5, "第一章 起始"), (5, 9, "第二章 转折"), (9, 12, "第三章 a"), (12, 14, "番外 一")]


def test_lines_before_the_first_heading_are_body(spark):
    rows = S.lines_in_chapters(docs(spark, NOVEL)).orderBy("line_no").collect()
    assert rows[0].chapter == "正文" and rows[1].chapter == "第一章 起始" and [r.line for r in rows if r.chapter == "第三章 a"] == ["第四章 b", "己"]


def test_scenes_and_summary(spark):
    rows = S.scenes(docs(spark, "\n甲。乙\n丙\n\n \n丁")).orderBy("scene_no").collect()
    assert [(r.scene_no, r.text, r.start, r.summary) for r in rows] == [(1, "甲。乙\n丙", 1, "甲。"), (2, "丁", 10, "丁")]


def test_structure_offsets(spark):
    rows = S.parse_structure(docs(spark, NOVEL, None, " \n ")).orderBy("start").collect()
    assert [r.chapter_id for r in rows] == ["c1", "c2", "c3", "c4", "c5"]
    joined = "\n\n".join(r.text for r in rows)
    assert all(joined[r.start : r.end] == r.text for r in rows)
