from pyspark.sql import functions as F

from quillspark.functions.jsontext import json_object, rewrites
from quillspark.operators import evaluate as E
from quillspark.operators import index as I
from quillspark.operators import retrieval as R


def test_keyword_scores(spark):
    texts = spark.createDataFrame([(1, "山" + "x" * 99 + "水"), (2, "x" * 200 + "水"), (3, "x" * 600 + "水"), (4, None), (5, ""), (6, "无")], "id long, text string")
    asked = spark.createDataFrame([(1, ["山", "水", "山", "", None]), (2, None), (3, [])], "query_id long, terms array<string>")
    got = {(r.query_id, r.id): r.score for r in R.keyword_hits(texts, "id", asked).collect()}
    assert got == {(1, 1): 1.5 + 1.25, (1, 2): 1.25, (1, 3): 1.0}
    assert R.keyword_hits(texts.limit(0), "id", asked).count() == 0


def test_vector_hits_ties_and_bad_rows(spark):
    rows = [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    got = R.vector_hits(df, "id", "v", asked, 3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert [r.id for r in R.above(R.vector_hits(df, "id", "v", asked, 3)).orderBy("rank").collect()] == [1, 3]


def test_fusion_numbers(spark):
    lists = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 2, 2), (1, 0, 3, 3), (1, 1, 2, 1), (1, 1, 4, 2)], "query_id long, list_no int, id long, rank int")
    got = {r.id: r.score for r in R.fuse(lists, "id").collect()}
    assert abs(got[2] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got[1] - 1 / 61) < 1e-12 and abs(got[4] - 1 / 62) < 1e-12


def test_best_of_group_backfill(spark):
    hits = spark.createDataFrame([(1, 1, "三", 0.9), (1, 2, "三", 0.8), (1, 3, "五", 0.6), (1, 4, "", 0.95), (1, 5, None, 0.1)], "query_id long, id long, chapter string, score double")
    assert [r.id for r in R.best_of_group(hits, "chapter", "id", 3).orderBy("place").collect()] == [1, 3, 4]


def test_expand_and_context(spark):
    chunks = spark.createDataFrame([("b", "c1", i, "p1" if i < 3 else None) for i in range(1, 5)], "book_id string, chapter_id string, chunk_id int, parent_id string")
    parents = spark.createDataFrame([("b", "p1")], "book_id string, parent_id string")
    hits = spark.createDataFrame([(1, 1, "b", 2), (1, 2, "b", 3)], "query_id long, place int, book_id string, chunk_id int")
    got = [(r.kind, r.id) for r in R.expand(hits, chunks, parents).orderBy("ord").collect()]
    assert got == [("hit", "2"), ("hit", "3"), ("parent", "p1"), ("neighbor", "1"), ("neighbor", "4")]
    rows = [(1, 1, "甲", "hit", "子"), (1, 2, "甲", "parent", "父含子文"), (1, 3, "乙", "hit", "乙文"), (1, 4, "甲", "neighbor", "邻"), (1, 5, "", "hit", "")]
    df = spark.createDataFrame(rows, "query_id long, ord int, chapter string, kind string, text string")
    assert R.expanded_context(df).first().context == "[父块:甲]\n父含子文\n\n[邻居:甲]\n邻\n\n---\n\n[来源:乙]\n乙文"


def test_coverage_stops_at_what_is_missing(spark):
    df = spark.createDataFrame([("abc", "xaybzc"), ("abc", "ab"), ("axc", "abc"), ("", "a"), ("aa", "a")], "a string, t string").select(E.coverage(F.col("a"), F.col("t")).alias("c"))
    assert [round(r.c, 4) for r in df.collect()] == [1.0, 0.6667, 0.3333, 0.0, 0.5]


def test_queries_terms_and_json(spark):
    df = spark.createDataFrame([("q", ["q", " a ", "", None, "b", "c", "d"], "男主角和主角团")], "q string, o array<string>, t string")
    row = df.select(E.merge_queries(F.col("q"), F.col("o")).alias("m"), E.meta_terms(F.col("t")).alias("t")).first()
    assert row.m == ["q", "a", "b", "c"] and row.t == ["主角团", "男主角"]
    replies = ["```json\n{\"entities\":[\"“叶凡”\",\"\",\"叶凡\"],\"queries\":[]}\n```", "说明 {\"queries\": [\"a\"]} 完", "[\"x\"]", "nothing", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", json_object("r").alias("j"), rewrites("r").alias("w")).orderBy("i").collect()
    assert got[0].w.entities == ["叶凡"] and got[1].w.queries == ["a"] and got[2].w.entities == ["x"] and got[3].j is None and got[4].j is None


def test_recall_and_sample(spark):
    gold = spark.createDataFrame([(1, "第三章 a"), (2, "b"), (3, "c")], "query_id long, gold string")
    hits = spark.createDataFrame([(1, 2, "第三章 别"), (2, 1, "x"), (1, 1, None)], "query_id long, rank int, chapter string")
    judged = E.judge(hits, gold, E.same_chapter(F.col("chapter"), F.col("gold")))
    row = E.recall_and_mrr(judged, [], (1, 3)).first()
    assert (row.queries, row.recall_1, round(row.recall_3, 4), round(row.mrr, 4)) == (3, 0.0, 0.3333, 0.1667)
    rows = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 1)], "g string, k long")
    got = sorted((r.g, r.k) for r in E.systematic_sample(rows, "g", "k", 4).collect())
    assert got == [("a", 2), ("a", 7), ("a", 12), ("a", 17), ("b", 1)]


def test_latest_and_reuse(spark):
    schema = "rec_id long, book_id string, chapter_id string, chapter_hash string, chunk_id int, chunk_index int, loaded_at int"
    rows = [(1, "b", "c", "h", 1, 1, 5), (2, "b", "c", "h", 1, 1, 9), (3, None, "c", "h", 1, 1, 1), (4, None, "c", "h", 1, 1, 1), (5, "b", "c", "new", 2, 2, 1)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.rec_id for r in I.latest_records(df).collect()) == [2, 3, 4, 5]
    old = spark.createDataFrame([(7, "b", "c", "h", 1, [1.0]), (8, "b", "c", "h", 1, [1.0]), (9, "b", "c", "old", 2, [1.0]), (10, "b", "c", "new", 2, None)], "vec_id long, book_id string, chapter_id string, chapter_hash string, chunk_index int, embeddings array<float>")
    assert {r.rec_id: r.vec_id for r in I.reuse(df, old).collect()} == {1: 7, 2: 7, 3: None, 4: None, 5: None}
    assert sorted(r.rec_id for r in I.pending(df, old).collect()) == [3, 4, 5]
