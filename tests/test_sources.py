import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import index as I
from quillspark.operators.retrieval import hash_encode
from quillspark.sources import readers as R
from quillspark.sources import writers as W
from quillspark.streaming import ingest as S


def test_texts_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("汉字".encode())
    (tmp_path / "b.TXT").write_bytes(("中文内容" * 300).encode("gb18030"))
    (tmp_path / "c.md").write_text("x")
    with zipfile.ZipFile(tmp_path / "d.epub", "w") as book:
        book.writestr("OEBPS/1.xhtml", "<html><head><title>t</title></head><body><h1>第一章</h1><p>甲 <b>乙</b></p><script>x</script></body></html>")
        book.writestr("OEBPS/2.xhtml", "<p>丙</p>\n<p> </p><div>丁</div>")
    (tmp_path / "e.epub").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.read_texts(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.TXT", "d.epub", "e.epub"}
    assert got["a.txt"].text == "汉字" and got["b.TXT"].text == "中文内容" * 300 and got["b.TXT"].encoding == "gb18030"
    assert got["d.epub"].text == "第一章\n甲 乙\n\n丙\n丁" and got["e.epub"].error and got["e.epub"].text is None


def test_legacy_index(spark, tmp_path):
    np.save(tmp_path / "embeddings.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "other.npy", np.eye(3))
    (tmp_path / "metadata.json").write_text(json.dumps([{"content": "甲", "title": "t", "chunk_id": 5}, "乙"], ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{")
    rows = R.read_index(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.text, r.chapter, r.chunk_id) for r in rows] == [("甲", "t", 5), ("乙", "片段 2", 0)] and rows[0].vector == [1.0, 0.0, 0.0]
    names = spark.createDataFrame([("x.npy",), ("x.json",), ("metadata.json",), ("embeddings.npy",), ("y.npy",)], "name string")
    assert {r.name: r.partner for r in R.pair_files(names).collect()} == {"x.npy": "x.json", "embeddings.npy": "metadata.json", "y.npy": None}


def test_chat_and_qa(spark, tmp_path):
    (tmp_path / "2025-03-01.md").write_text("## [10:00:01] 👤 用户\n\n问题\n\n---\n\n## [10:00:05] 🤖 AI\n\n回答\n第二行\n\n---\n\n## [10:00:09] other\n\nx\n\n---\n\n")
    rows = R.read_chat(spark, str(tmp_path)).orderBy("turn").collect()
    assert [(r.role, r.text.split("\n")[0]) for r in rows] == [("user", "问题"), ("assistant", "回答")] and str(rows[0].said_at) == "2025-03-01 10:00:01"
    qa = tmp_path / "qa.json"
    qa.write_text(json.dumps({"items": [{"question": "q", "gold_chapter": "c", "answer_terms": ["a", "b"]}, {"question": ""}]}))
    assert [(r.question, r.chapter, r.answer) for r in R.read_qa(spark, str(qa)).collect()] == [("q", "c", "a、b")]


def test_versions_publish_whole(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert W.current_version(spark, folder) is None
    first = W.publish({"chunks": spark.range(3), "parents": spark.range(1)}, folder)
    bad = spark.range(2).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        W.publish({"chunks": spark.range(9), "parents": bad}, folder)
    assert W.current_version(spark, folder) == first and W.read_version(spark, folder, "chunks").count() == 3
    W.publish({"chunks": spark.range(5)}, folder)
    assert W.read_version(spark, folder, "chunks").count() == 5


def test_messages_by_day(spark, tmp_path):
    folder = str(tmp_path / "chat")
    rows = spark.createDataFrame([("2025-01-01 10:00:00", "user", "a"), ("2025-01-02 10:00:00", "user", "b")], "at string, role string, text string").withColumn("said_at", F.to_timestamp("at"))
    W.append_messages(rows, folder)
    W.append_messages(rows, folder)
    W.drop_days(spark, folder, ["2025-01-01"])
    assert [r.text for r in spark.read.parquet(folder).collect()] == ["b", "b"]


def test_stream_upserts_by_hash(spark, tmp_path):
    incoming, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(incoming)
    write([(1, "第一章 a\n甲\n第二章 b\n乙"), (2, "丙")])
    S.upsert_chapters(spark, incoming, target, state).awaitTermination()
    assert S.latest_chapters(spark, target).count() == 3
    write([(1, "第一章 a\n甲\n第二章 b\n乙改"), (3, None)])
    S.upsert_chapters(spark, incoming, target, state).awaitTermination()
    rows = {(r.doc_id, r.chapter_id): (r.text, r.batch) for r in S.latest_chapters(spark, target).collect()}
    assert rows == {(1, "c1"): ("甲", 0), (1, "c2"): ("乙改", 1), (2, "c1"): ("丙", 0)}


def test_stream_takes_the_last_version_and_drops_lost_chapters(spark, tmp_path):
    incoming, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(incoming)
    write("第一章 a\n" + "甲" * 50 + "\n第二章 b\n乙\n第三章 c\n丙")
    S.upsert_chapters(spark, incoming, target, state).awaitTermination()
    assert S.latest_chapters(spark, target).count() == 3
    write("第一章 a\n" + "甲" * 80 + "\n第二章 b\n乙\n第三章 c\n丙")
    time.sleep(1.1)
    write("第一章 a\n甲短\n第二章 b\n乙")
    S.upsert_chapters(spark, incoming, target, state).awaitTermination()
    rows = {r.chapter_id: (r.text, r.batch) for r in S.latest_chapters(spark, target).collect()}
    assert rows == {"c1": ("甲短", 1), "c2": ("乙", 0)}


def test_index_is_built_once_and_taken_over(spark, tmp_path):
    """A second build encodes only what changed; a failed one leaves the published version."""
    folder = str(tmp_path / "index")
    text = lambda n, edit="": "".join(f"第{c}章 名{c}\n" + f"这一章写的是第{c}件事，" * 40 + (edit if c == 2 else "") + "。\n" for c in range(1, n))
    docs = lambda edit="": spark.createDataFrame([(i, text(6, edit if i == 1 else ""), f"书{i}") for i in range(3)], "doc_id long, text string, book_title string")
    first = I.build_index(docs(), folder, hash_encode)
    assert first["pending"] == first["chunks"] > 0 and first["reused"] == 0
    again = I.build_index(docs(), folder, hash_encode)
    assert again["pending"] == 0 and again["reused"] == again["chunks"] == first["chunks"]
    edited = I.build_index(docs("改了一句"), folder, hash_encode)
    assert 0 < edited["pending"] < 0.2 * edited["chunks"] and edited["stale"] >= 1
    index = W.read_version(spark, folder, "chunks")
    assert index.count() == edited["chunks"] and index.where("size(embedding) <> 64").count() == 0
    assert W.read_version(spark, folder, "parents").count() > 0
    stats = W.read_version(spark, folder, "stats").collect()
    assert len(stats) == 1 and stats[0]["chunks"] == edited["chunks"] and stats[0]["max_chars"] == 672
