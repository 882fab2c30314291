"""Readers: text files of any encoding, EPUB, vectors in .npy, JSON records with aliases, chat logs, legacy indexes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Encodings tried in this order, and how much text a right one must give.
ENCODINGS, LEAST_DECODED = ("utf-8", "gb18030", "gbk", "gb2312"), 1000
FORMATS = (".txt", ".epub")
_BLOCKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Text(HTMLParser):
    """The text of a page, a line break after each block."""

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "head")
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(page: str) -> str:
    """Stripped lines of a page's text, without blank ones."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    return "\n".join(line for line in (x.strip() for x in "".join(parser.parts).split("\n")) if line)


def epub_text(data: bytes) -> str:
    """Texts of a book's pages in their order, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        pages = [n for n in book.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")) and "nav" not in n.lower().rsplit("/", 1)[-1]]
        texts = [html_text(book.read(n).decode("utf-8", "ignore")) for n in pages]
    return "\n\n".join(t for t in texts if t)


def decode_text(data: bytes) -> tuple[str, str]:
    """Text and encoding: the first that decodes, short texts in utf-8 with what can't be read left out."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "ignore"), "utf-8"
    for name in ENCODINGS:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if name == "utf-8" or len(text) > LEAST_DECODED or len(data) <= LEAST_DECODED:
            return text, name
    return data.decode("utf-8", "ignore"), "utf-8"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text, encoding and error of every .txt and .epub file; a broken file has an error and no text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    text, encoding = (epub_text(bytes(data)), "utf-8") if name.lower().endswith(".epub") else decode_text(bytes(data))
                    rows.append((name, text, encoding, None))
                except Exception as error:  # noqa: BLE001
                    rows.append((name, None, None, type(error).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "encoding", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).isin(*FORMATS)).mapInPandas(run, "path string, text string, encoding string, error string")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """stem, row and vector of every .npy file that holds a matrix of 32-bit floats; others are left out, objects are never loaded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    matrix = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                except ValueError:
                    continue
                if matrix.ndim == 2 and matrix.dtype == np.float32:
                    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    yield pd.DataFrame({"stem": stem, "row": np.arange(len(matrix)), "vector": list(matrix)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "stem string, row long, vector array<float>")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """stem, row, text, chapter and chunk_id of JSON lists of objects or strings; broken files have no row.

    The text is the first there is of text, content; the chapter of chapter, title, else the fragment's number.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    text = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("stem"), F.col("content").cast("string").alias("json"))
    each = text.select("stem", F.posexplode(F.from_json("json", "array<string>")).alias("row", "item"))
    of = lambda name: F.get_json_object("item", f"$.{name}")
    is_object = F.col("item").startswith("{")
    chapter = F.coalesce(F.when(is_object, F.coalesce(of("chapter"), of("title"))), F.concat(F.lit("片段 "), F.col("row") + 1))
    return each.select("stem", F.col("row").cast("long").alias("row"), F.when(is_object, F.coalesce(of("text"), of("content"), F.lit(""))).otherwise(F.col("item")).alias("text"), chapter.alias("chapter"), F.coalesce(F.when(is_object, of("chunk_id")).cast("long"), F.lit(0)).alias("chunk_id"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Records with their vectors, by stem and row; pairs of one stem, or metadata.json with embeddings.npy.

    Rows that either side lacks are left out, so that both are as long as the shorter.
    """
    vectors, records = read_vectors(spark, path), read_records(spark, path)
    same = F.when(F.col("stem") == "metadata", F.lit("embeddings")).otherwise(F.col("stem"))
    return records.withColumn("stem", same).join(vectors, ["stem", "row"])


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """question, chapter and answer of question sets: a JSON list, or an object with items; rows without question are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.items"), F.col("value")).alias("json"))
    kind = "array<struct<question:string,chapter:string,gold_chapter:string,answer:string,answer_terms:array<string>,evidence:string>>"
    items = raw.select(F.explode(F.from_json("json", kind)).alias("i")).select("i.*")
    return items.where("question <> ''").select("question", F.coalesce("chapter", "gold_chapter").alias("chapter"), F.coalesce("answer", F.array_join("answer_terms", "、")).alias("answer"), "answer_terms", "evidence")


#: What stands for a role in a message's heading.
ROLES = {"👤 用户": "user", "🤖 AI": "assistant", "⚙ 系统": "system"}


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """day, turn, role, said_at and text of Markdown logs, one file a day; each message has a heading with time and role.

    Messages of other roles and empty messages have no row.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("day"), "value")
    heading = r"(?m)^## \[(\d{2}:\d{2}:\d{2})\] (" + "|".join(ROLES) + ")"
    times, roles = (F.regexp_extract_all("value", F.lit(heading), F.lit(n)) for n in (1, 2))
    bodies = F.slice(F.split("value", heading), F.lit(2), F.size(times))
    each = files.select("day", F.posexplode(F.arrays_zip(times.alias("time"), roles.alias("role"), bodies.alias("body"))).alias("turn", "m"))
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("m.role")]
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("m.body", r"^\n+", ""), r"\n+---\s*$", ""), r"^\s+|\s+$", "")
    return each.select("day", (F.col("turn") + 1).alias("turn"), role.alias("role"), F.to_timestamp(F.concat_ws(" ", "day", "m.time")).alias("said_at"), text.alias("text")).where("text <> ''")


def pair_files(names: DataFrame) -> DataFrame:
    """stem, kind and partner of a folder's listing (name): vectors with records of their stem, else the standard pair, else alone."""
    parts = names.select("name", F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1).alias("stem"), F.lower(F.regexp_extract("name", r"^(.*)\.([^.]+)$", 2)).alias("kind"))
    partner = parts.where("kind = 'json'").select(F.when(F.col("stem") == "metadata", "embeddings").otherwise(F.col("stem")).alias("stem"), F.col("name").alias("partner"), (F.col("stem") == "metadata").alias("standard"))
    ranked = parts.where("kind = 'npy'").join(partner, "stem", "left").withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("standard")))
    return ranked.where("_n = 1").select("name", "stem", "partner")
