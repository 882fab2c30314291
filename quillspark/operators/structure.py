"""Chapters, scenes and lines of documents, found inside each document's own row, so that no text is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import col, lines, strip
from quillspark.operators.cleaning import is_title

#: Digits and places of written numbers.
DIGITS, PLACES = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}, {"十": 10, "百": 100, "千": 1000}
NUMBER = r"^第\s*([零〇一二三四五六七八九十百千万两\p{Nd}]+)\s*[章节回卷部集篇话]"
BODY = "正文"


def written_number(raw: Column | str) -> Column:
    """Value of a number written with ideographs; null for an empty text or any other character."""
    raw = col(raw)
    digit = F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])
    place = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    zero = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("last"))

    def read(state: Column, char: Column) -> Column:
        part_with = state["part"] + F.when(state["last"] == 0, F.lit(1)).otherwise(state["last"]) * place[char]
        make = lambda total, part, last: F.struct(total.cast("bigint").alias("total"), part.cast("bigint").alias("part"), last.cast("bigint").alias("last"))
        return (
            F.when(digit[char].isNotNull(), make(state["total"], state["part"], digit[char]))
            .when(place[char].isNotNull(), make(state["total"], part_with, F.lit(0)))
            .otherwise(make(state["total"] + (state["part"] + state["last"]) * 10000, F.lit(0), F.lit(0)))
        )

    value = F.aggregate(F.filter(F.split(raw, ""), lambda c: c != ""), zero, read, lambda s: s["total"] + s["part"] + s["last"])
    return F.when(raw.rlike("^[零〇一二两三四五六七八九十百千万]+$"), value)


def chapter_number(title: Column | str) -> Column:
    """The number in a heading; null where it has none."""
    raw = F.regexp_extract(strip(title), NUMBER, 1)
    return F.when(raw.rlike(r"^[0-9]{1,15}$"), raw.cast("bigint")).when(raw != "", written_number(raw))


def numbered_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no (from 0) and line of every text; a null text has none."""
    return documents.select(key, F.posexplode(lines("text")).alias("line_no", "line"))


def headings(text: Column | str) -> Column:
    """Headings that begin a chapter: line_no and title of each.

    A numbered heading below the highest number so far is dropped, neighbouring headings are one, named by the first.
    """
    short = F.filter(F.transform(lines(text), lambda line, i: F.struct(i.alias("line_no"), line.alias("line"))), lambda x: is_title(x["line"]))
    titles = F.transform(short, lambda x: F.struct(x["line_no"].alias("line_no"), strip(x["line"]).alias("title"), chapter_number(x["line"]).alias("number")))
    kind = "array<struct<line_no:int,title:string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("highest"), F.lit(-2).alias("last"), F.array().cast(kind).alias("got"))

    def add(state: Column, x: Column) -> Column:
        own = F.array(F.struct(x["line_no"].alias("line_no"), x["title"].alias("title")))
        got = F.when(x["line_no"] - state["last"] > 1, F.concat(state["got"], own)).otherwise(state["got"])
        kept = F.struct(F.greatest(state["highest"], F.coalesce(x["number"], F.lit(0).cast("bigint"))).alias("highest"), x["line_no"].alias("last"), got.alias("got"))
        return F.when(x["number"].isNull() | (x["number"] >= state["highest"]), kept).otherwise(state)

    return F.aggregate(titles, start, add, lambda state: state["got"])


def chapter_boundaries(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start_line, end_line (not in it) and title of each chapter; texts without heading have no row."""
    found = documents.where(F.col("text").isNotNull()).select(key, headings("text").alias("heads"), F.size(lines("text")).alias("line_count"))
    each = found.select(key, "heads", "line_count", F.posexplode("heads").alias("at", "head"))
    return each.select(key, F.col("head.line_no").alias("start_line"), F.coalesce(F.get("heads", F.col("at") + 1)["line_no"], F.col("line_count")).alias("end_line"), F.col("head.title").alias("title"))


def _chapters(documents: DataFrame, key: str, *others: str) -> DataFrame:
    """key, others and chapters: number (0 before the first heading), title, the line it begins at and its lines without the heading."""
    rows = documents.where(F.col("text").isNotNull()).withColumn("_heads", headings("text")).withColumn("_lines", lines("text"))
    opened = F.concat(F.array(F.struct(F.lit(-1).alias("line_no"), F.lit(BODY).alias("title"))), F.col("_heads"))
    rows = rows.withColumn("_opened", opened)

    def body(head: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_opened", i + 1)["line_no"], F.size("_lines"))
        return F.struct(i.alias("chapter_no"), head["title"].alias("chapter"), (head["line_no"] + 1).alias("first"), F.slice("_lines", head["line_no"] + 2, end - head["line_no"] - 1).alias("l"))

    return rows.select(key, *others, F.filter(F.transform("_opened", body), lambda c: F.size(c["l"]) > 0).alias("chapters"))


def lines_in_chapters(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line_no, line, chapter_no (0 before the first heading) and chapter of every line of a body, headings left out."""
    each = _chapters(documents, key).select(key, F.explode("chapters").alias("c"))
    return each.select(key, "c.chapter_no", "c.chapter", "c.first", F.posexplode("c.l").alias("at", "line")).select(key, (F.col("first") + F.col("at")).alias("line_no"), "line", "chapter_no", "chapter")


def with_scenes(rows: DataFrame, to: str = "scenes") -> DataFrame:
    """Adds scene_no (from 1), text and start of each run of lines of text that aren't blank."""
    rows = rows.withColumn("_lines", lines("text")).withColumn("_blank", F.transform("_lines", lambda line: ~line.rlike(r"[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]")))
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    begins = F.filter(places, lambda i: ~F.get("_blank", i) & F.coalesce(F.get("_blank", i - 1), F.lit(True)))
    ends = F.filter(places, lambda i: ~F.get("_blank", i) & F.coalesce(F.get("_blank", i + 1), F.lit(True)))
    rows = rows.withColumn("_runs", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    kind = "array<struct<scene_no:int,text:string,start:int>>"
    start = F.struct(F.lit(0).alias("line"), F.lit(0).alias("at"), F.array().cast(kind).alias("got"))

    def add(state: Column, run: Column) -> Column:
        between = F.slice("_lines", state["line"] + 1, run["a"] - state["line"])  # lines since the last scene
        begin = state["at"] + F.length(F.array_join(between, "\n")) + F.when(F.size(between) > 0, 1).otherwise(0)
        own = F.array_join(F.slice("_lines", run["a"] + 1, run["b"] - run["a"] + 1), "\n")
        got = F.concat(state["got"], F.array(F.struct((F.size(state["got"]) + 1).alias("scene_no"), own.alias("text"), begin.alias("start"))))
        return F.struct((run["b"] + 1).alias("line"), (begin + F.length(own) + 1).alias("at"), got.alias("got"))

    return rows.withColumn(to, F.aggregate("_runs", start, add, lambda state: state["got"])).drop("_lines", "_blank", "_runs")


def scenes(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, scene_no (from 1), text, start and summary of each run of lines that aren't blank."""
    found = with_scenes(documents.where(F.col("text").isNotNull()).select(key, "text"))
    return found.select(key, F.explode("scenes").alias("s")).select(key, "s.*").select(key, "scene_no", "text", "start", scene_summary("text").alias("summary"))


def scene_summary(text: Column | str) -> Column:
    """The first sentence with white space drawn together, 40 characters at most."""
    flat = strip(F.regexp_replace(col(text), r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+", " "))
    return F.left(F.element_at(F.split(flat, "(?<=[。！？…；])", 2), 1), F.lit(40))


def chapter_hash(text: Column | str) -> Column:
    return F.left(F.md5(col(text)), F.lit(16))


def chapter_bodies(documents: DataFrame, key: str = "doc_id", *others: str) -> DataFrame:
    """key, others, bodies (title and text of each chapter with a body) and begins, where each starts: two line breaks apart."""
    joined = lambda l: F.array_join(F.transform(l, lambda x: F.regexp_replace(x, r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+$", "")), "\n")
    trimmed = lambda l: F.regexp_replace(F.regexp_replace(joined(l), "\n{3,}", "\n\n"), "^\n+|\n+$", "")
    every = F.transform("chapters", lambda c: F.struct(c["chapter"].alias("title"), trimmed(c["l"]).alias("text")))
    full = _chapters(documents, key, *others).withColumn("every", every).withColumn("bodies", F.filter("every", lambda c: c["text"].rlike(r"[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("got"))
    begins = F.aggregate("bodies", start, lambda s, c: F.struct((s["at"] + F.length(c["text"]) + 2).alias("at"), F.concat(s["got"], F.array(s["at"])).alias("got")), lambda s: s["got"])
    return full.select(key, *others, "bodies", begins.alias("begins"))


def parse_structure(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chapter_id (c1, c2 ... of those with a body), title, text, hash, start and end of each chapter's body.

    Bodies are counted as joined by two line breaks, without headings.
    """
    each = chapter_bodies(documents, key).select(key, "begins", F.posexplode("bodies").alias("no", "c")).select(key, "no", F.col("c.title").alias("title"), F.col("c.text").alias("text"), F.get("begins", "no").alias("start"))
    return each.select(key, F.concat(F.lit("c"), F.col("no") + 1).alias("chapter_id"), "title", "text", chapter_hash("text").alias("hash"), "start", (F.col("start") + F.length("text")).alias("end"))
