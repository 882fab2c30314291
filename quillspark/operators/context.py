"""Statistics of character n-grams, names mined from them, and subjects carried from chunk to chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import grams_of, han_runs, lines, strip

#: Words and endings that aren't names, and what a line that refers back begins with.
NOT_NAMES = ["我们", "你们", "他们", "自己", "一个", "什么", "没有", "已经", "可以", "知道", "时候", "现在", "就是", "忽然", "突然", "如何", "这样", "那个", "这个"]
NOT_ENDINGS = "说笑道行走看着过是有了在也又就都很去来上下和与"
REFERRING = "^(他|她|它|自己)"
LEAST_NAME, MOST_NAMES, LEAST_TERM = 3, 30, 30
#: Particles that make a two-character gram no term.
NOT_IN_TERMS = "的了在是与和就都也又很太更最再可并而及或等于从对把被让向为以之其那这哪"


def grams(texts: DataFrame, keys: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """keys, gram of every stretch of ideographs of these sizes, repeated as often as it occurs."""
    each = F.flatten(F.transform(han_runs("text", min(sizes)), lambda run: F.concat(*[grams_of(run, n) for n in sizes])))
    return texts.select(*keys, F.explode(each).alias("gram"))


def gram_counts(texts: DataFrame, keys: list[str], sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    return grams(texts, keys, sizes).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))


def book_terms(texts: DataFrame, least: int = LEAST_TERM) -> DataFrame:
    """Grams that occur often and hold no particle."""
    noisy = F.col("gram").rlike(f"^(.?[{NOT_IN_TERMS}].?)$") & (F.length("gram") == 2)
    return gram_counts(texts, []).where((F.col("n") >= least) & ~noisy & ~F.col("gram").isin(NOT_NAMES))


def gram_chapters(records: DataFrame) -> DataFrame:
    """gram and the number of different chapters it occurs in."""
    each = grams(records.where("chapter_id is not null"), ["book_id", "chapter_id"]).distinct()
    return each.groupBy("gram").agg(F.count(F.lit(1)).alias("chapters"))


def character_table(records: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """book_id, place and name: the most frequent grams of each book that may be names, ties by first occurrence.

    Needs book_id, rec_id and text. First means the smaller rec_id, then the place in its text, then the shorter gram.
    """
    wanted = ~F.col("gram").isin(NOT_NAMES) & ~F.right("gram", F.lit(1)).isin(*NOT_ENDINGS)
    each = grams(records, ["book_id", "rec_id"]).where(wanted)
    counted = each.groupBy("book_id", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("rec_id").alias("rec_id")).where(F.col("n") >= LEAST_NAME)
    # Only grams that tie with the last place need their place in the text.
    near = counted.withColumn("rank", F.rank().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "rec_id"))).where(F.col("rank") <= most)
    at = near.join(records.select("rec_id", "text").dropDuplicates(["rec_id"]), "rec_id").withColumn("at", F.instr(F.col("text"), F.col("gram")))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "rec_id", "at", F.length("gram")))
    return at.withColumn("place", place).where(F.col("place") <= most).select("book_id", "place", F.col("gram").alias("name"), "n")


def _subjects(line: Column, names: Column) -> Column:
    """Names in the head of a line, by where they stand; none in short lines of speech."""
    head = F.left(line, F.greatest(F.lit(10), F.floor(F.length(line) / 3).cast("int")))
    found = F.filter(F.transform(names, lambda n, i: F.struct(F.instr(head, n).alias("at"), i.alias("i"), n.alias("name"))), lambda x: x["at"] > 0)
    speech = line.rlike("[」』”\"']$") & (F.length(line) < 80)
    return F.when(speech, F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(found), lambda x: x["name"]))


def coref_subjects(records: DataFrame, names: DataFrame, block: int = 1000) -> DataFrame:
    """rec_id and subject of each record with a line that refers back; null where nothing is known.

    The line's own name counts first, else the last subject of the records before it in the book. The last subject
    is carried within blocks of records, and from block to block, so that a large book isn't one task's work.
    """
    tables = names.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("t")).select("book_id", F.col("t.name").alias("names"))
    each = records.join(tables, "book_id", "left").select("book_id", "rec_id", "chunk_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.filter(F.transform(lines("text"), strip), lambda x: x != "").alias("l"))
    events = F.flatten(F.transform("l", lambda line: _subjects(line, F.col("names"))))
    referring = F.filter("l", lambda line: line.rlike(REFERRING))
    inline = F.transform(referring, lambda line: F.get(F.filter("names", lambda n: F.contains(line, n)), 0))
    marked = each.select("book_id", "rec_id", "chunk_id", F.element_at(F.when(F.size(events) > 0, events), -1).alias("event"), F.size(referring).alias("refers"), inline.alias("inline"))
    marked = marked.withColumn("block", F.floor(F.coalesce("chunk_id", F.lit(0)) / block))
    inside = Window.partitionBy("book_id", "block").orderBy("chunk_id", "rec_id").rowsBetween(Window.unboundedPreceding, -1)
    last = marked.groupBy("book_id", "block").agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.struct("chunk_id", "rec_id"))).alias("block_last"))
    carried = last.withColumn("before", F.last("block_last", True).over(Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("book_id", "block", "before")
    placed = marked.withColumn("near", F.last("event", True).over(inside)).where("refers > 0").join(carried, ["book_id", "block"], "left")
    prior = F.coalesce("near", "before")
    own = F.get(F.filter("inline", lambda x: x.isNotNull()), 0)
    return placed.select("rec_id", F.when(prior.isNotNull(), F.coalesce(F.get("inline", 0), prior)).otherwise(own).alias("subject"))


def with_subject(text: Column, subject: Column) -> Column:
    return F.when(subject.isNotNull(), F.concat(F.lit("【前文主语："), subject, F.lit("】\n"), text)).otherwise(text)
