"""Versions of an index: latest records, what can be taken over from the last build, links, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.chunking import build_chunks, build_parents
from quillspark.operators.context import character_table, coref_subjects, with_subject
from quillspark.operators.splitters import Spec
from quillspark.session import cut_lineage
from quillspark.sources.writers import current_version, publish, read_version


def latest_records(records: DataFrame) -> DataFrame:
    """The last load of each (book_id, chunk_id), ties to the larger rec_id; rows without a key each stand for themselves."""
    last = Window.partitionBy("book_id", "chunk_id").orderBy(F.desc("loaded_at"), F.desc("rec_id"))
    keyed = records.where("book_id is not null and chunk_id is not null").withColumn("_no", F.row_number().over(last)).where("_no = 1").drop("_no")
    return keyed.unionByName(records.where("book_id is null or chunk_id is null"))


def reuse(records: DataFrame, previous: DataFrame) -> DataFrame:
    """rec_id and the vec_id whose vector it can take over: same chapter, hash and place; null where none."""
    old = previous.where("embeddings is not null").groupBy("book_id", "chapter_id", "chapter_hash", "chunk_index").agg(F.min("vec_id").alias("vec_id"))
    return records.select("rec_id", "book_id", "chapter_id", "chapter_hash", "chunk_index").join(old, ["book_id", "chapter_id", "chapter_hash", "chunk_index"], "left").select("rec_id", "vec_id")


def pending(records: DataFrame, previous: DataFrame) -> DataFrame:
    """Records that must be encoded anew."""
    old = previous.where("embeddings is not null").select("book_id", "chapter_id", "chapter_hash", "chunk_index")
    return records.join(old, ["book_id", "chapter_id", "chapter_hash", "chunk_index"], "left_anti")


def links(records: DataFrame) -> DataFrame:
    """rec_id with the chunk ids before and after it in its chapter."""
    order = Window.partitionBy("book_id", "chapter_id").orderBy("chunk_id", "rec_id")
    return records.select("rec_id", F.lag("chunk_id").over(order).alias("prev_id"), F.lead("chunk_id").over(order).alias("next_id"))


def upper_median(values: DataFrame, key: str, value: str) -> DataFrame:
    """count, least, upper median and most of a value for each key, without collecting a key's values in one place.

    The values are counted first, so that a key of any number of rows has no more rows than different values.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy(value))
    placed = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    middle = F.floor(F.col("all") / 2) + 1
    return placed.groupBy(key).agg(F.max("all").alias("n"), F.min(value).alias("least"), F.min(F.when(F.col("upto") >= middle, F.col(value))).alias("median"), F.max(value).alias("most"))


def manifest(records: DataFrame) -> DataFrame:
    """book_id, chapter_id, hash and number of chunks as they are now."""
    return latest_records(records).groupBy("book_id", "chapter_id", "chapter_hash").agg(F.count(F.lit(1)).alias("chunk_count"))


def build_index(documents: DataFrame, folder: str, encode: Callable[[Column], Column], dimensions: int = 64, spec: Spec | None = None, key: str = "doc_id") -> dict[str, int]:
    """Build a version of an index and publish it: chunks with vectors, parents, manifest and one row of statistics.

    A chunk whose chapter has the same hash, whose place is the same and whose vector has the right length is taken over
    from the published version, with its subject; only the others are encoded, as prefix and text with what a pronoun
    refers to in front. Gives the numbers of chunks, taken over and encoded ones, and of old chapters that are stale.
    """
    spark, wanted = documents.sparkSession, spec or Spec()
    place = [key, "chapter_id", "chapter_hash", "chunk_index"]
    fresh = cut_lineage(build_chunks(documents, key, wanted))
    if current_version(spark, folder):
        before = read_version(spark, folder, "chunks")
        old = before.where(F.size("embedding") == dimensions).select(*place, "embedding", "coref_text").dropDuplicates(place)
        now = fresh.select(key, "chapter_id", "chapter_hash").distinct()
        stale = before.select(key, "chapter_id", "chapter_hash").distinct().join(now, [key, "chapter_id", "chapter_hash"], "left_anti").count()
    else:
        old, stale = fresh.select(*place, F.array().cast("array<float>").alias("embedding"), F.lit("").alias("coref_text")).limit(0), 0
    kept = fresh.join(old, place).withColumn("reused", F.lit(True))
    pending_rows = fresh.join(old.select(*place), place, "left_anti")
    # Names are counted over the whole book, subjects are carried through all its chunks.
    named = fresh.select(F.col(key).cast("string").alias("book_id"), F.xxhash64(key, "chunk_id").alias("rec_id"), "chunk_id", "text", "chapter_id")
    subjects = coref_subjects(named, character_table(named)).select("rec_id", "subject")
    told = pending_rows.withColumn("rec_id", F.xxhash64(key, "chunk_id")).join(subjects, "rec_id", "left").drop("rec_id")
    told = told.withColumn("coref_text", F.when(F.col("subject").isNotNull(), with_subject(F.col("text"), F.col("subject"))).otherwise("")).drop("subject")
    coded = told.withColumn("embedding", encode(F.concat("prefix", F.when(F.col("coref_text") != "", F.col("coref_text")).otherwise(F.col("text"))))).withColumn("reused", F.lit(False))
    chunks = cut_lineage(kept.unionByName(coded))
    parents = build_parents(chunks, [key, "chapter_id"])
    numbers = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.col("reused").cast("long")), F.lit(0)).alias("reused"), F.count_distinct(key, "chapter_id").alias("chapters"), F.lit(stale).alias("stale"))
    stats = numbers.withColumns({"dimensions": F.lit(dimensions), "min_chars": F.lit(wanted.min_chars), "target_chars": F.lit(wanted.target_chars), "max_chars": F.lit(wanted.max_chars), "overlap_chars": F.lit(wanted.overlap_chars), "overlap_ratio": F.lit(wanted.overlap_ratio)})
    stats = cut_lineage(stats)
    manifest_rows = chunks.groupBy(key, "chapter_id", "chapter_hash").agg(F.count(F.lit(1)).alias("chunk_count"))
    publish({"chunks": chunks, "parents": parents, "manifest": manifest_rows, "stats": stats}, folder)
    row = stats.collect()[0]
    return {"chunks": row["chunks"], "reused": row["reused"], "pending": row["chunks"] - row["reused"], "stale": row["stale"]}
