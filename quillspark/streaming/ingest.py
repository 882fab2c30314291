"""Streams: documents that arrive as files are upserted by chapter hash, messages are appended, events are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quillspark.operators.structure import parse_structure
from quillspark.session import cut_lineage


#: Folders that chapters are spread over by their document, so that a batch reads only those of its documents.
BUCKETS = 64
_CHAPTERS = "doc_id long, chapter_id string, title string, text string, hash string, start long, end long, gone boolean"


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def upsert_chapters(spark: SparkSession, incoming: str, target: str, checkpoint: str, schema: str = "doc_id long, text string") -> StreamingQuery:
    """Chapters of arriving documents, written where their hash is new; latest_chapters reads the last of each.

    Of several versions of a document in a batch the one that was written last counts, whatever its length. Chapters
    that its text no longer has are marked as gone; a null text leaves none.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        in_order = Window.partitionBy("doc_id").orderBy(F.desc("_written"), F.desc("_path"), F.desc("_row"))
        last = batch.withColumn("_n", F.row_number().over(in_order)).where("_n = 1").select("doc_id", "text").withColumn("bucket", _bucket(F.col("doc_id")))
        last = cut_lineage(last)
        buckets = [r.bucket for r in last.select("bucket").distinct().collect()]  # BUCKETS at most
        chapters = parse_structure(last).withColumn("gone", F.lit(False))
        try:
            history = _history(spark, target).where(F.col("bucket").isin(buckets)).join(last.select("doc_id"), "doc_id", "left_semi")
            known = _latest(history).select("doc_id", "chapter_id", "hash", "gone")
            fresh = chapters.join(known.where("not gone"), ["doc_id", "chapter_id", "hash"], "left_anti")
            lost = known.where("not gone").join(chapters, ["doc_id", "chapter_id"], "left_anti").select("doc_id", "chapter_id", F.lit(True).alias("gone"))
            chapters = fresh.unionByName(lost, allowMissingColumns=True)
        except FileNotFoundError:
            pass
        # A batch that is repeated after a failure writes into its own folder again.
        chapters.withColumn("bucket", _bucket(F.col("doc_id"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    named = stream.select("doc_id", "text", F.col("_metadata.file_modification_time").alias("_written"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    return named.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _history(spark: SparkSession, target: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_CHAPTERS + ", batch int, bucket int").parquet(target)
    except AnalysisException as error:
        raise FileNotFoundError(target) from error


def _latest(rows: DataFrame) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("doc_id", "chapter_id").orderBy(F.desc("batch")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def latest_chapters(spark: SparkSession, target: str) -> DataFrame:
    """The last version of each chapter that its document still has."""
    return _latest(_history(spark, target)).where("not gone").drop("gone", "bucket")


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """A stream of messages with said_at, by day."""
    daily = stream.withColumn("day", F.to_date("said_at"))
    return daily.writeStream.format("parquet").partitionBy("day").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows; works on a stream and on a table alike."""
    ready = events.withWatermark("ts", late) if events.isStreaming else events
    return ready.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
