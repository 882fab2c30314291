"""Writers: versions of an index that are published as a whole, chat messages by day, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables under a new version and then its manifest; a version without manifest was never published.

    If one table fails nothing is published, and the last version stays the current one.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex[:12]
    for name, df in tables.items():
        df.write.parquet(f"{folder}/versions/{version}/{name}")
    row = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.array(*[F.lit(n) for n in sorted(tables)]).alias("tables"))
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("published_at"), F.desc("version")).limit(1).collect()
    except AnalysisException:
        return None
    return rows[0]["version"] if rows else None


def read_version(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    version = version or current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no version is published in {folder}")
    return spark.read.parquet(f"{folder}/versions/{version}/{name}")


def append_messages(messages: DataFrame, folder: str) -> None:
    """Messages (said_at, role, text and more) by day."""
    messages.withColumn("day", F.to_date("said_at")).write.mode("append").partitionBy("day").parquet(folder)


def drop_days(spark: SparkSession, folder: str, days: list[str]) -> None:
    """Empty the partitions of these days; all others stay as they are."""
    rows = spark.read.parquet(folder).where(F.col("day").isin(days))
    paths = [r["_file"].rsplit("/", 1)[0] for r in rows.select(F.input_file_name().alias("_file")).distinct().collect()]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in set(paths):
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines or CSV with a header."""
    writer = df.write.mode("errorifexists")
    writer.json(path) if kind == "json" else writer.option("header", "true").csv(path)
