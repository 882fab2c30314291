"""Problem 3: lines that a site repeats over the records of one book.

Method: frequencies of a line within its book and outside of it are compared by the log-likelihood ratio; the false
discovery rate over all repeated lines is controlled by the step-up procedure; significant lines are anti-joined
from the records' lines, which are put together again by position.

Outside of a book only single occurrences in other books count: a notice that sister sites share is still a notice in
each of them. The p-value is one-sided, as only an excess counts, and bounded from above by the tail's
first term, so that the control errs on the safe side.

The test is over every line in two or more records of a book, and it alone says which lines are candidates; the stated
rule, five records, is an exact check of the significant ones. p3_disagreements lists what rule and test see otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_LETTERS, TESTED_RECORDS, MIN_RECORDS, RATE = 8, 2, 5, 0.05
#: Ratios are counted in steps of this width up to this many, which bounds the ranking to one small table.
STEP, STEPS = 0.05, 40_000


def line_key(line: Column) -> Column:
    """The line without white space and decimal digits."""
    return F.regexp_replace(line, r"(?U)[\s\p{Nd}\x{1c}-\x{1f}]+", "")


def _letters(key: Column) -> Column:
    return F.length(F.regexp_replace(key, r"\P{L}+", ""))


def _lines(records: DataFrame) -> DataFrame:
    """One row a line that can repeat: its place, its book and the digest of its key."""
    split = records.where(F.col("book_id").isNotNull() & F.col("text").isNotNull()).select("rec_id", "book_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    keyed = split.where(F.length("line") >= MIN_LETTERS).select("rec_id", "book_id", (F.col("at") + 1).alias("line_no"), line_key(F.col("line")).alias("key"))
    return keyed.where(_letters(F.col("key")) >= MIN_LETTERS).select("rec_id", "book_id", "line_no", F.unhex(F.md5("key")).alias("key"))


def _likelihood(k: Column, n: Column) -> Column:
    """k ln p + (n - k) ln (1 - p) at p = k / n; 0 at either end."""
    p = k / n
    return F.when((k <= 0) | (k >= n), F.lit(0.0)).otherwise(k * F.log(p) + (n - k) * F.log1p(-p))


def repeated_lines(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = RATE) -> DataFrame:
    """(book_id, key, n_in, n_out, ratio, significant) of every line in two or more records of a book."""
    lines = _lines(records).select("rec_id", "book_id", "key").distinct()
    counts = lines.groupBy("book_id", "key").agg(F.count(F.lit(1)).alias("n"))
    # A line's total leaves out books that repeat it; only keys that some book has more than once go on.
    totals = counts.groupBy("key").agg(F.sum((F.col("n") < TESTED_RECORDS).cast("long")).alias("n_out"), F.max("n").alias("most")).where(F.col("most") >= TESTED_RECORDS)
    sizes = records.where(F.col("book_id").isNotNull() & F.col("text").isNotNull()).groupBy("book_id").agg(F.countDistinct("rec_id").alias("size"))
    corpus = sizes.agg(F.sum("size").alias("corpus"))
    repeated = counts.where(F.col("n") >= TESTED_RECORDS)
    pairs = repeated.join(totals.select("key", "n_out"), "key").join(sizes, "book_id").join(F.broadcast(corpus), how="cross")  # corpus is one row
    k1, n1, k2 = (F.col(c).cast("double") for c in ("n", "size", "n_out"))
    n2 = F.greatest(F.col("corpus") - F.col("size"), F.lit(1)).cast("double")
    together = _likelihood(k1 + k2, n1 + n2)
    ratio = F.when(k1 / n1 > k2 / n2, 2 * (_likelihood(k1, n1) + _likelihood(k2, n2) - together)).otherwise(0.0)
    scored = pairs.select("book_id", "key", F.col("n").alias("n_in"), "n_out", F.greatest(ratio, F.lit(0.0)).alias("ratio"))
    scored = scored.withColumn("step", F.least(F.floor(F.col("ratio") / STEP), F.lit(STEPS)).cast("int"))
    # Step-up: the smallest ratio whose p-value is at most rate * rank / tests. At most STEPS rows are ranked.
    steps = scored.groupBy("step").agg(F.count(F.lit(1)).alias("tests"))
    ranked = steps.select("step", F.sum("tests").over(Window.orderBy(F.desc("step"))).alias("rank"), F.sum("tests").over(Window.partitionBy(F.lit(0))).alias("all"))
    least_ratio = F.col("step") * STEP
    tail = F.exp(-least_ratio / 2) / 2 * F.least(F.lit(1.0), 1 / F.sqrt(F.pi() * F.greatest(least_ratio, F.lit(STEP)) / 2))  # erfc(x) <= exp(-x^2) / (x sqrt(pi))
    passing = ranked.where(tail <= rate * F.col("rank") / F.col("all")).agg(F.coalesce(F.min("step"), F.lit(STEPS + 1)).alias("least"))
    return scored.join(F.broadcast(passing), how="cross").select("book_id", "key", "n_in", "n_out", "ratio", (F.col("step") >= F.col("least")).alias("significant"))  # passing is one row


def flagged_lines(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = RATE) -> DataFrame:
    """(rec_id, line_no) of every occurrence of a significant line that is in min_records records of its book.

    Needs rec_id, book_id and text. Rows with a null book or text have no lines; lines with under 8 letters never
    count; a repeated rec_id counts as one record, each row's lines come out once.
    """
    chosen = repeated_lines(records, min_records, rate).where(F.col("significant") & (F.col("n_in") >= min_records)).select("book_id", "key")
    return _lines(records).join(chosen, ["book_id", "key"], "left_semi").select("rec_id", "line_no").distinct()


def without_site_lines(records: DataFrame, min_records: int = MIN_RECORDS, rate: float = RATE) -> DataFrame:
    """rec_id, text and removed (lines) of every record; texts without such lines come out as they are.

    Needs a unique rec_id. A text that is nothing but such lines comes out empty, a null text null.
    """
    flags = flagged_lines(records, min_records, rate)
    touched = flags.groupBy("rec_id").agg(F.count(F.lit(1)).alias("removed"))
    base = records.select("rec_id", "text")
    dirty = base.join(touched, "rec_id", "left_semi").select("rec_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kept = dirty.withColumn("line_no", F.col("at") + 1).join(flags, ["rec_id", "line_no"], "left_anti")
    joined = kept.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    joined = joined.select("rec_id", F.array_join(F.col("lines.line"), "\n").alias("rest"))
    return (
        base.join(touched, "rec_id", "left").join(joined, "rec_id", "left")
        .select("rec_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.coalesce("rest", F.lit(""))).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))
    )


def p3_found(spark, folder: str) -> DataFrame:
    return flagged_lines(spark.read.parquet(f"{folder}/metadata.parquet"))


def p3_lines(spark, folder: str) -> DataFrame:
    """Each tested line's ratio and significance."""
    return repeated_lines(spark.read.parquet(f"{folder}/metadata.parquet")).select("book_id", F.hex("key").alias("line"), "n_in", "n_out", "ratio", "significant")


def p3_disagreements(spark, folder: str) -> DataFrame:
    """Lines in five or more records of a book that aren't significant, and significant ones in fewer."""
    return p3_lines(spark, folder).where(F.col("significant") != (F.col("n_in") >= MIN_RECORDS))


def p3_clean(spark, folder: str) -> DataFrame:
    return without_site_lines(spark.read.parquet(f"{folder}/metadata.parquet"))


P3_FOUND_SQL = """
with l as (
  select rec_id, book_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no
  from metadata where book_id is not null and text is not null),
k as (
  select rec_id, book_id, line_no, regexp_replace(line, '[\\s\\p{Nd}\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]', '', 'g') as key from l),
g as (
  select book_id, key from k where length(regexp_replace(key, '\\P{L}', '', 'g')) >= 8
  group by book_id, key having count(distinct rec_id) >= 5)
select rec_id, cast(line_no as integer) as line_no from k join g using (book_id, key)
"""
