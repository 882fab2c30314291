"""Table functions from texts to chunks, and what hangs on chunks: ids, links, prefixes, parents, statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import estimate_tokens, strip
from quillspark.operators import splitters
from quillspark.operators.structure import chapter_bodies, chapter_hash, parse_structure, scene_summary, with_scenes
from quillspark.session import spread

PARENT_LEAST, PARENT_MOST, PARENT_MEMBERS = 800, 1500, 4


def cut_texts(texts: DataFrame, keys: list[str], cut: Callable[[str], list[tuple[int, int]]], text: str = "text", scanned: bool = True) -> DataFrame:
    """keys, chunk_no (from 1), start, end and chunk of each text by a function of one text; null texts have no row.

    scanned says that the texts come from a scan, whose partitions may be too few; after a shuffle they aren't.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                whole = row[-1]
                rows += [(*row[:-1], no, a, b, whole[a:b]) for no, (a, b) in enumerate(cut(whole), 1)]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_no", "start", "end", "chunk"])

    chosen = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return (spread(chosen, *keys) if scanned else chosen).mapInPandas(run, f"{kinds}, chunk_no int, start int, end int, chunk string")


def chunk_fixed(texts: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """Windows of one size, natively."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / F.lit(step)) - 1).cast("int")
    placed = texts.where(F.length("text") > 0).select(key, "text", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    return placed.select(key, (F.col("no") + 1).alias("chunk_no"), F.substring("text", F.col("no") * step + 1, F.lit(size)).alias("chunk"))


def chunk_recursive(texts: DataFrame, keys: list[str], spec: splitters.Spec | None = None, targeted: bool = False) -> DataFrame:
    s = spec or splitters.Spec()
    return cut_texts(texts, keys, lambda t: splitters.recursive(t, s.min_chars, s.max_chars, s.overlap_chars, s.target_chars if targeted else None, s.overlap_ratio if targeted else None))


def chunk_tokenwise(texts: DataFrame, keys: list[str], spec: splitters.Spec | None = None, scanned: bool = True) -> DataFrame:
    s = spec or splitters.Spec()
    return cut_texts(texts, keys, lambda t: splitters.Cutter(t, s).chunks(), scanned=scanned).withColumn("chunk", strip("chunk"))


def with_last_sentences(chunks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each chunk with the last n sentences of the one before it in front."""
    before = F.lag("chunk").over(Window.partitionBy(*keys).orderBy("chunk_no"))
    sentences = F.filter(F.split(before, "(?<=[。！？!?])"), lambda s: s != "")
    tail = F.when(F.size(sentences) > 0, F.array_join(F.slice(sentences, F.greatest(-F.size(sentences), F.lit(-n)), F.lit(n)), "")).otherwise("")
    return chunks.withColumn("chunk", F.concat(F.coalesce(tail, F.lit("")), "chunk"))


def prefix(book: Column, chapter: Column, summary: Column) -> Column:
    """《book》 chapter｜summary and a line break; parts that are null or empty are left out."""
    some = lambda c: F.when(c != "", c)
    title = F.when(some(book).isNotNull(), F.concat(F.lit("《"), book, F.lit("》")))
    rest = F.concat_ws("｜", some(chapter), some(summary))
    text = F.concat_ws(" ", title, some(rest))
    return F.when(text != "", F.concat(text, F.lit("\n"))).otherwise("")


def build_chunks(documents: DataFrame, key: str = "doc_id", spec: splitters.Spec | None = None) -> DataFrame:
    """Chunk records of every document: ids by chapter and document, links, scene, prefix, sizes and parent.

    Everything is found inside a document's own row. documents may have book_title. A parent is named by its document
    and its first chunk.
    """
    s = spec or splitters.Spec()
    titled = documents if "book_title" in documents.columns else documents.withColumn("book_title", F.lit(None).cast("string"))

    @F.pandas_udf("array<array<int>>")
    def cut(documents_: pd.Series) -> pd.Series:
        return pd.Series([[[place for ends in splitters.Cutter(text, s).chunks() for place in ends] for text in texts] for texts in documents_])

    parsed = chapter_bodies(titled, key, "book_title").withColumn("cuts", cut(F.transform("bodies", lambda c: c["text"])))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("got"))
    before = F.aggregate("cuts", start, lambda st, c: F.struct((st["n"] + (F.size(c) / 2).cast("int")).alias("n"), F.concat(st["got"], F.array(st["n"])).alias("got")), lambda st: st["got"])
    parsed = parsed.withColumn("before", before)
    each = parsed.select(key, "book_title", "begins", "cuts", "before", F.posexplode("bodies").alias("no", "c"))
    chapters = each.select(key, "book_title", F.concat(F.lit("c"), F.col("no") + 1).alias("chapter_id"), F.col("c.title").alias("title"), F.col("c.text").alias("text"), F.get("begins", "no").alias("chapter_start"), F.get("cuts", "no").alias("cut"), F.get("before", "no").alias("before"))
    found = with_scenes(chapters.where(F.size("cut") > 0)).withColumn("n", (F.size("cut") / 2).cast("int")).withColumn("hash", chapter_hash("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.get("cut", i * 2).alias("a"), F.get("cut", i * 2 + 1).alias("b"), strip(F.substring("text", F.get("cut", i * 2) + 1, F.get("cut", i * 2 + 1) - F.get("cut", i * 2))).alias("chunk")))
    found = found.withColumn("pieces", pieces).withColumn("sizes", parent_sizes(F.transform("pieces", lambda p: F.length(p["chunk"]))))
    firsts = F.aggregate("sizes", start, lambda st, n: F.struct((st["n"] + n).alias("n"), F.concat(st["got"], F.array(st["n"])).alias("got")), lambda st: st["got"])
    placed = found.withColumn("firsts", firsts).select(key, "book_title", "chapter_id", "title", "hash", "chapter_start", "before", "n", "scenes", "firsts", F.explode("pieces").alias("p"))
    upto = F.filter("scenes", lambda x: x["start"] <= F.col("p.a"))
    placed = placed.withColumn("scene", F.coalesce(F.get(upto, F.size(upto) - 1), F.get("scenes", 0))).withColumn("summary", scene_summary("scene.text")).withColumn("chunk_id", F.col("before") + F.col("p.i") + 1)
    placed = placed.withColumn("prefix", prefix(F.col("book_title"), F.col("title"), F.col("summary"))).withColumn("first", F.array_max(F.filter("firsts", lambda f: f <= F.col("p.i"))))
    return placed.select(
        key, "book_title", "chapter_id", F.col("title").alias("chapter"), F.col("hash").alias("chapter_hash"), F.concat("chapter_id", F.lit("_s"), F.col("scene.scene_no")).alias("scene_id"), F.col("summary").alias("scene_summary"),
        (F.col("p.i") + 1).alias("chunk_index"), "chunk_id", F.col("p.chunk").alias("text"), "prefix",
        F.length("p.chunk").alias("chunk_length"), estimate_tokens("p.chunk").alias("token_count"), estimate_tokens(F.concat("prefix", "p.chunk")).alias("total_token_count"), (F.col("chapter_start") + F.col("p.a")).alias("start_pos"), (F.col("chapter_start") + F.col("p.b")).alias("end_pos"),
        F.when(F.col("p.i") > 0, F.col("chunk_id") - 1).alias("prev_chunk_id"), F.when(F.col("p.i") + 1 < F.col("n"), F.col("chunk_id") + 1).alias("next_chunk_id"),
        F.concat(F.col(key).cast("string"), F.lit("_p"), F.col("before") + F.col("first") + 1).alias("parent_id"),
    )


def chunk_by_chapter(documents: DataFrame, key: str = "doc_id", spec: splitters.Spec | None = None) -> DataFrame:
    """key, chapter_id, chunk_no, start, end and chunk: each chapter's body cut on its own; a text without headings is one chapter."""
    s = spec or splitters.Spec()
    bodies = parse_structure(documents, key).select(key, "chapter_id", "text")
    return cut_texts(bodies, [key, "chapter_id"], lambda t: splitters.recursive(t, s.min_chars, s.max_chars, s.overlap_chars), scanned=False)


def parent_sizes(lengths: Column, least: int = PARENT_LEAST, most: int = PARENT_MOST, members: int = PARENT_MEMBERS) -> Column:
    """How many neighbours each parent takes: up to four, until the least length is reached, never over the most.

    A last parent that fits into the one before it is put there.
    """
    kind = "struct<sizes:array<int>,sums:array<bigint>,n:int,t:bigint>"
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("sizes"), none.cast("array<bigint>").alias("sums"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("t")).cast(kind)

    def add(state: Column, x: Column) -> Column:
        full = (state["n"] > 0) & ((state["n"] >= members) | (state["t"] + x > most) | ((state["t"] >= least) & (state["n"] >= 2)))
        closed = F.struct(F.concat(state["sizes"], F.array(state["n"])), F.concat(state["sums"], F.array(state["t"])), F.lit(1), x.cast("bigint")).cast(kind)
        opened = F.struct(state["sizes"], state["sums"], state["n"] + 1, state["t"] + x).cast(kind)
        return F.when(full, closed).otherwise(opened)

    def finish(state: Column) -> Column:
        sizes, sums = F.concat(state["sizes"], F.array(state["n"])), F.concat(state["sums"], F.array(state["t"]))
        k = F.size(sizes)
        last, before = F.get(sizes, k - 1), F.get(sizes, k - 2)
        joined = (k >= 2) & (last + before <= members) & (F.get(sums, k - 1) + F.get(sums, k - 2) <= most)
        return F.when(state["n"] == 0, none).when(joined, F.concat(F.slice(sizes, F.lit(1), F.greatest(k - 2, F.lit(0))), F.array(last + before))).otherwise(sizes)

    return F.aggregate(lengths, start, add, finish)


def build_parents(chunks: DataFrame, keys: list[str], chunk_id: str = "chunk_id", length: str = "chunk_length") -> DataFrame:
    """keys, parent_no, child_chunk_ids, child_count and chunk_length of runs of neighbouring chunks of a chapter."""
    ordered = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk_id).alias("id"), F.coalesce(F.col(length), F.lit(0)).alias("size")))).alias("c"))
    sized = ordered.withColumn("sizes", parent_sizes(F.col("c.size")))
    placed = sized.select(*keys, "c", "sizes", F.posexplode("sizes").alias("at", "child_count"))
    begin = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda s, x: s + x)
    members = F.slice("c", begin + 1, F.col("child_count"))
    total = F.aggregate(members, F.lit(0).cast("bigint"), lambda s, m: s + m["size"])
    return placed.select(*keys, (F.col("at") + 1).alias("parent_no"), F.transform(members, lambda m: m["id"]).alias("child_chunk_ids"), "child_count", total.alias("chunk_length"))
