"""Keyword and vector retrieval for batches of queries, fusion of their lists, and what is read around a hit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.text import keyword_tokens
from quillspark.session import spread

#: Rank constant of the fusion, least cosine, and how much wider than k the lists are.
RANK_CONSTANT, LEAST_COSINE, POOL, RERANKED = 60, 0.1, 5, 3
#: Terms that go to every task at once; larger query sets are done in blocks of this size.
TERM_BLOCK = 20_000
#: Vectors and query vectors that are multiplied at once, and query blocks whose best a task holds before it hands them on.
VECTOR_BLOCK, QUERY_BLOCK, BLOCKS_HELD = 4_096, 1_024, 64


def keyword_hits(texts: DataFrame, key: str, queries: DataFrame) -> DataFrame:
    """query_id, key and score: for each term found 1, and .5 if it stands in the first 100 characters, .25 in the first 500.

    queries has query_id and terms (an array); null and empty terms count for nothing. The different terms of the
    query set go to every task, in blocks of bounded size, and are looked for together in one pass over each text;
    texts with a term are then joined to the queries that ask.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).where("term <> ''")
    terms = asked.select("term").distinct()
    blocks = max(1, -(-terms.count() // TERM_BLOCK))
    lowered = spread(texts.select(key, F.lower("text").alias("text")).where(F.length("text") > 0), key)
    kind = texts.schema[key].dataType.simpleString()
    parts = []
    for block in range(blocks):
        own = [r.term for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()]  # about TERM_BLOCK

        def search(batches: Iterator[pd.DataFrame], own: list[str] = own) -> Iterator[pd.DataFrame]:
            import ahocorasick

            patterns = ahocorasick.Automaton()
            for term in own:
                patterns.add_word(term, term)
            if own:
                patterns.make_automaton()
            for batch in batches:
                rows = []
                for row, text in zip(batch[key], batch["text"], strict=True) if own else ():
                    first: dict[str, int] = {}
                    for end, term in patterns.iter(text):
                        first.setdefault(term, end - len(term) + 2)
                    rows += [(row, term, at) for term, at in first.items()]
                yield pd.DataFrame(rows, columns=[key, "term", "at"])

        parts.append(lowered.mapInPandas(search, f"{key} {kind}, term string, at long"))
    found = reduce(DataFrame.unionByName, parts)
    weight = F.lit(1.0) + F.when(F.col("at") <= 100, 0.5).when(F.col("at") <= 500, 0.25).otherwise(0.0)
    return found.select(key, "term", weight.alias("weight")).join(asked, "term").groupBy("query_id", key).agg(F.sum("weight").alias("score"))


def top(hits: DataFrame, k: int, key: str, by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank, ties to the smaller key."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, column: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Vectors of finite numbers, so many in a row: an array of keys and one of vectors, from wherever they lie."""
    usable = rows.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch[column].map(len)):
                for first in range(0, len(same), size):
                    part = same.iloc[first : first + size]
                    numbers = np.stack(part[column].to_numpy()).astype(np.float64)
                    yield pd.DataFrame({names[0]: [part[key].tolist()], names[1]: [numbers.tobytes()]})

    return usable.select(key, column).mapInPandas(pack, f"{names[0]} array<long>, {names[1]} binary")


def vector_hits(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """query_id, key, score: for each query vector the k of highest cosine, the best of each task first, then of all.

    Vectors that are null, of another length or hold null or unfinished numbers are left out; a zero vector has
    cosine 0. The stated query set meets all rows block by block; neither passes through the driver.
    """
    stored = _blocks(spread(vectors.select(key, column), key), key, column, VECTOR_BLOCK, ("keys", "rows"))
    asked = _blocks(queries.select("query_id", "vector"), "query_id", "vector", QUERY_BLOCK, ("ids", "block"))

    def unit(raw: bytes, n: int) -> np.ndarray:
        rows = np.frombuffer(raw, dtype=np.float64).reshape(n, -1)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple] = {}

        def hand_on() -> Iterator[pd.DataFrame]:
            for ids, keys, cosines in held.values():
                real = keys >= 0
                yield pd.DataFrame({"query_id": np.repeat(ids, keys.shape[1])[real.ravel()], key: keys[real], "score": cosines[real]})
            held.clear()

        for batch in batches:
            for keys, raw, ids, block in zip(batch["keys"], batch["rows"], batch["ids"], batch["block"], strict=True):
                rows, asks = unit(raw, len(keys)), unit(block, len(ids))
                if rows.shape[1] != asks.shape[1]:
                    continue
                name = np.asarray(ids, dtype=np.int64).tobytes()
                before = held.get(name, (None, np.full((len(ids), 0), -1, dtype=np.int64), np.zeros((len(ids), 0))))
                cosine = np.concatenate((before[2], np.round(asks @ rows.T, decimals)), axis=1)
                every = np.concatenate((before[1], np.broadcast_to(np.asarray(keys, dtype=np.int64), (len(ids), len(keys)))), axis=1)
                near = np.lexsort((every, -cosine), axis=1)[:, :k]  # ties fall to the smaller key
                held[name] = (np.asarray(ids), np.take_along_axis(every, near, axis=1), np.take_along_axis(cosine, near, axis=1))
            if len(held) >= BLOCKS_HELD:
                yield from hand_on()
        yield from hand_on()

    both = stored.join(asked, how="cross")  # blocks, not rows
    return top(both.mapInPandas(best, f"query_id long, {key} long, score double"), k, key)


def above(hits: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """Ranked first, cut by cosine afterwards."""
    return hits.where(F.col("score") > least).withColumn("score", F.bround("score", 4))


def fuse(lists: DataFrame, key: str) -> DataFrame:
    """query_id, key, score and first of ranked lists (query_id, list_no, rank, key): reciprocal ranks are added."""
    return lists.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))


def best_of_group(hits: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The best hit of each group, best groups first; hits without a group fill up what is missing to k, in their order."""
    named = hits.where((F.col(group).isNotNull()) & (F.col(group) != ""))
    best = named.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.desc("score"), key))).where("_n = 1").drop("_n").withColumn("tier", F.lit(0))
    nameless = hits.where((F.col(group).isNull()) | (F.col(group) == "")).withColumn("tier", F.lit(1))
    both = best.unionByName(nameless)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", F.desc("score"), key))
    return both.withColumn("place", place).where(F.col("place") <= k)


def fused_or_single(lists: DataFrame, key: str) -> DataFrame:
    """query_id, key, score and rank of each query's ranked lists (query_id, list_no, rank, key, score).

    Several lists are fused, with scores rounded to six places and ties in the order first seen; a query with one list
    only keeps its order and scores. Also mode: how many lists of which kind a query had is the caller's to say.
    """
    several = F.size(F.collect_set("list_no").over(Window.partitionBy("query_id"))) > 1
    marked = lists.withColumn("several", several)
    merged = marked.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (RANK_CONSTANT + F.col("rank"))).alias("sum"), F.min(F.struct("list_no", "rank")).alias("first"), F.max("score").alias("own"), F.max("several").alias("several"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("several"), F.round("sum", 12))), "first")
    return merged.select("query_id", key, F.when(F.col("several"), F.round("sum", 6)).otherwise(F.col("own")).alias("score"), F.row_number().over(order).alias("rank"))


def rerank(hits: DataFrame, question: str, text: str, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Hits (query_id, rank, score) in the order of a scorer's score, rounded to four places; ties keep their order.

    scorer is any expression of question and text, such as a pandas_udf over a model. Where it gives null for a hit of
    a query, as a model that failed does, this query's hits stay as they are.
    """
    scored = hits.withColumn("_new", F.bround(scorer(F.col(question), F.col(text)), 4))
    whole = Window.partitionBy("query_id")
    failed = F.max(F.col("_new").isNull()).over(whole)
    scored = scored.withColumn("_failed", failed)
    order = F.row_number().over(whole.orderBy(F.desc(F.when(~F.col("_failed"), F.col("_new"))), "rank"))
    return scored.withColumn("_rank", order).withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_new"))).withColumn("rank", F.col("_rank")).drop("_new", "_failed", "_rank")


def shared_characters(question: Column, text: Column) -> Column:
    """A stand-in scorer: the share of the question's different characters that the text has."""
    chars = F.array_distinct(F.filter(F.split(question, ""), lambda c: c != ""))
    return F.when(F.size(chars) > 0, F.size(F.filter(chars, lambda c: F.contains(text, c))) / F.size(chars)).otherwise(F.lit(0.0))


def query_lists(queries: DataFrame, records: DataFrame, key: str, pool: int, encode: Callable[[Column], Column] | None) -> DataFrame:
    """Ranked lists of each of a question's queries (query_id, query_no, query): by vectors first, then by keywords.

    Without an encoder there are keyword lists only. Needs key and text of records.
    """
    named = queries.select("query_id", "query_no", "query", (F.col("query_id") * 16 + F.col("query_no")).alias("sub"))
    words = top(keyword_hits(records, key, named.select(F.col("sub").alias("query_id"), keyword_tokens("query").alias("terms"))), pool, key).select("query_id", key, "score", "rank", F.lit(100).alias("kind"))
    if encode:
        coded = records.where("text is not null").select(key, encode(F.col("text")).alias("embedding"))
        near = above(vector_hits(coded, key, "embedding", named.select(F.col("sub").alias("query_id"), encode(F.col("query")).alias("vector")), pool))
        words = near.select("query_id", key, "score", "rank", F.lit(0).alias("kind")).unionByName(words)
    return words.select(F.floor(F.col("query_id") / 16).alias("query_id"), (F.pmod("query_id", F.lit(16)) + F.col("kind")).cast("int").alias("list_no"), "rank", key, "score")


def retrieve_multi(queries: DataFrame, records: DataFrame, key: str, k: int, encode: Callable[[Column], Column] | None = None, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, place, key, chapter and score of the k best chapters of each question, from all its queries' lists.

    queries has query_id, query_no (0 is the question itself, at most 15) and query; records has key, text and chapter.
    Each query is searched to 5k; what is fused is cut to 3k, reranked if a scorer is given, and each chapter stands
    with its best record. Blank questions and questions without a hit have no row.
    """
    lists = query_lists(queries.where(F.trim("query") != ""), records, key, POOL * k, encode)
    pool = fused_or_single(lists, key).where(F.col("rank") <= RERANKED * k).join(records.select(key, "chapter", "text"), key)
    if scorer:
        own = queries.where("query_no = 0").select("query_id", F.col("query").alias("question"))
        pool = rerank(pool.join(own, "query_id"), "question", "text", scorer)
    return best_of_group(pool.select("query_id", key, "chapter", "score", "rank"), "chapter", "rank", k).select("query_id", "place", key, "chapter", "score")


def retrieval_status(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """query_id, queries, and the mode of fusion: both, vectors or keywords only, and how many lists there were."""
    asked = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("queries"))
    kinds = lists.groupBy("query_id").agg(F.count_distinct("list_no").alias("lists"), F.max((F.col("list_no") < 100).cast("int")).alias("v"), F.max((F.col("list_no") >= 100).cast("int")).alias("w"))
    mode = F.when((F.col("v") == 1) & (F.col("w") == 1), "both").when(F.col("v") == 1, "vectors").when(F.col("w") == 1, "keywords").otherwise("none")
    return asked.join(kinds, "query_id", "left").select("query_id", "queries", F.coalesce("lists", F.lit(0)).cast("long").alias("lists"), mode.alias("mode"))


def expand(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """query_id, kind, id and book_id of hits, then for each its parent, the chunk before and the one after, each once.

    hits needs query_id, place, book_id, chunk_id; chunks book_id, chapter_id, chunk_id, parent_id; one row a chunk.
    """
    own = hits.select("query_id", "place", "book_id", "chunk_id").join(chunks.select("book_id", "chunk_id", "chapter_id", "parent_id"), ["book_id", "chunk_id"])
    here = own.select("query_id", "book_id", F.lit("hit").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.lit(0).alias("tier"), "place", F.lit(0).alias("step"))
    above_ = own.join(parents.select("book_id", "parent_id"), ["book_id", "parent_id"]).select("query_id", "book_id", F.lit("parent").alias("kind"), F.col("parent_id").alias("id"), F.lit(1).alias("tier"), "place", F.lit(1).alias("step"))
    beside = own.select("query_id", "place", "book_id", "chapter_id", F.explode(F.array(F.struct((F.col("chunk_id") - 1).alias("id"), F.lit(2).alias("step")), F.struct((F.col("chunk_id") + 1).alias("id"), F.lit(3).alias("step")))).alias("n"))
    near = beside.select("query_id", "place", "book_id", "chapter_id", F.col("n.id").alias("chunk_id"), F.col("n.step").alias("step")).join(chunks.select("book_id", "chapter_id", "chunk_id"), ["book_id", "chapter_id", "chunk_id"])
    near = near.select("query_id", "book_id", F.lit("neighbor").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.lit(1).alias("tier"), "place", "step")
    every = here.unionByName(above_).unionByName(near).withColumn("space", F.when(F.col("kind") == "parent", "p").otherwise("c"))
    first = F.row_number().over(Window.partitionBy("query_id", "book_id", "space", "id").orderBy("tier", "place", "step"))
    kept = every.withColumn("_n", first).where("_n = 1")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "place", "step", "id"))
    return kept.select("query_id", "book_id", "kind", "id", order.alias("ord"))


def context_text(hits: DataFrame, chapter: str, text: str, order: str) -> DataFrame:
    """query_id and one text of its few hits in order, each under its source."""
    block = F.concat(F.lit("[来源:"), F.coalesce(chapter, F.lit("")), F.lit("]\n"), text)
    listed = hits.select("query_id", F.struct(F.col(order).alias("o"), block.alias("b")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("query_id", F.array_join(F.col("x.b"), "\n\n---\n\n").alias("context"))


#: How hits, parents and neighbours are headed.
LABELS = {"hit": "来源", "parent": "父块", "neighbor": "邻居"}


def expanded_context(hits: DataFrame) -> DataFrame:
    """query_id and one text of expanded hits (query_id, ord, chapter, kind, text), by chapter in the order first seen.

    Within a chapter hits stand before parents before neighbours; a text that another holds is left out, and one that
    holds an earlier text takes its place. Empty texts are left out. A query's hits are few.
    """
    tier = F.when(F.col("kind") == "hit", 0).when(F.col("kind") == "parent", 1).otherwise(2)
    named = hits.where("text <> ''").select("query_id", F.when(F.col("chapter") != "", F.col("chapter")).otherwise("未知").alias("chapter"), F.struct(tier.alias("tier"), "ord", "kind", "text").alias("x"))
    bucket = named.groupBy("query_id", "chapter").agg(F.min("x.ord").alias("seen"), F.array_sort(F.collect_list("x")).alias("items"))
    none = F.array().cast("array<struct<kind:string,text:string>>")

    def keep(kept: Column, item: Column) -> Column:
        overlaps = F.transform(kept, lambda k: F.contains(k["text"], item["text"]) | F.contains(item["text"], k["text"]))
        place = F.array_position(overlaps, True)
        own = F.struct(item["kind"].alias("kind"), item["text"].alias("text"))
        put = F.transform(kept, lambda k, i: F.when((i + 1 == place) & (F.length(item["text"]) > F.length(k["text"])), own).otherwise(k))
        return F.when(place == 0, F.concat(kept, F.array(own))).otherwise(put)

    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    kept = F.aggregate("items", none, keep)
    block = F.array_join(F.transform(kept, lambda k: F.concat(F.lit("["), label[k["kind"]], F.lit(":"), F.col("chapter"), F.lit("]\n"), k["text"])), "\n\n")
    blocks = bucket.select("query_id", F.struct("seen", block.alias("block")).alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return blocks.select("query_id", F.array_join(F.col("b.block"), "\n\n---\n\n").alias("context"))


def hash_encode(text: Column, dimensions: int = 64, unit: bool = True) -> Column:
    """A stand-in encoder: counts of characters by code modulo the dimensions, of unit length if wanted."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            v = np.bincount(codes % dimensions, minlength=dimensions).astype(np.float32)
            if not v.any():
                v[0] = 1
            out.append(v / np.linalg.norm(v) if unit else v)
        return pd.Series(out)

    return encode(text)
