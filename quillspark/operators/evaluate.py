"""Judging ranked lists, profiles and checks of question sets, and making questions from chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.grams import MOST, gram_of, number_of, numbered_grams, sentences_of
from quillspark.functions.text import WS, cut_into_sentences, grams_of, han_runs, squeeze, strip
from quillspark.operators import retrieval as R
from quillspark.operators.context import grams
from quillspark.operators.structure import chapter_number

#: Words that stand for a person without a name, longest first.
META_TERMS = ["男主人公", "女主人公", "主角团", "男一号", "女一号", "主人公", "男主角", "女主角", "男主", "女主", "主角", "男配", "女配", "反派"]
#: What the last part of a name says of its kind.
KINDS = {
    "place": "山|峰|谷|城|殿|洞|海|域|界|矿|原|宫|岛|州|渊|冢|禁地|坟|岭|湖|泽|镇|村|寨",
    "item": "经|诀|拳|术|功|宝|剑|刀|鼎|珠|钟|印|旗|塔|镜|扇|网|图|阵|符|冠|杖|枪|弓|铃|盘|书|典|法|甲|衣",
    "faction": "族|家|教|门|宗|阁|盟|圣地|世家|派",
}


def same_chapter(found: Column, wanted: Column) -> Column:
    """Equal, or equal in the first four characters of a name that long."""
    return (wanted != "") & ((found == wanted) | ((F.length(wanted) >= 4) & (F.left(found, F.lit(4)) == F.left(wanted, F.lit(4)))))


def judge(hits: DataFrame, gold: DataFrame, matches: Column) -> DataFrame:
    """query_id and the rank of its first match (null if none), for every query of gold."""
    first = hits.join(gold, "query_id").where(matches).groupBy("query_id").agg(F.min("rank").alias("first"))
    return gold.select("query_id").join(first, "query_id", "left")


def recall_and_mrr(judged: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of queries with a match among the first k, and the mean reciprocal rank of the first match."""
    at = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *at, F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def distinct_in_order(hits: DataFrame, group: str) -> DataFrame:
    """Each group once for a query, at its first rank, ranked anew."""
    firsts = hits.groupBy("query_id", group).agg(F.min("rank").alias("old"))
    return firsts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("old"))).drop("old")


def coverage(anchor: Column, text: Column) -> Column:
    """Share of the anchor that is found in the text in order, up to its first character that isn't found any more."""
    chars = F.filter(F.split(anchor, ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        place = F.when(s["at"] > 0, F.call_function("locate", c, text, s["at"])).otherwise(F.lit(0))
        return F.when(place > 0, F.struct((place + 1).alias("at"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(0).alias("at"), s["n"].alias("n")))

    return F.when(F.length(anchor) > 0, F.aggregate(chars, start, step, lambda s: s["n"] / F.length(anchor))).otherwise(F.lit(0.0))


def meta_terms(question: Column) -> Column:
    """Terms found in a question, longest first, without those that an earlier one holds."""
    terms = F.filter(F.array(*[F.lit(t) for t in META_TERMS]), lambda t: F.contains(question, t))
    return F.aggregate(terms, F.array().cast("array<string>"), lambda got, t: F.when(F.exists(got, lambda g: F.contains(g, t)), got).otherwise(F.concat(got, F.array(t))))


def merge_queries(question: Column, others: Column, most: int = 3) -> Column:
    """The question and up to three others, trimmed, without blanks and repeats."""
    listed = F.transform(F.concat(F.array(question), F.coalesce(others, F.array().cast("array<string>"))), strip)
    return F.slice(F.array_distinct(F.filter(listed, lambda x: x.isNotNull() & (x != ""))), F.lit(1), F.lit(most + 1))


def kind_of(name: Column) -> Column:
    out = F.lit("person")
    for kind, endings in reversed(KINDS.items()):
        out = F.when(name.rlike(endings), kind).otherwise(out)
    return out


def _placed_grams(chars: str, size: int) -> Column:
    return F.transform(grams_of(F.col(chars), size), lambda g, i: F.struct(i.alias("at"), F.lit(size).alias("size"), g.alias("gram")))


def question_entities(questions: DataFrame, terms: DataFrame, sizes: tuple[int, ...] = (2, 3), most: int = 3) -> DataFrame:
    """query_id and entities of questions (query_id, question): terms (gram) found from left to right, the longest at each place.

    Longer ones first, then in order of appearance, each once. Questions without a term have no row.
    """
    runs = questions.select("query_id", F.posexplode(han_runs("question", min(sizes))).alias("run", "chars"))
    each = runs.select("query_id", "run", F.explode(F.concat(*[_placed_grams("chars", n) for n in sizes])).alias("g")).select("query_id", "run", "g.*")
    known = each.join(terms.select("gram").distinct(), "gram", "left_semi")
    listed = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("run", "at", (-F.col("size")).alias("n"), "gram"))).alias("l"))
    start = F.struct(F.lit(-1).alias("run"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("got"))
    taken = F.aggregate("l", start, lambda s, e: F.when((e["run"] != s["run"]) | (e["at"] >= s["end"]), F.struct(e["run"].alias("run"), (e["at"] - e["n"]).alias("end"), F.concat(s["got"], F.array(e["gram"])).alias("got"))).otherwise(s), lambda s: s["got"])
    ordered = F.array_sort(F.transform(F.array_distinct(taken), lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return listed.select("query_id", F.slice(ordered["w"], F.lit(1), F.lit(most)).alias("entities"))


def leading_terms(answers: DataFrame, terms: DataFrame, most: int = 3) -> DataFrame:
    """query_id and its answer's most frequent terms (gram, n): two characters before three where they tie, then the earlier."""
    runs = answers.select("query_id", F.posexplode(han_runs("answer", 2)).alias("run", "chars"))
    each = runs.select("query_id", "run", F.explode(F.concat(*[_placed_grams("chars", n) for n in (2, 3)])).alias("g")).select("query_id", "run", "g.*")
    first = each.groupBy("query_id", "gram").agg(F.min(F.struct("size", "run", "at")).alias("first")).join(terms.select("gram", "n"), "gram")
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "gram"))).alias("l"))
    return listed.select("query_id", F.slice(listed["l"]["gram"], F.lit(1), F.lit(most)).alias("terms"))


#: Share of an answer that a text has to hold in order, and how many of its leading terms.
ANCHORED, LEADING_HELD = 0.85, 2


def auto_judge(hits: DataFrame, answers: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits (query_id, rank, chapter, text) with what holds of answers (query_id, answer, gold_chapter): chapter, anchor, keyword, any.

    any is anchor or keyword. A text holds the answer's anchor if it has its characters in order, white space aside.
    """
    marked = hits.join(answers, "query_id").join(leading_terms(answers, terms).withColumnRenamed("terms", "leading"), "query_id", "left")
    bare = squeeze("text")
    anchor = coverage(squeeze("answer"), bare) >= ANCHORED
    held = F.coalesce(F.size(F.filter("leading", lambda t: F.contains(bare, t))) >= LEADING_HELD, F.lit(False))
    chapter = F.coalesce(same_chapter(F.col("chapter"), F.col("gold_chapter")), F.lit(False))
    return marked.select("query_id", "rank", chapter.alias("chapter"), anchor.alias("anchor"), held.alias("keyword"), (anchor | held).alias("any"))


def judged_shares(judged: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """k and, for each kind of hit, the number of queries with one among the first k."""
    kinds = ("chapter", "anchor", "keyword", "any")
    each = judged.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    once = each.groupBy("k", "query_id").agg(*[F.max(F.col(c).cast("long")).alias(c) for c in kinds])
    return once.groupBy("k").agg(*[F.sum(c).alias(c) for c in kinds])


#: Configurations that are compared: name, top k, reranked, with the question's entities as further queries.
CONFIGS = [("baseline_top5", 5, False, False), ("top50", 50, False, False), ("top100", 100, False, False), ("rerank_top5", 5, True, False), ("rerank_top20", 20, True, False), ("entity_top5", 5, False, True), ("entity_rerank_top20", 20, True, True)]


def compare_configs(lists: DataFrame, questions: DataFrame, records: DataFrame, key: str, scorer, configs=CONFIGS) -> DataFrame:
    """query_id, config, rank and chapter of each configuration's hits.

    lists (query_id, list_no, rank, key, score) go as deep as the widest configuration and have the question's own lists
    as 0 and 100; questions has query_id and question; records key, chapter and text.
    """
    spark = lists.sparkSession
    named = F.broadcast(spark.createDataFrame([(n, *c) for n, c in enumerate(configs)], "config_no int, config string, top_k int, reranked boolean, with_entities boolean"))  # a few rows
    of_config = lists.crossJoin(named).where((F.col("with_entities") | (F.col("list_no") % 100 == 0)) & (F.col("rank") <= R.POOL * F.col("top_k")))
    fused = R.fused_or_single(of_config.select((F.col("query_id") * 16 + F.col("config_no")).alias("query_id"), "list_no", "rank", key, "score"), key)
    own = fused.withColumn("config_no", F.pmod("query_id", F.lit(16)).cast("int")).join(named, "config_no").where(F.col("rank") <= R.RERANKED * F.col("top_k"))
    asked = questions.select(F.col("query_id").alias("asked"), "question")
    pool = own.withColumn("asked", F.floor(F.col("query_id") / 16)).join(asked, "asked").join(records.select(key, "chapter", "text"), key)
    sorted_ = R.rerank(pool.withColumn("question", F.when(F.col("reranked"), F.col("question"))), "question", "text", lambda q, t: F.when(q.isNotNull(), scorer(q, t)))
    best = R.best_of_group(sorted_, "chapter", "rank", max(c[1] for c in configs)).where(F.col("place") <= F.col("top_k"))
    return best.select(F.col("asked").alias("query_id"), "config", F.col("place").alias("rank"), "chapter")


def chapter_metrics(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """by, query_id, first (rank of the first hit with the gold chapter's number) and first_distinct (its place among different numbers)."""
    numbered = hits.withColumn("number", chapter_number("chapter")).where("number is not null")
    firsts = numbered.groupBy(*by, "query_id", "number").agg(F.min("rank").alias("first"))
    placed = firsts.withColumn("first_distinct", F.row_number().over(Window.partitionBy(*by, "query_id").orderBy("first")))
    wanted = gold.select("query_id", chapter_number("gold_chapter").alias("number")).where("number is not null")
    return placed.join(wanted, ["query_id", "number"]).select(*by, "query_id", "first", "first_distinct")


#: The words a question ends with for each kind of entity.
TAILS = {"place": "这是在哪里？", "item": "这是什么东西？", "faction": "这是哪个势力？", "person": "这个人是谁？"}
LEAST_LOCAL, MOST_CHAPTERS = 25, 15


#: Characters and grams that a task works on at once.
CHARACTERS_AT_ONCE, GRAMS_AT_ONCE = 1_000_000, 3_000_000


def _count_by_chapter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """number, n and span of the grams of chapters that come one after another; a gram may have several rows."""
    every: list[np.ndarray] = []
    once: list[np.ndarray] = []
    held: list[str] = []
    seen, key, size, waiting = np.zeros(0, dtype=np.int64), None, 0, 0

    def take(text: str, most: int, goes_on: bool) -> None:
        """seen has what was counted of a chapter that is too long to be worked on at once."""
        nonlocal seen, waiting
        numbers, places, _ = numbered_grams(text)
        numbers = np.sort(numbers[places < most])
        new = different = numbers[np.flatnonzero(np.diff(numbers, prepend=-1))]
        if len(seen):
            new = np.setdiff1d(different, seen, assume_unique=True)
        seen = np.union1d(seen, new) if goes_on else seen[:0]
        every.append(numbers)
        once.append(new)
        waiting += len(numbers)

    def flush() -> pd.DataFrame:
        nonlocal waiting
        number, n = np.unique(np.concatenate(every), return_counts=True)
        some, chapters = np.unique(np.concatenate(once), return_counts=True)
        span = np.zeros(len(number), dtype=np.int64)
        span[np.searchsorted(number, some)] = chapters
        every.clear()
        once.clear()
        waiting = 0
        return pd.DataFrame({"number": number, "n": n, "span": span})

    for batch in batches:
        for book, chapter, text in zip(batch["book_id"], batch["chapter_id"], batch["text"], strict=True):
            if (book, chapter) != key:
                take("\n".join(held), size + len(held), False)
                key, size = (book, chapter), 0
                held.clear()
            for start in range(0, len(text), CHARACTERS_AT_ONCE) if len(text) > CHARACTERS_AT_ONCE else ():
                take(text[start : start + CHARACTERS_AT_ONCE + MOST - 1], CHARACTERS_AT_ONCE, True)
                if waiting >= GRAMS_AT_ONCE:
                    yield flush()
            if len(text) <= CHARACTERS_AT_ONCE:
                held.append(text)
                size += len(text)
            if size >= CHARACTERS_AT_ONCE:
                take("\n".join(held), size + len(held), True)
                size = 0
                held.clear()
            if waiting >= GRAMS_AT_ONCE:
                yield flush()
    take("\n".join(held), size + len(held), False)
    yield flush()


def local_terms(records: DataFrame, least: int = LEAST_LOCAL, most: int = MOST_CHAPTERS) -> DataFrame:
    """gram, n and span of grams of two to four characters that occur often in few chapters (of a book).

    Texts are brought together by chapter, so that a task counts its chapters' grams as numbers and hands on one row a
    gram. A chapter longer than what is worked on at once keeps its different grams in memory, 8 bytes each.
    """
    texts = records.select("book_id", "chapter_id", "text").where("text is not null").repartition("book_id", "chapter_id").sortWithinPartitions("book_id", "chapter_id")
    each = texts.mapInPandas(_count_by_chapter, "number long, n long, span long")
    whole = each.groupBy("number").agg(F.sum("n").alias("n"), F.sum("span").alias("span")).where((F.col("n") >= least) & (F.col("span") <= most))
    return whole.select(gram_of(F.col("number")).alias("gram"), "n", "span")


#: Places of the table that says which grams may be local terms: a prime, about half a megabyte of bits.
TERM_PLACES = 4_194_301
SHORTEST, LONGEST = 15, 80


def _may_be_terms(terms: DataFrame):
    """A table of fixed size, broadcast: the places of the terms' numbers."""
    places = np.asarray(terms.select(F.pmod(number_of("gram"), F.lit(TERM_PLACES)).cast("int").alias("place")).distinct().toArrow()["place"])
    table = np.zeros(TERM_PLACES + 1, dtype=bool)
    table[places] = True
    return terms.sparkSession.sparkContext.broadcast(np.packbits(table))


def natural_questions(records: DataFrame, terms: DataFrame) -> DataFrame:
    """rec_id, chapter, at, question, entity, kind and evidence: the sentence beside one with a local term asks for it.

    A sentence of 15 to 80 characters is asked for by its term of most n * length^2 / span, ties to the larger term. The
    sentence before it leads, else the one after: 12 to 70 characters without the term. Each chapter and each term
    once, at the earliest record: the first of each chapter is taken before the first of each term. Needs a unique rec_id.

    Only grams whose place in a table of fixed size is a term's leave the tasks, without their texts.
    """
    shared = _may_be_terms(terms)
    records = records.where("chapter <> '' and text is not null")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe = np.unpackbits(shared.value, count=TERM_PLACES).astype(bool)
        for batch in batches:
            every = [(rec, at, s) for rec, text in zip(batch["rec_id"], batch["text"], strict=True) for at, s in enumerate(sentences_of(text)) if SHORTEST <= len(s) <= LONGEST]
            whole = "\n".join(s for _, _, s in every)
            starts = np.cumsum([0] + [len(s) + 1 for _, _, s in every])
            numbers, places, sizes = numbered_grams(whole)
            kept = np.flatnonzero(maybe[numbers % TERM_PLACES])
            owner = np.searchsorted(starts, places[kept], "right") - 1
            found = {(k, whole[place : place + size]) for k, place, size in zip(owner.tolist(), places[kept].tolist(), sizes[kept].tolist(), strict=True)}
            yield pd.DataFrame([(every[k][0], every[k][1], gram) for k, gram in found], columns=["rec_id", "at", "gram"])

    weighed = records.select("rec_id", "text").mapInPandas(find, "rec_id long, at int, gram string").join(terms.hint("merge"), "gram")
    weight = F.col("n") * F.length("gram") * F.length("gram") / F.col("span")
    best = weighed.groupBy("rec_id", "at").agg(F.max(F.struct(weight.alias("w"), "gram")).alias("b"))
    picks = best.groupBy("rec_id").agg(F.collect_list(F.struct("at", F.col("b.gram").alias("entity"))).alias("picks"))
    whole = records.join(picks, "rec_id").select("rec_id", "book_id", "chapter", "picks", cut_into_sentences("text").alias("all"))
    found = whole.select("rec_id", "book_id", "chapter", "all", F.explode("picks").alias("p")).select("rec_id", "book_id", "chapter", "all", "p.at", "p.entity").withColumn("sentence", F.get("all", F.col("at")))
    leads = F.filter(F.array(F.get("all", F.col("at") - 1), F.get("all", F.col("at") + 1)), lambda s: s.isNotNull() & F.length(s).between(12, 70) & ~F.contains(s, F.col("entity")))
    asked = found.where(F.length("sentence").between(SHORTEST, LONGEST)).withColumn("lead", F.get(leads, 0)).where("lead is not null").drop("all").withColumn("kind", kind_of(F.col("entity")))
    tail = F.coalesce(*[F.when(F.col("kind") == k, t) for k, t in TAILS.items()])
    asked = asked.withColumn("question", F.concat(F.regexp_replace("lead", "[，、；：]+$", ""), F.lit("，"), tail)).where(~F.contains("question", F.col("entity")))
    for by in (["book_id", "chapter"], ["entity"]):
        asked = asked.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("rec_id", "at"))).where("_n = 1").drop("_n")
    return asked.select("rec_id", "chapter", "at", "question", "entity", "kind", F.col("sentence").alias("evidence"))


def verification(items: DataFrame, span: DataFrame) -> DataFrame:
    """item_id and each reason against it: items has question, answer and evidence, span has item_id and the chapters its answer is in."""
    marked = items.join(span, "item_id", "left")
    question, answer = F.coalesce(F.trim("question"), F.lit("")), F.coalesce(F.trim("answer"), F.lit(""))
    none = (question == "") | (answer == "")
    rules = {
        "missing": none, "length": ~none & ~F.length(question).between(18, 100), "not in text": ~none & ~F.contains(F.coalesce("evidence", F.lit("")), answer), "in question": ~none & F.contains(question, answer),
        "leaks": ~none & F.exists(grams_of(answer, 3), lambda g: F.contains(question, g)), "everywhere": ~none & (F.coalesce("span", F.lit(0)) > 30),
    }
    flags = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return marked.select("item_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("reason"))


def chapter_truth(items: DataFrame, records: DataFrame, most: int = 1000) -> DataFrame:
    """item_id, truth and where it is from: evidence, else the answer's terms, else the gold chapter's text, else missing.

    The gold chapter is that of the item's book with the same number; of its records only as many as fill the text are
    put together, in the order of rec_id.
    """
    flat = lambda c: strip(F.regexp_replace(c, f"{WS}+", " "))
    own = items.select("item_id", "book_title", chapter_number("gold_chapter").alias("number"), flat("evidence").alias("evidence"), F.when(F.size("answer_terms") > 0, F.array_join("answer_terms", "、")).alias("terms"))
    wanted = own.where("coalesce(evidence, '') = '' and terms is null and number is not null").select("book_title", "number").distinct()
    texts = records.where("text <> ''").select("rec_id", "book_title", chapter_number("chapter").alias("number"), "text").join(wanted, ["book_title", "number"], "left_semi")
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("book_title", "number").orderBy("rec_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = texts.withColumn("before", before).where(F.col("before") < most)
    gold = some.groupBy("book_title", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_id", "text"))), lambda x: x["text"]), "\n").alias("gold"))
    joined = own.join(gold, ["book_title", "number"], "left")
    truth = F.coalesce(F.when(F.col("evidence") != "", F.col("evidence")), F.col("terms"), flat("gold"), F.lit(""))
    source = F.when(F.col("evidence") != "", "evidence").when(F.col("terms").isNotNull(), "terms").when(F.col("gold").isNotNull(), "chapter").otherwise("missing")
    return joined.select("item_id", F.left(truth, F.lit(most)).alias("truth"), source.alias("source"))


def usable_rewrites(rewrites: Column, question: Column) -> Column:
    """entities and queries without those that still hold a word for a person without a name or repeat the question; failed if none is left."""
    meta = "|".join(META_TERMS)
    keep = lambda items: F.filter(items, lambda x: ~x.rlike(meta) & (x != question))
    entities, queries = keep(rewrites["entities"]), keep(rewrites["queries"])
    return F.struct(entities.alias("entities"), queries.alias("queries"), (F.size(F.coalesce(entities, F.array())) + F.size(F.coalesce(queries, F.array())) == 0).alias("failed"))


def ground_truth(items: DataFrame) -> DataFrame:
    """item_id, truth and where it is from: the evidence, else the answer's terms, else missing."""
    terms = F.when(F.size("answer_terms") > 0, F.array_join("answer_terms", "、"))
    some = F.when(F.trim("evidence") != "", F.col("evidence"))
    return items.select("item_id", F.coalesce(some, terms).alias("truth"), F.when(some.isNotNull(), "evidence").when(terms.isNotNull(), "terms").otherwise("missing").alias("source"))


def problems(items: DataFrame) -> DataFrame:
    """item_id and problem of each rule that an item breaks."""
    rules = {
        "no question": F.coalesce(F.trim("question"), F.lit("")) == "", "no evidence": F.coalesce(F.trim("evidence"), F.lit("")) == "", "no terms": F.coalesce(F.size("answer_terms"), F.lit(0)) == 0,
        "no chapter": F.coalesce("gold_chapter", F.lit("")) == "", "term in question": F.exists("answer_terms", lambda t: F.contains("question", t)), "term not in evidence": F.exists("answer_terms", lambda t: ~F.contains("evidence", t)),
        "evidence length": ~F.length("evidence").between(18, 100),
    }
    flags = F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return items.select("item_id", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("problem"))


def systematic_sample(rows: DataFrame, by: str, key: str, count: int, block: int = 100_000) -> DataFrame:
    """count rows of each group at even distances in the order of a whole-number key; all rows of smaller groups.

    Rows are ranked within blocks of keys and moved on by the sizes of the blocks before, so that a large group is
    the work of many tasks. Rows with a null key are left out.
    """
    blocked = rows.where(F.col(key).isNotNull()).withColumn("_b", F.floor(F.col(key) / block))
    sizes = blocked.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(by)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_g"), F.col("_b").alias("_o"), before.alias("_before"), F.sum("_size").over(whole).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(by, "_b").orderBy(key)) - 1
    placed = blocked.withColumn("_in", rank).join(sizes, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_o"))).withColumn("_at", F.col("_in") + F.col("_before"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.least(F.col("_n") - 1, F.floor((i + 0.5) / count * F.col("_n"))))
    return placed.where(F.array_contains(wanted, F.col("_at").cast("long"))).select(*rows.columns)


def best_sentences(records: DataFrame, terms: DataFrame) -> DataFrame:
    """rec_id, sentence and entity: of the sentences of 15 to 80 characters the one with the most weight of terms of three
    characters, and its heaviest term. terms has gram and n. Ties go to the earlier sentence and the smaller term."""
    each = records.select("rec_id", F.posexplode(cut_into_sentences("text")).alias("at", "sentence")).where(F.length("sentence").between(15, 80))
    grams = each.select("rec_id", "at", F.explode(F.array_distinct(grams_of(F.col("sentence"), 3))).alias("gram")).join(terms.where(F.length("gram") == 3), "gram")
    weighed = grams.groupBy("rec_id", "at").agg(F.sum(F.col("n") * 6).alias("weight"), F.min(F.struct((-F.col("n")).alias("n"), "gram")).alias("top"))
    best = weighed.groupBy("rec_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "at", F.col("top.gram").alias("entity"))).alias("b"))
    return best.select("rec_id", F.col("b.at").alias("at"), F.col("b.entity").alias("entity")).join(each, ["rec_id", "at"]).select("rec_id", "sentence", "entity")


def chapter_numbers_match(found: Column, wanted: Column) -> Column:
    return chapter_number(found) == chapter_number(wanted)
