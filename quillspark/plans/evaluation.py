"""Evaluation, question sets, and small catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import jsontext as J
from quillspark.operators import context as X
from quillspark.operators import evaluate as E
from quillspark.operators import index as I
from quillspark.operators import retrieval as R
from quillspark.functions.text import keyword_tokens, squeeze
from quillspark.plans.registry import W, query, strip_sql
from quillspark.plans.retrieval import TERMS
from quillspark.plans.structure import number_sql
from quillspark.session import cut_lineage, table


def _items(spark, d):
    return table(spark, d, "eval_items")


def _hits(spark, d, k=10):
    """Records that hold an item's answer terms, ranked; the whole held-out set is asked."""
    records = table(spark, d, "metadata")
    asked = _items(spark, d).select(F.col("item_id").alias("query_id"), F.col("answer_terms").alias("terms"))
    return R.top(R.keyword_hits(records, "rec_id", asked), k, "rec_id").join(records.select("rec_id", "chapter", "text"), "rec_id")


_SCORE = "case when strpos(t, term) <= 100 then 1.5 when strpos(t, term) <= 500 then 1.25 else 1.0 end"
_HITS = f"""asked as (select distinct item_id as query_id, unnest(answer_terms) as term from eval_items),
found as (select rec_id, term, {_SCORE} as s from (select rec_id, lower(text) as t from metadata where text <> '') join (select distinct term from asked where term <> '') on strpos(t, term) > 0),
scored as (select query_id, rec_id, sum(s) as score from found join asked using (term) group by query_id, rec_id),
hits as (select h.*, chapter, text from (select *, row_number() over (partition by query_id order by score desc, rec_id) as rank from scored) h join metadata using (rec_id) where rank <= 10)"""
_SAME = "(gold_chapter <> '' and (chapter = gold_chapter or (length(gold_chapter) >= 4 and left(chapter, 4) = left(gold_chapter, 4))))"
_RECALL = ", ".join(f"avg(coalesce((first <= {k})::int::double, 0)) as recall_{k}" for k in (1, 3, 5, 10))


def _gold(spark, d):
    return _items(spark, d).where("gold_chapter <> '' and question <> ''").select(F.col("item_id").alias("query_id"), "gold_chapter", "qa_type")


@query(f"""with {_HITS}, j as (select query_id, min(rank) as first from hits join eval_items on query_id = item_id where {_SAME} group by query_id),
a as (select item_id, qa_type, first from eval_items left join j on item_id = query_id where gold_chapter <> '' and question <> '')
select qa_type, count(*) as queries, {_RECALL}, avg(coalesce(1.0::double / first, 0)) as mrr from a group by qa_type""")
def recall_at_k(spark, d):
    gold = _gold(spark, d)
    judged = E.judge(_hits(spark, d), gold, E.same_chapter(F.col("chapter"), F.col("gold_chapter")))
    return E.recall_and_mrr(judged.join(gold.select("query_id", "qa_type"), "query_id"), ["qa_type"])


@query(f"""with {_HITS}, o as (select query_id, chapter, min(rank) as old from hits where chapter is not null group by query_id, chapter), r as (select *, row_number() over (partition by query_id order by old) as rank from o),
j as (select query_id, min(rank) as first from r join eval_items on query_id = item_id where {_SAME} group by query_id),
a as (select item_id, first from eval_items left join j on item_id = query_id where gold_chapter <> '' and question <> '')
select count(*) as queries, {_RECALL}, avg(coalesce(1.0::double / first, 0)) as mrr from a""")
def dedup_recall(spark, d):
    """Recall over the chapters of a list, each once, before the list is cut."""
    gold = _gold(spark, d)
    once = E.distinct_in_order(_hits(spark, d).where("chapter is not null"), "chapter")
    return E.recall_and_mrr(E.judge(once, gold, E.same_chapter(F.col("chapter"), F.col("gold_chapter"))), [])


@query(f"""with {_HITS}, j as (select query_id, min(rank) as first from hits join eval_items on query_id = item_id where {_SAME} group by query_id),
a as (select item_id, qa_type, set_name, first from eval_items left join j on item_id = query_id where gold_chapter <> '' and question <> '')
select qa_type, set_name, count(*) as queries, avg(coalesce(1.0::double / first, 0)) as mrr from a group by cube (qa_type, set_name)""")
def mrr_by_kind_and_set(spark, d):
    """Mean reciprocal rank by kind and set, with all totals."""
    gold = _gold(spark, d)
    judged = E.judge(_hits(spark, d), gold, E.same_chapter(F.col("chapter"), F.col("gold_chapter")))
    named = judged.join(_items(spark, d).select(F.col("item_id").alias("query_id"), "qa_type", "set_name"), "query_id")
    return named.cube("qa_type", "set_name").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


@query(f"""with {_HITS} select query_id, rank, len(list_filter(answer_terms, lambda x: contains(text, x))) >= greatest(1, len(answer_terms) * 3 // 5) as passed from hits join eval_items on query_id = item_id""")
def keyword_judge(spark, d):
    hits = _hits(spark, d).join(_items(spark, d).select(F.col("item_id").alias("query_id"), "answer_terms"), "query_id")
    held = F.size(F.filter("answer_terms", lambda t: F.contains("text", t)))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), (held >= F.greatest(F.lit(1), F.floor(F.size("answer_terms") * 3 / 5))).alias("passed"))


def _coverage_sql(answer: str, text: str) -> str:
    """Share of the answer's characters found one after the other, up to the first that isn't."""
    steps = f"list_transform(list_filter(string_split({answer}, ''), lambda c: c <> ''), lambda c: {{'c': c, 'at': 1::bigint, 'n': 0::bigint}})"
    rest = f"strpos(substring({text}, s.at), e.c)"
    fold = f"list_reduce({steps}, lambda s, e: case when s.at = 0 then s when {rest} = 0 then {{'c': e.c, 'at': 0::bigint, 'n': s.n}} else {{'c': e.c, 'at': s.at + {rest}, 'n': s.n + 1}} end, {{'c': '', 'at': 1::bigint, 'n': 0::bigint}}).n"
    return f"case when length({answer}) > 0 then {fold} / length({answer})::double else 0.0 end"


_BARE = lambda x: f"regexp_replace({x}, '{W}+', '', 'g')"


@query(f"with {_HITS} select query_id, cast(rank as integer) as rank, {_coverage_sql('a', 't')} as coverage from (select query_id, rank, {_BARE('evidence')} as a, {_BARE('text')} as t from hits join eval_items on query_id = item_id where rank <= 3 and evidence is not null)")
def anchor_coverage(spark, d):
    """Share of each item's evidence found in order in its best records."""
    hits = _hits(spark, d, 3).join(_items(spark, d).where("evidence is not null").select(F.col("item_id").alias("query_id"), "evidence"), "query_id")
    return hits.select("query_id", "rank", E.coverage(squeeze("evidence"), squeeze("text")).alias("coverage"))


@query("select qa_type, count(*) as items, min(length(question)) as shortest, cast(sum(length(question)) // count(*) as bigint) as mean, max(length(question)) as longest, count(evidence) as with_evidence, cast(sum(coalesce(len(answer_terms), 0)) as bigint) as terms from eval_items group by qa_type")
def dataset_profile(spark, d):
    size = F.length("question").cast("long")
    return _items(spark, d).groupBy("qa_type").agg(F.count(F.lit(1)).alias("items"), F.min(size).alias("shortest"), F.floor(F.sum(size) / F.count(F.lit(1))).alias("mean"), F.max(size).alias("longest"), F.count("evidence").alias("with_evidence"), F.sum(F.coalesce(F.size("answer_terms"), F.lit(0)).cast("long")).alias("terms"))


@query("select item_id, coalesce(case when trim(evidence) <> '' then evidence end, case when len(answer_terms) > 0 then array_to_string(answer_terms, '、') end) as truth, case when trim(evidence) <> '' then 'evidence' when len(answer_terms) > 0 then 'terms' else 'missing' end as source from eval_items")
def ground_truth(spark, d):
    return E.ground_truth(_items(spark, d))


@query("""select item_id, problem from (select item_id, unnest(list_filter([
 case when coalesce(trim(question), '') = '' then 'no question' end, case when coalesce(trim(evidence), '') = '' then 'no evidence' end, case when coalesce(len(answer_terms), 0) = 0 then 'no terms' end,
 case when coalesce(gold_chapter, '') = '' then 'no chapter' end, case when len(list_filter(answer_terms, lambda t: contains(question, t))) > 0 then 'term in question' end,
 case when len(list_filter(answer_terms, lambda t: not contains(evidence, t))) > 0 then 'term not in evidence' end, case when not length(evidence) between 18 and 100 then 'evidence length' end], lambda x: x is not null)) as problem from eval_items)""")
def dataset_validation(spark, d):
    return E.problems(_items(spark, d))


_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in E.META_TERMS) + "]"


@query(f"with t as (select rec_id, list_filter({_TERM_LIST}, lambda t: contains(text, t)) as h from metadata where text is not null) select rec_id, list_filter(h, lambda x, i: len(list_filter(h, lambda y, j: j < i and contains(y, x))) = 0) as terms from t")
def meta_terms(spark, d):
    return table(spark, d, "metadata").where("text is not null").select("rec_id", E.meta_terms(F.col("text")).alias("terms"))


@query("with l as (select item_id, list_filter(list_transform(list_concat([question], coalesce(answer_terms, [])), lambda x: trim(x, ' ')), lambda x: x is not null and x <> '') as x from eval_items) select item_id, list_filter(x, lambda v, i: list_position(x, v) = i)[1:4] as queries from l")
def query_merge(spark, d):
    return _items(spark, d).select("item_id", E.merge_queries(F.col("question"), F.col("answer_terms")).alias("queries"))


@query("select term, case " + " ".join(f"when regexp_matches(term, '{v}') then '{k}'" for k, v in E.KINDS.items()) + " else 'person' end as kind from (select distinct unnest(answer_terms) as term from eval_items)")
def entity_kinds(spark, d):
    return _items(spark, d).select(F.explode("answer_terms").alias("term")).distinct().select("term", E.kind_of(F.col("term")).alias("kind"))


@query("with n as (select book_id, rec_id, row_number() over (partition by book_id order by rec_id) - 1 as pos, count(*) over (partition by book_id) as n from metadata) select book_id, rec_id from n where list_contains(list_transform(range(0, 10), lambda i: least(n - 1, cast(floor((i + 0.5::double) / 10 * n) as bigint))), pos)")
def systematic_sample(spark, d):
    return E.systematic_sample(table(spark, d, "metadata").select("book_id", "rec_id"), "book_id", "rec_id", 10)


_SENTENCES = "list_filter(list_transform(string_split_regex(text, '[。！？；…]+'), lambda x: " + strip_sql("x") + "), lambda x: x <> '')"
_RUNS3 = "flatten(list_transform(regexp_extract_all(s, '[\\x{4e00}-\\x{9fff}]+'), lambda run: list_transform(range(1, greatest(length(run) - 1, 1)), lambda i: substring(run, i, 3))))"
_BEST = f"""each as (select rec_id, pos, x as s from (select rec_id, unnest({_SENTENCES}) as x, unnest(range(0, len({_SENTENCES}))) as pos from metadata where text is not null) where length(x) between 15 and 80),
found as (select rec_id, pos, n, gram from (select distinct rec_id, pos, unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substring(s, i, 3))) as gram from each) join ({TERMS}) using (gram) where length(gram) = 3),
best as (select rec_id, arg_min(pos, -weight * 1000 + pos) as pos from (select rec_id, pos, sum(n * 6) as weight from found group by rec_id, pos) group by rec_id),
sentence as (select b.rec_id, s as sentence, (select arg_min(gram, {{'a': -n, 'b': gram}}) from found f where f.rec_id = b.rec_id and f.pos = b.pos) as entity from best b join each e on e.rec_id = b.rec_id and e.pos = b.pos)"""


@query(f"with {_BEST} select rec_id, sentence, entity from sentence")
def best_sentence(spark, d):
    records = table(spark, d, "metadata")
    return E.best_sentences(records, X.book_terms(records))


_KIND_SQL = "case " + " ".join(f"when regexp_matches(entity, '{v}') then '{k}'" for k, v in E.KINDS.items()) + " else 'person' end"


_LATEST_TEXTS = """latest as (select * from (select * exclude no from (select *, row_number() over (partition by book_id, chunk_id order by loaded_at desc, rec_id desc) as no from metadata where book_id is not null and chunk_id is not null) where no = 1
 union all select * from metadata where book_id is null or chunk_id is null) where length(text) >= 60)"""


@query(f"""with {_LATEST_TEXTS}, {_BEST.replace('metadata', 'latest')},
mine as (select s.*, book_id, chapter from sentence s join latest using (rec_id)),
first as (select book_id, entity, min(rec_id) as rec_id from mine group by all)
select m.rec_id, m.book_id, chapter, m.entity, {_KIND_SQL.replace('entity', 'm.entity')} as kind, replace(sentence, m.entity, '____') as question, sentence as answer from mine m join first f on m.book_id = f.book_id and m.entity = f.entity and m.rec_id = f.rec_id""")
def question_items(spark, d):
    """Questions made from the chunks: the best sentence is the answer, its entity the gap; each entity once, at its first record."""
    records = I.latest_records(table(spark, d, "metadata")).where("length(text) >= 60")
    best = E.best_sentences(records, X.book_terms(records)).join(records.select("rec_id", "book_id", "chapter"), "rec_id")
    first = best.groupBy("book_id", "entity").agg(F.min("rec_id").alias("rec_id"))
    chosen = best.join(first, ["book_id", "entity", "rec_id"])
    return chosen.select("rec_id", "book_id", "chapter", "entity", E.kind_of(F.col("entity")).alias("kind"), F.replace(F.col("sentence"), F.col("entity"), F.lit("____")).alias("question"), F.col("sentence").alias("answer"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n <= 20")
def history_last_n(spark, d):
    """The last twenty entries of each user's history."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("n", last).where("n <= 20").select("user_id", "event_id", "event_type")


@query("select event_id, try_cast(json_extract_string(regexp_extract(props, '\\{.*\\}'), '$.k') as bigint) as k from events")
def json_extract_tolerant(spark, d):
    """A field of the object in a text, whatever stands around it."""
    return table(spark, d, "events").select("event_id", F.expr("try_cast(get_json_object(regexp_extract(props, '(?s)\\\\{.*\\\\}', 0), '$.k') as bigint)").alias("k"))


@query("select event_type, count(*) as n, quantile_cont(value, 0.95) as p95 from events group by event_type")
def latency_percentile(spark, d):
    """Linear percentiles of each kind."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", F.lit(0.95)).alias("p95"))


@query("select count(*) as vectors, count(embeddings) as present, cast(mode(len(embeddings)) as bigint) as dimensions, count(distinct (book_id, chapter_id)) as chapters from previous_index")
def index_stats(spark, d):
    rows = table(spark, d, "previous_index")
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.count("embeddings").alias("present"), F.mode(F.when(F.col("embeddings").isNotNull(), F.size("embeddings"))).cast("long").alias("dimensions"), F.countDistinct("book_id", "chapter_id").alias("chapters"))


@query("select project_id, case when chunk_size > 210 and chunk_size <= 672 then chunk_size else 672 end as max_chars, greatest(0, coalesce(overlap, 50)) as overlap from projects")
def split_params(spark, d):
    """Chunk sizes of projects within their bounds."""
    size = F.when((F.col("chunk_size") > 210) & (F.col("chunk_size") <= 672), F.col("chunk_size")).otherwise(672)
    return table(spark, d, "projects").select("project_id", size.alias("max_chars"), F.greatest(F.lit(0), F.coalesce("overlap", F.lit(50))).alias("overlap"))


@query("select p.book_id, m.records, c.chapters, v.vectors from projects p left join (select book_id, count(*) as records from metadata group by 1) m using (book_id) left join (select book_id, count(distinct chapter_id) as chapters from chapter_index group by 1) c using (book_id) left join (select book_id, count(embeddings) as vectors from previous_index group by 1) v using (book_id)")
def project_stats(spark, d):
    of = lambda name, agg: table(spark, d, name).groupBy("book_id").agg(agg)
    base = table(spark, d, "projects").select("book_id")
    for part in (of("metadata", F.count(F.lit(1)).alias("records")), of("chapter_index", F.countDistinct("chapter_id").alias("chapters")), of("previous_index", F.count("embeddings").alias("vectors"))):
        base = base.join(part, "book_id", "left")
    return base


_ENTITIES = f"""terms as ({TERMS}),
qr as (select item_id, unnest(regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fff}}]+')) as chars, unnest(range(0, len(regexp_extract_all(question, '[\\x{{4e00}}-\\x{{9fff}}]+')))) as run from eval_items),
qg as (select item_id, run, unnest(range(0, greatest(length(chars) - 1, 0))) as pos, 2 as n, unnest(list_transform(range(1, greatest(length(chars), 1)), lambda i: substring(chars, i, 2))) as gram from qr
 union all select item_id, run, unnest(range(0, greatest(length(chars) - 2, 0))), 3, unnest(list_transform(range(1, greatest(length(chars) - 1, 1)), lambda i: substring(chars, i, 3))) from qr),
ql as (select item_id, list({{'run': run, 'at': pos, 'n': -n, 'gram': gram, 'got': cast([] as varchar[])}} order by run, pos, -n, gram) as l from qg semi join terms using (gram) group by item_id),
qt as (select item_id, list_reduce(l, lambda s, e: case when e.run <> s.run or e.at >= s.at - s.n then {{'run': e.run, 'at': e.at, 'n': e.n, 'gram': e.gram, 'got': list_append(s.got, e.gram)}} else s end, {{'run': -1::bigint, 'at': 0::bigint, 'n': 0, 'gram': '', 'got': cast([] as varchar[])}}).got as got from ql),
qd as (select item_id, list_filter(got, lambda w, i: list_position(got, w) = i) as got from qt),
entities as (select item_id, list_concat(list_filter(got, lambda w: length(w) = 3), list_filter(got, lambda w: length(w) = 2))[1:3] as entities from qd)"""


def _named_questions(spark, d):
    return _items(spark, d).select(F.col("item_id").alias("query_id"), "question")


@query(f"with {_ENTITIES} select item_id as query_id, entities from entities")
def question_entities(spark, d):
    return E.question_entities(_named_questions(spark, d), X.book_terms(table(spark, d, "metadata")))


_LEADING = f"""terms as ({TERMS}),
ar as (select item_id, unnest(regexp_extract_all(evidence, '[\\x{{4e00}}-\\x{{9fff}}]+')) as chars, unnest(range(0, len(regexp_extract_all(evidence, '[\\x{{4e00}}-\\x{{9fff}}]+')))) as run from eval_items where evidence <> ''),
ag as (select item_id, run, unnest(range(0, greatest(length(chars) - 1, 0))) as pos, 2 as size, unnest(list_transform(range(1, greatest(length(chars), 1)), lambda i: substring(chars, i, 2))) as gram from ar
 union all select item_id, run, unnest(range(0, greatest(length(chars) - 2, 0))), 3, unnest(list_transform(range(1, greatest(length(chars) - 1, 1)), lambda i: substring(chars, i, 3))) from ar),
af as (select item_id, gram, min({{'a': size, 'b': run, 'c': pos}}) as first, n from ag join terms using (gram) group by item_id, gram, n),
heads as (select item_id, list(gram order by n desc, first)[1:3] as heads from af group by item_id),
judged as (select query_id, rank, {_SAME} as chapter_ok, {_coverage_sql('a', 't')} >= 0.85 as anchor, coalesce(len(list_filter(heads, lambda x: contains(t, x))) >= 2, false) as keyword from (
  select h.query_id, h.rank, h.chapter, gold_chapter, heads, {_BARE('evidence')} as a, {_BARE('text')} as t from hits h join eval_items e on h.query_id = e.item_id left join heads l on l.item_id = e.item_id where rank <= 5 and evidence <> ''))"""


def _judged(spark, d):
    answers = _items(spark, d).where("evidence <> ''").select(F.col("item_id").alias("query_id"), F.col("evidence").alias("answer"), "gold_chapter")
    return E.auto_judge(_hits(spark, d, 5), answers, X.book_terms(table(spark, d, "metadata")))


@query(f"with {_HITS}, {_LEADING} select query_id, cast(rank as integer) as rank, coalesce(chapter_ok, false) as chapter, anchor, keyword, anchor or keyword as either from judged")
def auto_judge(spark, d):
    """Each hit by chapter, by anchor, by leading terms, and by anchor or terms."""
    return _judged(spark, d).withColumnRenamed("any", "either")


@query(f"with {_HITS}, {_LEADING} select cast(k as integer) as k, " + ", ".join(f"count(distinct case when {c} then query_id end) as {n}" for n, c in (("chapter", "chapter_ok"), ("anchor", "anchor"), ("keyword", "keyword"), ("either", "anchor or keyword"))) + " from judged, (select unnest([1, 3, 5]) as k) where rank <= k group by k")
def judged_shares(spark, d):
    return E.judged_shares(_judged(spark, d)).withColumnRenamed("any", "either")


_CONFIGS_SQL = ", ".join(f"({n}, '{c[0]}', {c[1]}, {c[2]}, {c[3]})" for n, c in enumerate(E.CONFIGS))
_COMPARED = f"""{_ENTITIES},
q as (select item_id, question, no - 1 as query_no, l[no] as query from (select item_id, question, l, unnest(range(1, len(l) + 1)) as no from (
  select item_id, question, list_filter(l, lambda v, i: list_position(l, v) = i)[1:4] as l from (select e.item_id, question, list_filter(list_transform(list_concat([question], coalesce(entities, [])), lambda x: {strip_sql('x')}), lambda x: x is not null and x <> '') as l from eval_items e left join entities n on e.item_id = n.item_id)))),
w as (select item_id, query_no, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) as w from q),
qt2 as (select item_id, query_no, w as term from w union select item_id, query_no, unnest(list_transform(range(1, greatest(length(w), 1)), lambda i: substring(w, i, 2))) from w where regexp_matches(w, '^[\\x{{4e00}}-\\x{{9fff}}]+$') and length(w) > 2),
places as (select rec_id, term, {_SCORE} as s from (select rec_id, lower(text) as t from metadata where text <> '') join (select distinct term from qt2) on strpos(t, term) > 0),
lists as (select * from (select *, row_number() over (partition by item_id, query_no order by score desc, rec_id) as rank from (select item_id, query_no, rec_id, cast(sum(s) as double) as score from places join qt2 using (term) group by all)) where rank <= 500),
configs(config_no, config, top_k, reranked, with_entities) as (values {_CONFIGS_SQL}),
own as (select * from lists, configs where (with_entities or query_no = 0) and rank <= 5 * top_k),
n as (select item_id, config_no, count(distinct query_no) > 1 as several from own group by all),
m as (select item_id, config_no, rec_id, sum(1e0 / (60 + rank)) as s, min({{'a': query_no, 'b': rank}}) as first, max(score) as own from own group by all),
f as (select m.*, several, case when several then round(s, 6) else own end as score, row_number() over (partition by item_id, config_no order by case when several then round(s, 12) end desc, first) as rank from m join n using (item_id, config_no)),
c as (select f.item_id, config, top_k, f.rec_id, chapter, rank, case when reranked then round_even(len(list_filter(list_distinct(string_split(question, '')), lambda c: contains(text, c))) / len(list_distinct(string_split(question, '')))::double, 4) else f.score end as score
  from f join configs using (config_no) join metadata using (rec_id) join eval_items e on e.item_id = f.item_id where rank <= 3 * top_k),
r as (select *, row_number() over (partition by item_id, config order by score desc, rank) as new from c),
b as (select *, (coalesce(chapter, '') = '')::int as tier, row_number() over (partition by item_id, config, coalesce(nullif(chapter, ''), chr(1) || rec_id) order by score desc, new) as k from r),
final as (select item_id, config, chapter, place from (select *, row_number() over (partition by item_id, config order by tier, score desc, new) as place from b where k = 1) where place <= top_k),
numbered as (select item_id, config, place, {number_sql('chapter')} as number from final where chapter is not null),
firsts as (select item_id, config, number, min(place) as first from numbered where number is not null group by all),
placed as (select *, row_number() over (partition by item_id, config order by first) as first_distinct from firsts),
met as (select p.* from placed p join (select item_id, {number_sql('gold_chapter')} as gold from eval_items where gold_chapter <> '') g on g.item_id = p.item_id and gold = number),
every as (select item_id, set_name, config from eval_items, configs where question <> '')"""


@query(f"""with {_COMPARED} select set_name, config, count(*) as queries, avg((coalesce(first, 1000) <= 5)::int::double) as recall_5, avg((coalesce(first, 1000) <= 10)::int::double) as recall_10,
avg(coalesce(1.0::double / first, 0)) as mrr, avg(coalesce(1.0::double / first_distinct, 0)) as mrr_distinct from every left join met on every.item_id = met.item_id and every.config = met.config group by cube (set_name, every.config)""".replace("select set_name, config,", "select set_name, every.config as config,"))
def config_compare(spark, d):
    """Seven configurations of keyword retrieval over all items, by set and configuration, with all totals."""
    records, items = table(spark, d, "metadata"), _items(spark, d)
    questions = _named_questions(spark, d)
    entities = E.question_entities(questions, X.book_terms(records))
    queries = questions.join(entities, "query_id", "left").select("query_id", F.posexplode(E.merge_queries(F.col("question"), F.col("entities"))).alias("query_no", "query"))
    lists = cut_lineage(R.query_lists(queries, records, "rec_id", R.POOL * max(c[1] for c in E.CONFIGS), None))
    hits = E.compare_configs(lists, questions, records, "rec_id", R.shared_characters)
    gold = items.where("gold_chapter <> ''").select(F.col("item_id").alias("query_id"), "gold_chapter")
    met = E.chapter_metrics(hits, gold, ["config"])
    configs = F.array(*[F.lit(c[0]) for c in E.CONFIGS])
    every = items.where("question <> ''").select(F.col("item_id").alias("query_id"), "set_name", F.explode(configs).alias("config"))
    within = lambda k: F.avg((F.coalesce("first", F.lit(1000)) <= k).cast("double"))
    mean = lambda c: F.avg(F.coalesce(1.0 / F.col(c), F.lit(0.0)))
    return every.join(met, ["query_id", "config"], "left").cube("set_name", "config").agg(F.count(F.lit(1)).alias("queries"), within(5).alias("recall_5"), within(10).alias("recall_10"), mean("first").alias("mrr"), mean("first_distinct").alias("mrr_distinct"))


_LOCAL = """runs as (select book_id, chapter_id, unnest(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+')) as run from metadata),
lg as (""" + " union all ".join(f"select book_id, chapter_id, unnest(list_transform(range(1, greatest(length(run) - {n} + 2, 1)), lambda i: substring(run, i, {n}))) as gram from runs" for n in (2, 3, 4)) + """),
lt as (select gram, sum(n) as n, count(*) as span from (select gram, book_id, chapter_id, count(*) as n from lg group by all) group by gram having sum(n) >= 25 and count(*) <= 15)"""


@query(f"with {_LOCAL} select gram, cast(n as bigint) as n, span from lt")
def local_terms(spark, d):
    """Grams that occur often in few chapters."""
    return E.local_terms(table(spark, d, "metadata").select("book_id", "chapter_id", "text"))


_TAIL_SQL = "case kind " + " ".join(f"when '{k}' then '{t}'" for k, t in E.TAILS.items()) + " end"
_GRAMS_SQL = "list_concat(" + ", ".join(f"flatten(list_transform(regexp_extract_all(s, '[\\x{{4e00}}-\\x{{9fff}}]+'), lambda run: list_transform(range(1, greatest(length(run) - {n} + 2, 1)), lambda i: substring(run, i, {n}))))" for n in (2, 3, 4)) + ")"


@query(f"""with {_LOCAL},
whole as (select rec_id, book_id, chapter, {_SENTENCES} as l from metadata where chapter <> '' and text is not null),
each as (select * from (select rec_id, book_id, chapter, l, unnest(l) as s, unnest(range(0, len(l))) as pos from whole) where length(s) between 15 and 80),
weighed as (select rec_id, pos, max({{'w': n * length(gram) * length(gram) / span::double, 'g': gram}}) as b from (select distinct rec_id, pos, unnest({_GRAMS_SQL}) as gram from each) join lt using (gram) group by rec_id, pos),
found as (select e.*, b.g as entity, list_filter([case when pos > 0 then l[pos] end, l[pos + 2]], lambda x: x is not null and length(x) between 12 and 70 and not contains(x, b.g))[1] as lead from each e join weighed using (rec_id, pos)),
kinds as (select *, {_KIND_SQL} as kind from found where lead is not null),
asked as (select *, regexp_replace(lead, '[，、；：]+$', '') || '，' || {_TAIL_SQL} as question from kinds),
fine as (select * from asked where not contains(question, entity)),
one as (select * from (select *, row_number() over (partition by book_id, chapter order by rec_id, pos) as k from fine) where k = 1),
two as (select * from (select *, row_number() over (partition by entity order by rec_id, pos) as k2 from one) where k2 = 1)
select rec_id, chapter, cast(pos as integer) as place, question, entity, kind, s as evidence from two""")
def natural_questions(spark, d):
    records = table(spark, d, "metadata").where("text is not null").select("rec_id", "book_id", "chapter_id", "chapter", "text")
    return E.natural_questions(records, cut_lineage(E.local_terms(table(spark, d, "metadata").select("book_id", "chapter_id", "text")))).withColumnRenamed("at", "place")


_ANSWER = "answer_terms[1]"


@query(f"""with s as (select item_id, count(distinct chapter) as span from eval_items join metadata on strpos(lower(text), lower({_ANSWER})) > 0 where {_ANSWER} <> '' and chapter <> '' group by item_id),
i as (select item_id, coalesce(trim(question, ' '), '') as q, coalesce(trim({_ANSWER}, ' '), '') as a, coalesce(evidence, '') as ev, coalesce(span, 0) as span from eval_items left join s using (item_id)),
r as (select *, q = '' or a = '' as none from i)
select item_id, reason from (select item_id, unnest(list_filter([case when none then 'missing' end, case when not none and not length(q) between 18 and 100 then 'length' end, case when not none and not contains(ev, a) then 'not in text' end, case when not none and contains(q, a) then 'in question' end,
 case when not none and len(list_filter(list_transform(range(1, greatest(length(a) - 1, 1)), lambda i: substring(a, i, 3)), lambda g: contains(q, g))) > 0 then 'leaks' end, case when not none and span > 30 then 'everywhere' end], lambda x: x is not null)) as reason from r)""")
def qa_verification(spark, d):
    """Why an item can't be used; its first term is the answer."""
    items = _items(spark, d).select("item_id", "question", F.get("answer_terms", 0).alias("answer"), "evidence")
    records = table(spark, d, "metadata")
    held = R.keyword_hits(records, "rec_id", items.select(F.col("item_id").alias("query_id"), F.array(F.lower("answer")).alias("terms")))
    span = held.join(records.where("chapter <> ''").select("rec_id", "chapter"), "rec_id").groupBy(F.col("query_id").alias("item_id")).agg(F.count_distinct("chapter").alias("span"))
    return E.verification(items, span)


_FLAT = lambda x: strip_sql(f"regexp_replace({x}, '{W}+', ' ', 'g')")


@query(f"""with own as (select item_id, book_title, {number_sql('gold_chapter')} as number, {_FLAT('evidence')} as ev, case when len(answer_terms) > 0 then array_to_string(answer_terms, '、') end as terms from eval_items),
t as (select rec_id, book_title, {number_sql('chapter')} as number, text from metadata where text <> '' and chapter is not null),
b as (select *, coalesce(sum(length(text) + 1) over (partition by book_title, number order by rec_id rows between unbounded preceding and 1 preceding), 0) as before from t where number is not null),
g as (select book_title, number, string_agg(text, chr(10) order by rec_id) as gold from b where before < 1000 group by all)
select item_id, left(coalesce(nullif(ev, ''), terms, {_FLAT('gold')}, ''), 1000) as truth, case when ev <> '' then 'evidence' when terms is not null then 'terms' when gold is not null then 'chapter' else 'missing' end as source from own left join g on own.book_title = g.book_title and own.number = g.number and coalesce(ev, '') = '' and terms is null""")
def chapter_truth(spark, d):
    return E.chapter_truth(_items(spark, d), table(spark, d, "metadata"))


def _unquoted_sql(x):
    return strip_sql(f"regexp_replace({strip_sql(x)}, '^[\"\\x{{27}}“”]+|[\"\\x{{27}}“”]+$', '', 'g')")


@query(f"""with r as (select item_id, question, coalesce(answer_terms, []) as e, [question, set_name || '主角是谁', evidence] as q from eval_items),
bare as (select item_id, question, list_transform(e, lambda x: {_unquoted_sql('x')}) as e, list_transform(q, lambda x: {_unquoted_sql('x')}) as q from r),
cut as (select item_id, question, list_filter(e, lambda x, i: x <> '' and length(x) <= 20 and list_position(e, x) = i)[1:3] as e, list_filter(q, lambda x, i: x <> '' and length(x) <= 60 and list_position(q, x) = i)[1:3] as q from bare),
kept as (select item_id, list_filter(e, lambda x: not regexp_matches(x, '{"|".join(E.META_TERMS)}') and x <> question) as entities, list_filter(q, lambda x: not regexp_matches(x, '{"|".join(E.META_TERMS)}') and x <> question) as queries from cut)
select item_id, entities, queries, len(entities) + len(queries) = 0 as failed from kept""")
def rewrite_parse(spark, d):
    """Entities and queries out of replies with JSON in prose, made of each item, without what can't help."""
    some = F.coalesce("answer_terms", F.array().cast("array<string>"))
    reply = F.concat(F.lit("好的：\n"), F.to_json(F.struct(some.alias("entities"), F.array("question", F.concat("set_name", F.lit("主角是谁")), "evidence").alias("queries"))), F.lit("\n以上"))
    parsed = _items(spark, d).select("item_id", E.usable_rewrites(J.rewrites(reply), F.col("question")).alias("r"))
    return parsed.select("item_id", "r.entities", "r.queries", "r.failed")


@query("select book_title, chapter, place from (select *, row_number() over (partition by book_title order by md5(chapter || '2027'), chapter) as place from (select book_title, chapter from metadata where chapter <> '' and book_title is not null group by all having max(length(text)) >= 600)) where place <= 30")
def shuffled_chapters(spark, d):
    """Up to thirty chapters of each book with a text of 600 characters, in an order drawn by a seed."""
    chapters = table(spark, d, "metadata").where("chapter <> '' and book_title is not null").groupBy("book_title", "chapter").agg(F.max(F.length("text")).alias("most")).where("most >= 600")
    place = F.row_number().over(Window.partitionBy("book_title").orderBy(F.md5(F.concat("chapter", F.lit("2027"))), "chapter"))
    return chapters.select("book_title", "chapter", place.cast("long").alias("place")).where("place <= 30")


_STATUS = """c as (select p.*, coalesce(m.n, 0) as records, coalesce(v.n, 0) as vectors from projects p left join (select book_id, count(*) as n from metadata where text <> '' group by 1) m using (book_id) left join (select book_id, count(embeddings) as n from previous_index group by 1) v using (book_id)),
st as (select *, case when source_path is null then 'unknown' when records > 0 and vectors > 0 then 'ready' when records > 0 then 'keyword_only' when clean_rules is not null then 'cleaned' when status = 'error' then 'error' else 'created' end as derived from c)"""


def _status(spark, d):
    of = lambda name, agg: table(spark, d, name).groupBy("book_id").agg(agg)
    base = table(spark, d, "projects").join(table(spark, d, "metadata").where("text <> ''").groupBy("book_id").agg(F.count(F.lit(1)).alias("records")), "book_id", "left").join(of("previous_index", F.count("embeddings").alias("vectors")), "book_id", "left")
    records, vectors = F.coalesce("records", F.lit(0)), F.coalesce("vectors", F.lit(0))
    derived = F.when(F.col("source_path").isNull(), "unknown").when((records > 0) & (vectors > 0), "ready").when(records > 0, "keyword_only").when(F.col("clean_rules").isNotNull(), "cleaned").when(F.col("status") == "error", "error").otherwise("created")
    return base.withColumn("derived", derived)


@query(f"with {_STATUS} select project_id, derived as status from st")
def project_status(spark, d):
    """What can be done with each project by what its tables hold."""
    return _status(spark, d).select("project_id", F.col("derived").alias("status"))


@query(f"with {_STATUS} select arg_max(project_id, {{'a': (derived = 'ready')::int, 'b': coalesce(last_used, created_at), 'c': project_id}}) as project_id, count(*) as projects from st")
def current_project(spark, d):
    """The ready project used last, else the one used last."""
    return _status(spark, d).agg(F.max_by("project_id", F.struct((F.col("derived") == "ready").alias("a"), F.coalesce("last_used", "created_at").alias("b"), F.col("project_id").alias("c"))).alias("project_id"), F.count(F.lit(1)).alias("projects"))
