"""Context and retrieval queries. Query sets are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import context as X
from quillspark.operators import evaluate as E
from quillspark.operators import index as I
from quillspark.operators import retrieval as R
from quillspark.plans.registry import query, strip_sql
from quillspark.session import cut_lineage, spread, table

_RUNS = "regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]+')"


def _gram_list(run: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({run}) - {n} + 2, 1)), lambda i: substring({run}, i, {n}))"


def _texts(spark, d):
    return spread(table(spark, d, "metadata").select("rec_id", "book_id", "chapter_id", "text"), "rec_id")


def _grams(keys: str, where: str) -> str:
    return f"select {keys} unnest(list_concat({_gram_list('run', 2)}, {_gram_list('run', 3)})) as gram from (select {keys} unnest({_RUNS}) as run from metadata where {where})"


@query(f"select gram, count(*) as n from ({_grams(keys='', where='text is not null')}) group by gram")
def ngram_counts(spark, d):
    return X.gram_counts(_texts(spark, d), [])


_NAMES = ", ".join(f"'{w}'" for w in X.NOT_NAMES)


#: Grams that occur often and hold no particle.
TERMS = f"select gram, count(*) as n from ({_grams(keys='', where='text is not null')}) where not (length(gram) = 2 and regexp_matches(gram, '[{X.NOT_IN_TERMS}]')) and gram not in ({_NAMES}) group by gram having count(*) >= 30"


@query(TERMS)
def book_terms(spark, d):
    return X.book_terms(_texts(spark, d))


@query(f"select gram, count(*) as chapters from (select distinct book_id, chapter_id, gram from ({_grams(keys='book_id, chapter_id,', where='chapter_id is not null')})) group by gram")
def gram_chapter_df(spark, d):
    return X.gram_chapters(_texts(spark, d))


_NAMED = f"""r as (select book_id, rec_id, unnest({_RUNS}) as run, unnest(range(0, len({_RUNS}))) as run_no from metadata where text is not null),
g as (select book_id, rec_id, run_no, 2 as size, unnest({_gram_list('run', 2)}) as gram, unnest(range(0, greatest(length(run) - 1, 0))) as pos from r
  union all select book_id, rec_id, run_no, 3, unnest({_gram_list('run', 3)}), unnest(range(0, greatest(length(run) - 2, 0))) from r),
c as (select book_id, gram, count(*) as n, min({{'a': rec_id, 'b': run_no, 'c': pos, 'd': size}}) as first from g where gram not in ({_NAMES}) and not contains('{X.NOT_ENDINGS}', right(gram, 1)) group by book_id, gram having count(*) >= 3),
names as (select book_id, place, gram as name, n from (select *, row_number() over (partition by book_id order by n desc, first) as place from c) where place <= 30)"""


@query(f"with {_NAMED} select book_id, cast(place as bigint) as place, name, n from names")
def character_table(spark, d):
    return X.character_table(_texts(spark, d)).withColumn("place", F.col("place").cast("long"))


@query(f"""with {_NAMED},
l as (select rec_id, book_id, chunk_id, line_no, line from (select rec_id, book_id, chunk_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, {strip_sql('x')} as line from (select rec_id, book_id, chunk_id, text, unnest(string_split(text, chr(10))) as x from metadata)) where line <> ''),
h as (select *, left(line, greatest(10, cast(floor(length(line) / 3.0) as bigint))) as head, regexp_matches(line, '[」』”"'']$') and length(line) < 80 as speech, regexp_matches(line, '{X.REFERRING}') as refers from l),
ev as (select rec_id, arg_max(name, {{'a': line_no, 'b': strpos(head, name), 'c': place}}) as event from h join names on h.book_id = names.book_id and strpos(head, name) > 0 where not speech group by rec_id),
inl as (select rec_id, line_no, arg_min(name, case when strpos(line, name) > 0 then place end) as name from h left join names on h.book_id = names.book_id where refers group by rec_id, line_no),
inf as (select rec_id, arg_min(coalesce(name, ''), line_no) as first, arg_min(name, case when name is not null then line_no end) as any_name from inl group by rec_id),
o as (select rec_id, last_value(event ignore nulls) over (partition by book_id order by chunk_id nulls first, rec_id rows between unbounded preceding and 1 preceding) as prior from (select rec_id, book_id, chunk_id, event from metadata left join ev using (rec_id)))
select rec_id, case when prior is not null then coalesce(nullif(first, ''), prior) else any_name end as subject from inf join o using (rec_id)""".replace("select rec_id, book_id, chunk_id, unnest(range(0, len(string_split(text, chr(10))))) as line_no, ", "select rec_id, book_id, chunk_id, line_no, ").replace("select rec_id, book_id, chunk_id, text, unnest(string_split(text, chr(10))) as x from metadata", "select rec_id, book_id, chunk_id, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as line_no from metadata"))
def coref_subject(spark, d):
    records = table(spark, d, "metadata")
    return X.coref_subjects(records, X.character_table(records))


_PICK = "item_id % 100 = 0"
_TOKENS = """w as (select item_id as query_id, unnest(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+')) as w from eval_items where item_id % 100 = 0),
terms as (select query_id, w as term from w union select query_id, unnest(list_transform(range(1, greatest(length(w), 1)), lambda i: substring(w, i, 2))) from w where regexp_matches(w, '^[\\x{4e00}-\\x{9fff}]+$') and length(w) > 2)"""
_SCORE = "case when strpos(t, term) <= 100 then 1.5 when strpos(t, term) <= 500 then 1.25 else 1.0 end"


def _kw_sql(tbl: str, key: str) -> str:
    return f"hits as (select query_id, {key}, cast(sum({_SCORE}) as double) as score from (select {key}, lower(text) as t from {tbl} where text <> '') join terms on strpos(t, term) > 0 group by query_id, {key})"


def _questions(spark, d):
    return table(spark, d, "eval_items").where(F.expr(_PICK)).select(F.col("item_id").alias("query_id"), T.keyword_tokens("question").alias("terms"))


@query(f"""with {_TOKENS}, {_kw_sql('documents', 'doc_id')},
b as (select query_id, source, doc_id, score, row_number() over (partition by query_id, source order by score desc, doc_id) as n from hits join documents using (doc_id) where source <> '')
select query_id, source, doc_id, score, cast(place as bigint) as place from (select *, row_number() over (partition by query_id order by score desc, doc_id) as place from b where n = 1) where place <= 10""")
def kw_search(spark, d):
    """The ten best sources of each question, by their best document."""
    documents = table(spark, d, "documents")
    hits = R.keyword_hits(documents, "doc_id", _questions(spark, d))
    named = hits.join(documents.where("source <> ''").select("doc_id", "source"), "doc_id")
    return R.best_of_group(named, "source", "doc_id", 10).select("query_id", "source", "doc_id", "score", F.col("place").cast("long").alias("place"))


@query(f"with {_TOKENS}, {_kw_sql('metadata', 'rec_id')} select query_id, rec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, rec_id) as rank from hits) where rank <= 25")
def kw_search_bigram(spark, d):
    hits = R.keyword_hits(table(spark, d, "metadata"), "rec_id", _questions(spark, d))
    return R.top(hits, 25, "rec_id").withColumn("rank", F.col("rank").cast("long"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
_COS = f"round({_DOT.format(a='q.embedding', b='e.embedding')} / sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) / sqrt({_DOT.format(a='e.embedding', b='e.embedding')}), 9)"
_VEC = f"v as (select q.vec_id as query_id, e.vec_id, e.label, {_COS} as score from embeddings q, embeddings e where q.vec_id % 100 = 0)"


def _vector_queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"with {_VEC} select query_id, vec_id, round_even(score, 4) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from v) where rank <= 25 and score > 0.1")
def vec_topk(spark, d):
    hits = R.vector_hits(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 25)
    return R.above(hits).select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""with p as (select vec_id, embeddings as e from previous_index where len(embeddings) = 64 and len(list_filter(embeddings, lambda x: x is null or not isfinite(x))) = 0)
select vec_id, round(sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))), 6) as norm from p""")
def vector_norms(spark, d):
    usable = table(spark, d, "previous_index").where((F.size("embeddings") == 64) & F.forall("embeddings", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return usable.select("vec_id", F.round(V.norm(F.col("embeddings")), 6).alias("norm"))


_LISTS = f"""ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from v),
lists as (select query_id // 500 * 500 as query_id, query_id // 100 % 5 as list_no, vec_id, label, rank from ranked where rank <= 25 and score > 0.1),
fused as (select query_id, vec_id, label, sum(1e0 / (60 + rank)) as score, min({{'a': list_no, 'b': rank}}) as first from lists group by query_id, vec_id, label)"""


def _fused(spark, d):
    """Lists of five neighbouring queries are taken for the rewrites of one."""
    hits = R.above(R.vector_hits(table(spark, d, "embeddings"), "vec_id", "embedding", _vector_queries(spark, d), 25))
    lists = hits.select((F.floor(F.col("query_id") / 500) * 500).alias("query_id"), F.pmod(F.floor(F.col("query_id") / 100), F.lit(5)).alias("list_no"), "vec_id", "rank")
    return R.fuse(lists, "vec_id").join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


@query(f"with {_VEC}, {_LISTS} select query_id, vec_id, round(score, 9) as score, place from (select *, row_number() over (partition by query_id order by round(score, 12) desc, first) as place from fused) where place <= 15")
def rrf_fusion(spark, d):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first"))
    return _fused(spark, d).withColumn("place", place.cast("long")).where("place <= 15").select("query_id", "vec_id", F.round("score", 9).alias("score"), "place")


@query(f"""with {_VEC}, {_LISTS}, b as (select query_id, label, vec_id, round(score, 9) as score, row_number() over (partition by query_id, label order by round(score, 9) desc, vec_id) as n from fused)
select query_id, label, vec_id, score, place from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from b where n = 1) where place <= 5""")
def chapter_argmax(spark, d):
    hits = _fused(spark, d).select("query_id", "vec_id", F.col("label").cast("string").alias("chapter"), F.col("label"), F.round("score", 9).alias("score"))
    return R.best_of_group(hits, "chapter", "vec_id", 5).select("query_id", "label", "vec_id", "score", F.col("place").cast("long").alias("place"))


_HITS = f"""{_TOKENS}, {_kw_sql('metadata', 'rec_id')},
pool as (select * from (select *, row_number() over (partition by query_id order by score desc, rec_id) as rank from hits) where rank <= 25),
named as (select pool.*, chapter, book_id, chunk_id, coalesce(nullif(chapter, ''), chr(1) || rec_id) as g, (coalesce(chapter, '') = '')::int as tier from pool join metadata using (rec_id)),
best as (select * from (select *, row_number() over (partition by query_id, g order by score desc, rec_id) as n from named) where n = 1),
final as (select * from (select *, row_number() over (partition by query_id order by tier, score desc, rec_id) as place from best) where place <= 10)"""


def _final(spark, d):
    records = table(spark, d, "metadata")
    pool = R.top(R.keyword_hits(records, "rec_id", _questions(spark, d)), 25, "rec_id").drop("rank")
    named = pool.join(records.select("rec_id", "book_id", "chapter", "chunk_id"), "rec_id")
    return R.best_of_group(named, "chapter", "rec_id", 10)


@query(f"with {_HITS} select query_id, rec_id, score, cast(tier as bigint) as tier, place from final")
def unknown_chapter_backfill(spark, d):
    return _final(spark, d).select("query_id", "rec_id", "score", F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


_LATEST = "latest as (select * from (select *, row_number() over (partition by book_id, chunk_id order by loaded_at desc, rec_id desc) as no from metadata where book_id is not null and chunk_id is not null) where no = 1)"


@query(f"with {_HITS} select query_id, final.rec_id, m.parent_id, p.child_count from final join metadata m using (rec_id) left join parent_chunks p on m.parent_id = p.parent_id")
def parent_lookup_join(spark, d):
    hits = _final(spark, d).select("query_id", "rec_id")
    own = hits.join(table(spark, d, "metadata").select("rec_id", "parent_id"), "rec_id")
    return own.join(table(spark, d, "parent_chunks").select("parent_id", "child_count"), "parent_id", "left")


_EXPANDED = f"""with {_HITS}, {_LATEST},
own as (select query_id, place, f.book_id, f.chunk_id, l.chapter_id, l.parent_id from final f join latest l on f.book_id = l.book_id and f.chunk_id = l.chunk_id),
every as (select query_id, book_id, 'hit' as kind, cast(chunk_id as varchar) as id, 0 as tier, place, 0 as step from own
 union all select query_id, own.book_id, 'parent', own.parent_id, 1, place, 1 from own join parent_chunks p on own.book_id = p.book_id and own.parent_id = p.parent_id
 union all select query_id, own.book_id, 'neighbor', cast(l.chunk_id as varchar), 1, place, case when l.chunk_id < own.chunk_id then 2 else 3 end from own join latest l on l.book_id = own.book_id and l.chapter_id = own.chapter_id and l.chunk_id in (own.chunk_id - 1, own.chunk_id + 1)),
kept as (select * from (select *, row_number() over (partition by query_id, book_id, kind = 'parent', id order by tier, place, step) as n from every) where n = 1),
expanded as (select query_id, book_id, kind, id, row_number() over (partition by query_id order by tier, place, step, id) as ord from kept)"""


@query(f"{_EXPANDED} select query_id, book_id, kind, id, ord from expanded")
def expand_union_dedupe(spark, d):
    hits = cut_lineage(_final(spark, d).where("book_id is not null").select("query_id", "place", "book_id", "chunk_id").dropDuplicates(["query_id", "place"]))
    found = R.expand(hits, I.latest_records(table(spark, d, "metadata")), table(spark, d, "parent_chunks"))
    return found.withColumn("ord", F.col("ord").cast("long"))


@query(f"with {_HITS} select query_id, string_agg('[来源:' || coalesce(final.chapter, '') || ']' || chr(10) || m.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by place) as context from final join metadata m using (rec_id) group by query_id")
def context_assemble(spark, d):
    hits = _final(spark, d).join(table(spark, d, "metadata").select("rec_id", "text"), "rec_id")
    return R.context_text(hits, "chapter", "text", "place")


_HOLDS = "coalesce(list_position(list_transform(s.got, lambda k: contains(k.t, e.text) or contains(e.text, k.t)), true), 0)"
_LABEL = "case x.k " + " ".join(f"when '{k}' then '{v}'" for k, v in R.LABELS.items()) + " end"


@query(f"""{_EXPANDED},
newest as (select * from (select *, row_number() over (partition by book_id, chunk_id order by loaded_at desc, rec_id desc) as no from metadata where book_id is not null and chunk_id is not null) where no = 1),
texts as (select query_id, ord, kind, chapter, text from expanded e join newest l on kind <> 'parent' and l.book_id = e.book_id and l.chunk_id = cast(case when kind <> 'parent' then id end as int)
 union all select query_id, ord, 'parent', min(chapter), string_agg(text, '' order by n) from (select query_id, ord, e.book_id, unnest(child_chunk_ids) as chunk_id, unnest(range(0, len(child_chunk_ids))) as n from expanded e join parent_chunks p on kind = 'parent' and p.book_id = e.book_id and p.parent_id = e.id) m join newest l on l.book_id = m.book_id and l.chunk_id = m.chunk_id group by query_id, ord),
items as (select query_id, coalesce(nullif(chapter, ''), '未知') as chapter, min(ord) as seen, list({{'kind': kind, 'text': text, 'got': cast([] as struct(k varchar, t varchar)[])}} order by case kind when 'hit' then 0 when 'parent' then 1 else 2 end, ord, kind, text) as l from texts where text <> '' group by query_id, coalesce(nullif(chapter, ''), '未知')),
folded as (select query_id, chapter, seen, list_reduce(l, lambda s, e: {{'kind': e.kind, 'text': e.text, 'got': case when {_HOLDS} = 0 then list_append(s.got, {{'k': e.kind, 't': e.text}}) else list_transform(s.got, lambda k, i: case when i = {_HOLDS} and length(e.text) > length(k.t) then {{'k': e.kind, 't': e.text}} else k end) end}}, {{'kind': '', 'text': '', 'got': cast([] as struct(k varchar, t varchar)[])}}).got as got from items)
select query_id, string_agg(array_to_string(list_transform(got, lambda x: '[' || {_LABEL} || ':' || chapter || ']' || chr(10) || x.t), chr(10) || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by seen) as context from folded group by query_id""")
def context_expanded(spark, d):
    """One text of each question's hits with what stands around them."""
    records = I.latest_records(table(spark, d, "metadata")).select("book_id", "chapter", "chapter_id", "chunk_id", "parent_id", "text")
    parents = table(spark, d, "parent_chunks")
    hits = cut_lineage(_final(spark, d).where("book_id is not null").select("query_id", "place", "book_id", "chunk_id").dropDuplicates(["query_id", "place"]))
    found = cut_lineage(R.expand(hits, records, parents))
    chunks = found.where("kind <> 'parent'").withColumn("chunk_id", F.col("id").cast("int")).join(records, ["book_id", "chunk_id"]).select("query_id", "ord", "kind", "chapter", "text")
    members = found.where("kind = 'parent'").join(parents.select("book_id", F.col("parent_id").alias("id"), F.posexplode("child_chunk_ids").alias("n", "chunk_id")), ["book_id", "id"]).join(records, ["book_id", "chunk_id"])
    whole = members.groupBy("query_id", "ord", "kind").agg(F.min("chapter").alias("chapter"), F.array_join(F.array_sort(F.collect_list(F.struct("n", "text")))["text"], "").alias("text"))
    return R.expanded_context(chunks.unionByName(whole))


_QUERIES = f"""q as (select item_id as query_id, query_no - 1 as query_no, queries[query_no] as query from (select item_id, queries, unnest(range(1, len(queries) + 1)) as query_no from (
  select item_id, list_filter(l, lambda v, i: list_position(l, v) = i)[1:4] as queries from (
    select item_id, list_filter(list_transform(list_concat([question], coalesce(answer_terms, [])), lambda x: {strip_sql('x')}), lambda x: x is not null and x <> '') as l from eval_items where {_PICK})))),
w as (select query_id, query_no, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')) as w from q),
terms as (select query_id, query_no, w as term from w union select query_id, query_no, unnest(list_transform(range(1, greatest(length(w), 1)), lambda i: substring(w, i, 2))) from w where regexp_matches(w, '^[\\x{{4e00}}-\\x{{9fff}}]+$') and length(w) > 2),
kw as (select query_id, query_no, rec_id, cast(sum({_SCORE}) as double) as score from (select rec_id, lower(text) as t from metadata where text <> '') join terms on strpos(t, term) > 0 group by query_id, query_no, rec_id),
codes as (select rec_id, d, count(*)::double as n from (select rec_id, unicode(unnest(string_split(text, ''))) % 64 as d from metadata where text <> '') group by rec_id, d union all select rec_id, 0, 1.0 from metadata where text = ''),
asked as (select query_id, query_no, d, count(*)::double as n from (select query_id, query_no, unicode(unnest(string_split(query, ''))) % 64 as d from q) group by query_id, query_no, d),
rn as (select rec_id, sqrt(sum(n * n)) as len from codes group by rec_id), qn as (select query_id, query_no, sqrt(sum(n * n)) as len from asked group by query_id, query_no),
dots as (select query_id, query_no, rec_id, sum(asked.n * codes.n) as dot from asked join codes using (d) group by query_id, query_no, rec_id),
vec as (select query_id, query_no, rec_id, round(dot / qn.len / rn.len, 9) as score from dots join rn using (rec_id) join qn using (query_id, query_no))"""


def _multi_sql(kinds: tuple[str, ...], first_only: bool, reranked: bool) -> str:
    """Lists of 25, fused unless there is one only, cut to 15, the best of each chapter up to 5."""
    only = " where query_no = 0" if first_only else ""
    lists = " union all ".join({"vec": f"select query_id, query_no as list_no, rec_id, round_even(score, 4) as score, rank from (select *, row_number() over (partition by query_id, query_no order by score desc, rec_id) as rank from vec{only}) where rank <= 25 and score > 0.1", "kw": f"select query_id, 100 + query_no as list_no, rec_id, score, rank from (select *, row_number() over (partition by query_id, query_no order by score desc, rec_id) as rank from kw{only}) where rank <= 25"}[k] for k in kinds)
    new = "rank" if not reranked else "row_number() over (partition by query_id order by score desc, rank)"
    score = "score" if not reranked else "round_even(len(list_filter(list_distinct(string_split(question, '')), lambda c: contains(text, c))) / len(list_distinct(string_split(question, '')))::double, 4)"
    return f"""with {_QUERIES}, lists as ({lists}), n as (select query_id, count(distinct list_no) > 1 as several from lists group by query_id),
m as (select query_id, rec_id, sum(1e0 / (60 + rank)) as s, min({{'a': list_no, 'b': rank}}) as first, max(score) as own from lists group by query_id, rec_id),
f as (select query_id, rec_id, case when several then round(s, 6) else own end as score, row_number() over (partition by query_id order by case when several then round(s, 12) end desc, first) as rank from m join n using (query_id)),
c as (select f.query_id, f.rec_id, {score} as score, rank, chapter from f join metadata using (rec_id) join (select query_id, query as question from q where query_no = 0) using (query_id) where rank <= 15),
r as (select query_id, rec_id, score, {new} as rank, chapter from c),
b as (select *, (coalesce(chapter, '') = '')::int as tier, row_number() over (partition by query_id, coalesce(nullif(chapter, ''), chr(1) || rec_id) order by score desc, rank) as n from r)
select query_id, rec_id, chapter, score, place from (select *, row_number() over (partition by query_id order by tier, score desc, rank) as place from b where n = 1) where place <= 5"""


def _asked(spark, d):
    """The question and up to three of its item's terms as further queries."""
    items = table(spark, d, "eval_items").where(F.expr(_PICK))
    return items.select(F.col("item_id").alias("query_id"), F.posexplode(E.merge_queries(F.col("question"), F.col("answer_terms"))).alias("query_no", "query"))


def _encode(text):
    return R.hash_encode(text, unit=False)


def _found(hits):
    return hits.select("query_id", "rec_id", "chapter", "score", F.col("place").cast("long").alias("place"))


@query(_multi_sql(("vec", "kw"), False, False))
def retrieve_multi(spark, d):
    """Question and rewrites, each by vectors of a stand-in encoder and by keywords, all lists fused."""
    return _found(R.retrieve_multi(_asked(spark, d), table(spark, d, "metadata"), "rec_id", 5, _encode))


@query(_multi_sql(("vec", "kw"), False, True))
def rerank_order(spark, d):
    """The same with a stand-in reranker over the fused pool."""
    return _found(R.retrieve_multi(_asked(spark, d), table(spark, d, "metadata"), "rec_id", 5, _encode, R.shared_characters))


@query(_multi_sql(("kw",), True, False))
def single_list_bypass(spark, d):
    """One query and no encoder leave one list, which keeps its scores."""
    return _found(R.retrieve_multi(_asked(spark, d).where("query_no = 0"), table(spark, d, "metadata"), "rec_id", 5))


@query(_multi_sql(("vec", "kw"), True, False))
def hybrid_retrieve(spark, d):
    """Vectors and keywords of the question alone."""
    return _found(R.retrieve_multi(_asked(spark, d).where("query_no = 0"), table(spark, d, "metadata"), "rec_id", 5, _encode))


@query(f"""with {_QUERIES}, l as (select query_id, query_no as list_no from vec where score > 0.1 union select query_id, 100 + query_no from kw),
k as (select query_id, count(*) as lists, max((list_no < 100)::int) as v, max((list_no >= 100)::int) as w from l group by query_id)
select query_id, count(*) as queries, coalesce(max(lists), 0) as lists, case when max(v) = 1 and max(w) = 1 then 'both' when max(v) = 1 then 'vectors' when max(w) = 1 then 'keywords' else 'none' end as mode from q left join k using (query_id) group by query_id""")
def retrieval_status(spark, d):
    asked = _asked(spark, d)
    return R.retrieval_status(asked, R.query_lists(asked, table(spark, d, "metadata"), "rec_id", 25, _encode))
