"""Chunking and index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import chunking as K
from quillspark.operators import index as I
from quillspark.operators import splitters
from quillspark.plans.registry import W, query, strip_sql
from quillspark.plans.structure import BODIES
from quillspark.session import table


def _placed(chunks):
    return chunks.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


def _records(spark, d):
    return table(spark, d, "metadata")


@query("""
with m as (select rec_id, coalesce(text, '') as text from metadata),
c as (select rec_id, length(text) as n, length(regexp_replace(text, '[^\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]', '', 'g')) as han,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters, len(regexp_extract_all(text, '[A-Za-z]+')) as words from m)
select rec_id, cast(round_even((han * 0.72::double + words * 1.3::double) + greatest(0, n - han - letters) * 0.35::double, 0) as bigint) as tokens from c""")
def token_estimate(spark, d):
    return _records(spark, d).select("rec_id", T.estimate_tokens("text").alias("tokens"))


@query("""
select doc_id, cast(no + 1 as bigint) as chunk_no, substring(text, cast(no * 462 + 1 as bigint), 512) as chunk
from (select doc_id, text, unnest(range(0, cast(greatest(0, ceil((length(text) - 50) / 462.0) - 1) as bigint) + 1)) as no from documents where length(text) > 0)""")
def chunk_fixed(spark, d):
    return K.chunk_fixed(table(spark, d, "documents"), "doc_id", 512, 50).withColumn("chunk_no", F.col("chunk_no").cast("long"))


_FIRST, _SECOND = "。！：？", "；;：:，,、"


def _upto(text: str, signs: str) -> str:
    """Characters up to the first of the signs; 0 without one."""
    return f"length(regexp_extract({text}, '^[^{signs}]*[{signs}]'))"


def _lesser_sql(low: str, high: str) -> str:
    """A cut after the first clause sign of the window, else after its first white space; null without either."""
    clause, rest = _upto(f"substring(text, {low} + 1, {high} - {low})", _SECOND), f"substring(text, {low} + 1)"
    word, gap = f"length(regexp_extract({rest}, '^[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*'))", f"length(regexp_extract({rest}, '^[^\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*{W}+'))"
    return f"case when {clause} > 0 then {low} + {clause} when {gap} > 0 and {word} < {high} - {low} then {low} + {gap} end"


def _recursive_sql(targeted: bool, overlap: int, source: str = "documents where text is not null", key: str = "doc_id", before: str = "") -> str:
    """Chunks c of texts, each found from where the one before it was cut."""
    if targeted:
        right, left = _upto("substring(text, aim + 1, high - aim)", _FIRST), f"length(regexp_extract(substring(text, low + 1, aim - low), '(?s)^.*[{_FIRST}]'))"
        found = f"case when {right} > 0 and ({left} = 0 or {right} - 1 <= aim - (low + {left} - 1)) then aim + {right} when {left} > 0 then low + {left} end"
        back = f"least(greatest({overlap}, cast(floor((cut - start) * 0.125::double) as bigint)), 671)"
    else:
        first = _upto("substring(text, low + 1, high - low)", _FIRST)
        found, back = f"case when {first} > 0 then low + {first} end", str(overlap)
    window = "select *, least(n, start + 672) as high, greatest(start + 210, last) as low from c where not done and start < n"
    aimed = f"select *, least(greatest(start + 560, low), high) as aim from ({window})"
    cut = f"select *, case when n - start <= 210 then n else coalesce({found}, {_lesser_sql('low', 'high')}, high) end as cut from ({aimed})"
    step = f"select {key}, text, n, start as a, case when cut <= start then high else cut end as b, n - start <= 210 or cut >= n as done, greatest(cut - {back}, start + 1) as start, cut as last from ({cut})"
    return f"""with recursive {before} c as (
select {key}, text, length(text)::bigint as n, null::bigint as a, null::bigint as b, false as done, 0::bigint as start, 0::bigint as last from {source}
union all {step}),
chunks as (select {key}, cast(row_number() over (partition by {key} order by a) as integer) as chunk_no, cast(a as integer) as start_pos, cast(b as integer) as end_pos, substring(text, a + 1, b - a) as chunk from c where a is not null and {strip_sql('substring(text, a + 1, b - a)')} <> '')"""


@query(_recursive_sql(False, 50) + ' select doc_id, chunk_no, start_pos, end_pos, chunk from chunks')
def chunk_recursive(spark, d):
    return _placed(K.chunk_recursive(table(spark, d, "documents"), ["doc_id"]))


@query(_recursive_sql(True, 50) + ' select doc_id, chunk_no, start_pos, end_pos, chunk from chunks')
def chunk_recursive_target(spark, d):
    return _placed(K.chunk_recursive(table(spark, d, "documents"), ["doc_id"], targeted=True))


@query(_recursive_sql(False, 50, "chapters", "doc_id, chapter_id", BODIES + ", ") + ' select doc_id, chapter_id, chunk_no, start_pos, end_pos, chunk from chunks')
def chunk_by_chapter(spark, d):
    return _placed(K.chunk_by_chapter(table(spark, d, "documents").select("doc_id", "text")))


def _runs_sql(signs: str, closers: str = "") -> str:
    """Begin, end of signs and end of each run of signs with what closes after them, as a list."""
    parts = f"regexp_extract_all(text, '[^{signs}]*[{signs}]+{f'[{closers}]*' if closers else ''}')"
    steps = f"list_transform({parts}, lambda p: {{'n': length(p)::bigint, 's': length(regexp_extract(p, '[{signs}]+{f'[{closers}]*$' if closers else '$'}'))::bigint, 'c': {f"length(regexp_extract(p, '[{closers}]*$'))::bigint" if closers else '0::bigint'}, 'at': 0::bigint, 'got': cast([] as struct(a bigint, b bigint, e bigint)[])}})"
    fold = "lambda s, e: {'n': e.n, 's': e.s, 'c': e.c, 'at': s.at + e.n, 'got': list_append(s.got, {'a': s.at + e.n - e.s, 'b': s.at + e.n - e.c, 'e': s.at + e.n})}"
    return f"list_reduce({steps}, {fold}, {{'n': 0::bigint, 's': 0::bigint, 'c': 0::bigint, 'at': 0::bigint, 'got': cast([] as struct(a bigint, b bigint, e bigint)[])}}).got"


def _whole_sql(part: str) -> str:
    return "(" + " and ".join(f"length(replace({part}, '{a}', '')) = length(replace({part}, '{b}', ''))" for a, b in splitters.PAIRS) + ")"


def _near_sql(runs: str, level: int) -> str:
    """The nearest place to the aim, of the nearest eight, up to which all pairs are closed."""
    inside = f"list_filter({runs}, lambda r: r.a < high and greatest(r.a, low) < least(r.b, high))"
    place = "least(r.e, high)" if level else "least(high, least(r.e, high) + length(regexp_extract(substring(text, least(r.e, high) + 1, greatest(high - least(r.e, high), 0)), '^[ \\t]*')))"
    places = f"list_filter(list_transform({inside}, lambda r: {place}), lambda p: p > low)"
    ranked = f"list_transform(list_sort(list_transform({places}, lambda p: {{'d': abs(p - aim), 'p': p}}))[1:8], lambda x: x.p)"
    return f"list_filter({ranked}, lambda p: {_whole_sql('substring(text, start + 1, p - start)')})[1]"


def _tokenwise_sql(source: str, key: str, before: str = "") -> str:
    """Chunks near the aimed length, each begun an overlap back, at a sentence's begin if that is near enough; a short last one goes to the one before."""
    closers = splitters.CLOSERS.replace("'", "''")
    closing = "least(" + ", ".join(f"coalesce(nullif(strpos(substring(text, aim + 1, greatest(least(high + 30, n) - aim, 0)), '{c if c != chr(39) else chr(39) * 2}'), 0), 100000)" for c in splitters.CLOSERS) + ")"
    seed = f"select {key}, text, length(text)::bigint as n, {_runs_sql(chr(10))} as r0, {_runs_sql('。！？…；!?;', '”’」』）】')} as r1, {_runs_sql('，、：,:')} as r2, null::bigint as a, null::bigint as b, false as done, 0::bigint as start from {source}"
    window = "select *, least(n, start + 672) as high, start + 210 as low from c where not done and start < n"
    aimed = f"select *, least(greatest(start + 560, low), high) as aim from ({window})"
    near = f"select *, case when high <= low then high else coalesce({_near_sql('r0', 0)}, {_near_sql('r1', 1)}, {_near_sql('r2', 2)}) end as found from ({aimed})"
    hard = f"case when {_whole_sql('substring(text, start + 1, aim - start)')} or {closing} = 100000 then aim else aim + {closing} end"
    cut = f"select *, case when n - start <= 210 then n else coalesce(found, {hard}) end as cut from ({near})"
    size = f"select *, least(greatest(50, cast(round_even((cut - start) * 0.125::double, 0) as bigint)), 100) as size from ({cut})"
    back = f"select *, greatest(cut - size, start) as place from ({size})"
    stop = f"select *, start + length(regexp_extract(substring(text, start + 1, place - start), '(?s)^.*[。！？…]')) as stop from ({back})"
    begin = f"select *, stop + length(regexp_extract(substring(text, stop + 1, cut - stop), '^[{closers}]*')) as begin from ({stop})"
    step = f"select {key}, text, n, r0, r1, r2, start as a, cut as b, n - start <= 210 or cut >= n as done, greatest(case when stop > start and begin > start and cut - begin <= cast(floor(size * 1.5::double) as bigint) + 20 then begin else place end, start + 1) as start from ({begin})"
    bare = strip_sql("substring(text, a + 1, b - a)")
    return f"""with recursive {before} c as ({seed} union all {step}),
cut_ as (select {key}, text, a, b, length({bare}) as size from c where a is not null and {bare} <> ''),
near_ as (select *, row_number() over w as no, count(*) over (partition by {key}) as most, lead(size) over w as next_size, lead(b) over w as next_b, lag(size) over w as last_size from cut_ window w as (partition by {key} order by a)),
joined_ as (select {key}, text, a, case when no = most - 1 and next_size < 210 and next_size + size <= 672 then next_b else b end as b from near_ where not (no = most and no > 1 and size < 210 and size + last_size <= 672)),
pieces as (select {key}, cast(row_number() over (partition by {key} order by a) as integer) as chunk_no, cast(a as integer) as start_pos, cast(b as integer) as end_pos, {bare} as chunk from joined_)"""


@query(_tokenwise_sql("documents where text is not null", "doc_id") + ' select doc_id, chunk_no, start_pos, end_pos, chunk from pieces')
def chunk_tokenwise(spark, d):
    return _placed(K.chunk_tokenwise(table(spark, d, "documents"), ["doc_id"]))


@query(f"""with recursive c as (
select doc_id, text, length(text)::bigint as n, null::bigint as a, null::bigint as b, 0::bigint as start from documents where text is not null
union all select doc_id, text, n, start as a, cut as b, cut as start from (
  select *, case when n - start <= 300 then n else coalesce({_lesser_sql('low', 'high')}, high) end as cut from (select *, start + 300 as high, start + 100 as low from c where start < n)))
select doc_id, cast(row_number() over (partition by doc_id order by a) as integer) as chunk_no, cast(a as integer) as start_pos, cast(b as integer) as end_pos, substring(text, a + 1, b - a) as chunk
from c where a is not null and {strip_sql('substring(text, a + 1, b - a)')} <> ''""")
def chunk_oversized(spark, d):
    return _placed(K.cut_texts(table(spark, d, "documents"), ["doc_id"], lambda t: splitters.oversized(t, 300, 100)))


@query(_recursive_sql(False, 0) + """ select doc_id, chunk_no, start_pos, end_pos, coalesce(regexp_extract(lag(chunk) over (partition by doc_id order by chunk_no), '(?s)([^。！？!?]*[。！？!?]|[^。！？!?]+)$'), '') || chunk as chunk from chunks""")
def chunk_sentences(spark, d):
    s = splitters.Spec()
    cut = K.cut_texts(table(spark, d, "documents"), ["doc_id"], lambda t: splitters.recursive(t, s.min_chars, s.max_chars, 0))
    return _placed(K.with_last_sentences(cut, ["doc_id"], 1))


def _tokens_sql(x: str) -> str:
    han, letters = f"length(regexp_replace({x}, '[^\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}]', '', 'g'))", f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
    return f"cast(round_even(({han} * 0.72::double + len(regexp_extract_all({x}, '[A-Za-z]+')) * 1.3::double) + greatest(0, length({x}) - {han} - {letters}) * 0.35::double, 0) as bigint)"


_BUILT = f"""{_tokenwise_sql("chapters", "doc_id, chapter_id", BODIES + ", ")},
el as (select doc_id, chapter_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from chapters),
eb as (select *, {strip_sql('line')} = '' as blank, coalesce(sum(length(line) + 1) over (partition by doc_id, chapter_id order by line_no rows between unbounded preceding and 1 preceding), 0) as off from el),
ei as (select *, sum(blank::int) over (partition by doc_id, chapter_id order by line_no) as island from eb),
es as (select *, row_number() over (partition by doc_id, chapter_id order by island) as scene_no from (select doc_id, chapter_id, island, string_agg(line, chr(10) order by line_no) as text, min(off) as start from ei where not blank group by doc_id, chapter_id, island)),
placed as (select p.*, ch.title, ch.hash, ch.start as chapter_start, row_number() over (partition by p.doc_id order by cast(substring(p.chapter_id, 2) as int), chunk_no) as chunk_id, max(chunk_no) over (partition by p.doc_id, p.chapter_id) as most,
  coalesce((select max(scene_no) from es where es.doc_id = p.doc_id and es.chapter_id = p.chapter_id and es.start <= p.start_pos), 1) as scene_no from pieces p join chapters ch on ch.doc_id = p.doc_id and ch.chapter_id = p.chapter_id),
told as (select placed.*, left(regexp_extract({strip_sql(f"regexp_replace(es.text, '{W}+', ' ', 'g')")}, '^([^。！？…；]*[。！？…；]?)', 1), 40) as summary from placed join es on es.doc_id = placed.doc_id and es.chapter_id = placed.chapter_id and es.scene_no = placed.scene_no),
lead_in as (select *, concat_ws('｜', nullif(title, ''), nullif(summary, '')) as p from told),
g as (select doc_id, chapter_id, chunk_no, length(chunk)::bigint as x, 1 as no, 1 as n, length(chunk)::bigint as t from told where chunk_no = 1
 union all select doc_id, chapter_id, chunk_no, x, case when closed then no + 1 else no end, case when closed then 1 else n + 1 end, case when closed then x else t + x end from (
  select o.doc_id, o.chapter_id, o.chunk_no, length(o.chunk)::bigint as x, g.no, g.n, g.t, g.n >= 4 or g.t + length(o.chunk) > 1500 or (g.t >= 800 and g.n >= 2) as closed from g join told o on o.doc_id = g.doc_id and o.chapter_id = g.chapter_id and o.chunk_no = g.chunk_no + 1)),
gs as (select doc_id, chapter_id, no, count(*) as n, sum(x) as t, max(no) over (partition by doc_id, chapter_id) as most from g group by doc_id, chapter_id, no),
gj as (select l.doc_id, l.chapter_id, l.no from gs l join gs b on l.doc_id = b.doc_id and l.chapter_id = b.chapter_id and b.no = l.no - 1 where l.no = l.most and l.n + b.n <= 4 and l.t + b.t <= 1500),
gf as (select g.doc_id, g.chapter_id, g.chunk_no, case when gj.no is null then g.no else g.no - 1 end as place from g left join gj on g.doc_id = gj.doc_id and g.chapter_id = gj.chapter_id and g.no = gj.no)
select l.doc_id, cast(null as varchar) as book_title, l.chapter_id, title as chapter, hash as chapter_hash, l.chapter_id || '_s' || scene_no as scene_id, summary as scene_summary, l.chunk_no as chunk_index, cast(chunk_id as integer) as chunk_id, chunk as text, case when p = '' then '' else p || chr(10) end as prefix,
 cast(length(chunk) as integer) as chunk_length, {_tokens_sql('chunk')} as token_count, {_tokens_sql("(case when p = '' then '' else p || chr(10) end || chunk)")} as total_token_count, cast(chapter_start + l.start_pos as bigint) as start_pos, cast(chapter_start + l.end_pos as bigint) as end_pos,
 cast(case when l.chunk_no > 1 then chunk_id - 1 end as integer) as prev_chunk_id, cast(case when l.chunk_no < most then chunk_id + 1 end as integer) as next_chunk_id, l.doc_id || '_p' || min(chunk_id) over (partition by l.doc_id, l.chapter_id, place) as parent_id
from lead_in l join gf on gf.doc_id = l.doc_id and gf.chapter_id = l.chapter_id and gf.chunk_no = l.chunk_no"""


@query(_BUILT)
def build_chunks(spark, d):
    return K.build_chunks(table(spark, d, "documents").select("doc_id", "text"))


_LATEST = "(select * from (select *, row_number() over (partition by book_id, chunk_id order by loaded_at desc, rec_id desc) as no from metadata where book_id is not null and chunk_id is not null) where no = 1)"



_KEEP = f"(select * exclude no from {_LATEST} union all select * from metadata where book_id is null or chunk_id is null)"
#: A chapter's chunks in order; each joins the open parent or closes it.
_GROUPS = f"""with recursive o as (
select book_id, chapter_id, chunk_id, coalesce(chunk_length, 0) as x, row_number() over (partition by book_id, chapter_id order by chunk_id nulls first, coalesce(chunk_length, 0)) as i from {_KEEP} where book_id is not null),
g as (select book_id, chapter_id, chunk_id, x, i, 1 as no, 1 as n, x::bigint as t from o where i = 1
 union all select book_id, chapter_id, chunk_id, x, i, case when closed then no + 1 else no end, case when closed then 1 else n + 1 end, case when closed then x else t + x end from (
  select o.*, g.no, g.n, g.t, g.n >= 4 or g.t + o.x > 1500 or (g.t >= 800 and g.n >= 2) as closed from g join o on o.book_id = g.book_id and o.chapter_id is not distinct from g.chapter_id and o.i = g.i + 1)),
s as (select book_id, chapter_id, no, count(*) as n, sum(x) as t, max(no) over (partition by book_id, chapter_id) as most from g group by book_id, chapter_id, no),
j as (select l.book_id, l.chapter_id, l.no from s l join s b on l.book_id = b.book_id and l.chapter_id is not distinct from b.chapter_id and b.no = l.no - 1 where l.no = l.most and l.n + b.n <= 4 and l.t + b.t <= 1500),
f as (select g.*, case when j.no is null then g.no else g.no - 1 end as place from g left join j on g.book_id = j.book_id and g.chapter_id is not distinct from j.chapter_id and g.no = j.no)
select book_id, chapter_id, cast(place as integer) as parent_no, list(chunk_id order by i) as child_chunk_ids, cast(count(*) as integer) as child_count, cast(sum(x) as bigint) as chunk_length from f group by book_id, chapter_id, place"""


@query(_GROUPS)
def parent_chunks(spark, d):
    latest = I.latest_records(_records(spark, d)).where("book_id is not null")
    return K.build_parents(latest, ["book_id", "chapter_id"])


@query(f"select rec_id, book_id, chunk_id from {_LATEST} union all select rec_id, book_id, chunk_id from metadata where book_id is null or chunk_id is null")
def latest_records(spark, d):
    return I.latest_records(_records(spark, d)).select("rec_id", "book_id", "chunk_id")


@query("select rec_id, lag(chunk_id) over w as prev_id, lead(chunk_id) over w as next_id from metadata window w as (partition by book_id, chapter_id order by chunk_id, rec_id)")
def prev_next_links(spark, d):
    return I.links(_records(spark, d))


@query("""
with v as (select book_id, chunk_length as x, row_number() over (partition by book_id order by chunk_length) as no, count(*) over (partition by book_id) as n from metadata where chunk_length is not null)
select book_id, n, min(x) as least, max(case when no = n // 2 + 1 then x end) as median, max(x) as most from v group by book_id, n""")
def chunk_stats(spark, d):
    return I.upper_median(_records(spark, d), "book_id", "chunk_length")


@query("select rec_id, cast(greatest(50, floor(length(text) * 0.125::double)) as bigint) as overlap from metadata where text is not null")
def overlap_len(spark, d):
    return _records(spark, d).where("text is not null").select("rec_id", F.greatest(F.lit(50), F.floor(F.length("text") * F.lit(0.125))).cast("long").alias("overlap"))


@query("""
select rec_id, case when p = '' then '' else p || chr(10) end as prefix from (
  select rec_id, concat_ws(' ', case when book_title <> '' then '《' || book_title || '》' end, nullif(concat_ws('｜', nullif(chapter, ''), nullif(scene_summary, '')), '')) as p from metadata)""")
def chunk_prefix(spark, d):
    return _records(spark, d).select("rec_id", K.prefix(F.col("book_title"), F.col("chapter"), F.col("scene_summary")).alias("prefix"))


_OLD = "(select book_id, chapter_id, chapter_hash, chunk_index, min(vec_id) as vec_id from previous_index where embeddings is not null group by all)"


@query(f"select rec_id, vec_id from metadata left join {_OLD} using (book_id, chapter_id, chapter_hash, chunk_index)")
def reuse_join(spark, d):
    return I.reuse(_records(spark, d), table(spark, d, "previous_index"))


@query(f"select rec_id from metadata anti join {_OLD} using (book_id, chapter_id, chapter_hash, chunk_index)")
def pending_anti(spark, d):
    return I.pending(_records(spark, d), table(spark, d, "previous_index")).select("rec_id")


@query(f"""select book_id, chapter_id, chapter_hash, count(*) as chunk_count from (select book_id, chapter_id, chapter_hash from {_LATEST} union all select book_id, chapter_id, chapter_hash from metadata where book_id is null or chunk_id is null) group by all""")
def chapter_manifest(spark, d):
    return I.manifest(_records(spark, d))


@query("""
with newest as (select book_id, chapter_id, max(generated_at) as at from chapter_index group by all),
m as (select distinct c.book_id, c.chapter_id, c.chapter_hash, c.chunk_count from chapter_index c join newest n on c.book_id = n.book_id and c.chapter_id = n.chapter_id and c.generated_at = n.at)
select book_id, chapter_id, count(*) as stale from previous_index p where not exists (select 1 from m where m.book_id = p.book_id and m.chapter_id = p.chapter_id and m.chapter_hash = p.chapter_hash) group by all""")
def stale_vectors(spark, d):
    """Vectors of chapters whose newest build has another hash, by chapter."""
    index = table(spark, d, "chapter_index")
    newest = index.groupBy("book_id", "chapter_id").agg(F.max("generated_at").alias("generated_at"))
    now = index.join(newest, ["book_id", "chapter_id", "generated_at"], "left_semi").select("book_id", "chapter_id", "chapter_hash").distinct()
    return table(spark, d, "previous_index").join(now, ["book_id", "chapter_id", "chapter_hash"], "left_anti").groupBy("book_id", "chapter_id").agg(F.count(F.lit(1)).alias("stale"))


@query("""
select book_id, chapter, max_by(rec_id, (length(text), -rec_id)) as rec_id, max(length(text)) as chars from metadata where text is not null and chapter <> '' group by book_id, chapter""".replace("max_by(rec_id, (length(text), -rec_id))", "arg_max(rec_id, length(text) * 1000000000000 - rec_id)"))
def longest_per_chapter(spark, d):
    best = F.max(F.struct(F.length("text").cast("long").alias("chars"), (-F.col("rec_id")).alias("id")))
    return _records(spark, d).where("text is not null and chapter <> ''").groupBy("book_id", "chapter").agg(best.alias("b")).select("book_id", "chapter", (-F.col("b.id")).alias("rec_id"), F.col("b.chars").alias("chars"))
