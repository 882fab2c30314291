"""Structure of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as C
from quillspark.operators import structure as S
from quillspark.plans.registry import W, query, strip_sql
from quillspark.session import spread, table

_L = "string_split(text, chr(10))"
_TITLE = f"(length({strip_sql('line')}) <= 32 and not contains({strip_sql('line')}, '。') and regexp_matches({strip_sql('line')}, '{C.TITLE}'))"
_EACH = f"each as (select doc_id, unnest({_L}) as line, unnest(range(0, len({_L}))) as line_no from documents where text is not null)"
_DIGIT = "case c " + " ".join(f"when '{k}' then {v}" for k, v in S.DIGITS.items()) + " end"


def number_sql(title: str) -> str:
    """Numbers up to 9999 by place; larger ones by their part before 万."""
    raw = f"regexp_extract({strip_sql(title)}, '{S.NUMBER}', 1)"

    def part(x: str) -> str:
        of = lambda place: f"case when contains({x}, '{place}') then coalesce({_value(f'''right(regexp_extract({x}, '(.?){place}', 1), 1)''')}, 1) else 0 end"
        return f"(1000 * {of('千')} + 100 * {of('百')} + 10 * {of('十')} + coalesce({_value(f'right({x}, 1)')}, 0))"

    return f"(case when regexp_matches({raw}, '^[0-9]{{1,15}}$') then cast({raw} as bigint) when {raw} = '' then null when contains({raw}, '万') then 10000 * {part(f'''split_part({raw}, '万', 1)''')} + {part(f'''split_part({raw}, '万', 2)''')} else {part(raw)} end)"


def _value(c: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in S.DIGITS.items() if v) + " else null end"


_HEADS = f"""titles as (select doc_id, line_no, {strip_sql('line')} as title, {number_sql('line')} as number from each where {_TITLE}),
kept as (select * from (select *, max(number) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as highest from titles) where number is null or number >= coalesce(highest, 0)),
heads as (select doc_id, line_no, title from (select *, line_no - lag(line_no) over (partition by doc_id order by line_no) as gap from kept) where gap is null or gap > 1)"""


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(f"with {_EACH} select doc_id, line_no, {strip_sql('line')} as title from each where {_TITLE}")
def title_flag(spark, d):
    return S.numbered_lines(_documents(spark, d)).where(C.is_title("line")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.strip("line").alias("title"))


@query(f"select distinct chapter_title, cast({number_sql('chapter_title')} as bigint) as number from chapter_index where chapter_title is not null")
def cn_numerals(spark, d):
    return table(spark, d, "chapter_index").where("chapter_title is not null").select("chapter_title", S.chapter_number("chapter_title").alias("number")).distinct()


@query(f"""with {_EACH}, {_HEADS}
select doc_id, line_no as start_line, coalesce(lead(line_no) over (partition by doc_id order by line_no), n) as end_line, title
from heads join (select doc_id, len({_L}) as n from documents where text is not null) using (doc_id)""")
def chapter_boundaries(spark, d):
    return S.chapter_boundaries(_documents(spark, d)).select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "title")


@query(f"""with {_EACH}, {_HEADS},
m as (select each.doc_id, each.line_no, length(line) as n, title from each left join heads on each.doc_id = heads.doc_id and each.line_no = heads.line_no),
p as (select *, coalesce(last_value(title ignore nulls) over w, '正文') as chapter, count(title) over w as chapter_no from m window w as (partition by doc_id order by line_no rows between unbounded preceding and current row))
select doc_id, chapter_no, chapter, count(*) as lines, cast(sum(n) as bigint) as chars from p where title is null group by doc_id, chapter_no, chapter""")
def line_to_chapter(spark, d):
    placed = S.lines_in_chapters(_documents(spark, d))
    return placed.groupBy("doc_id", "chapter_no", "chapter").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line").cast("long")).alias("chars"))


_SCENES = f"""{_EACH},
b as (select *, {strip_sql('line')} = '' as blank, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as off from each),
i as (select *, sum(blank::int) over (partition by doc_id order by line_no) as island from b),
s as (select doc_id, island, string_agg(line, chr(10) order by line_no) as text, min(off) as start from i where not blank group by doc_id, island)"""


@query(f"with {_SCENES} select doc_id, cast(row_number() over (partition by doc_id order by island) as bigint) as scene_no, text, cast(start as bigint) as start from s")
def scene_split(spark, d):
    return S.scenes(_documents(spark, d)).select("doc_id", F.col("scene_no").cast("long").alias("scene_no"), "text", F.col("start").cast("long").alias("start"))


@query(f"select doc_id, left(regexp_extract({strip_sql(f'''regexp_replace(text, '{W}+', ' ', 'g')''')}, '^([^。！？…；]*[。！？…；]?)', 1), 40) as summary from documents where text is not null")
def scene_summary(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", S.scene_summary("text").alias("summary"))


@query("select doc_id, left(md5(text), 16) as hash from documents where text is not null")
def chapter_hash(spark, d):
    return _documents(spark, d).where("text is not null").select("doc_id", S.chapter_hash("text").alias("hash"))


BODIES = f"""{_EACH}, {_HEADS},
m as (select each.doc_id, each.line_no, line, title from each left join heads on each.doc_id = heads.doc_id and each.line_no = heads.line_no),
p as (select *, coalesce(last_value(title ignore nulls) over w, '正文') as chapter, count(title) over w as chapter_no from m window w as (partition by doc_id order by line_no rows between unbounded preceding and current row)),
b as (select doc_id, chapter_no, min(chapter) as title, regexp_replace(regexp_replace(string_agg(regexp_replace(line, '{W}+$', ''), chr(10) order by line_no), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as text from p where title is null group by doc_id, chapter_no),
chapters as (select doc_id, 'c' || row_number() over w as chapter_id, title, text, left(md5(text), 16) as hash, cast(coalesce(sum(length(text) + 2) over (partition by doc_id order by chapter_no rows between unbounded preceding and 1 preceding), 0) as bigint) as start from b where {strip_sql('text')} <> '' window w as (partition by doc_id order by chapter_no))"""


@query(f'with {BODIES} select doc_id, chapter_id, title, text, hash, start as start_pos, start + length(text) as end_pos from chapters')
def parse_structure(spark, d):
    return S.parse_structure(_documents(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(f"""select doc_id, list_filter(list_transform(({_L})[1:5], lambda l: {strip_sql('l')}), lambda l: regexp_matches(l, '^第[^\\n]+'))[1] as title from documents where text is not null""")
def first_title(spark, d):
    """The first of the first five lines that begins like a heading."""
    first = F.filter(F.transform(F.slice(T.lines("text"), 1, 5), T.strip), lambda x: x.rlike("^第[^\n]+"))
    return _documents(spark, d).where("text is not null").select("doc_id", F.get(first, 0).alias("title"))
