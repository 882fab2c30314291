"""Cleaning rules over all chunk records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cleaning as C
from quillspark.plans.registry import W, query, quoted, strip_sql
from quillspark.session import spread, table

LINES = "string_split(text, chr(10))"
_TITLE_SQL = f"(length({strip_sql('l')}) <= 32 and not contains({strip_sql('l')}, '。') and regexp_matches({strip_sql('l')}, '{C.TITLE}'))"


def _records(spark, d):
    return spread(table(spark, d, "metadata").where("text is not null").select("rec_id", "text"), "rec_id")


def _each(spark, d, rule):
    return _records(spark, d).select("rec_id", rule.alias("out"))


def _fold(pairs, x):
    for a, b in pairs:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


_ENCODING = [(a + x, b + x) for a, b, after in (("入", "人", C.AFTER_REN), ("夭", "天", C.AFTER_TIAN), ("竞", "竟", C.AFTER_JING)) for x in after] + [("镇龘压", "镇压"), ("镇龘", "镇"), *C.RARE_CHARACTERS.items()]


@query(f"select rec_id, {_fold(_ENCODING, 'text')} as out from metadata where text is not null")
def fix_encoding(spark, d):
    return _each(spark, d, C.fix_encoding("text"))


@query(f"select rec_id, {_fold(C.SYLLABLES.items(), 'text')} as out from metadata where text is not null")
def remove_pinyin(spark, d):
    return _each(spark, d, C.remove_pinyin("text"))


@query(f"select rec_id, array_to_string(list_filter({LINES}, lambda l: {strip_sql('l')} <> ''), chr(10)) as out from metadata where text is not null")
def drop_blank_lines(spark, d):
    return _each(spark, d, C.remove_empty_lines("text"))


@query(f"select rec_id, array_to_string(list_filter({LINES}, lambda l: not regexp_matches({strip_sql('l')}, '{C.PAGE_LINE}')), chr(10)) as out from metadata where text is not null")
def drop_page_numbers(spark, d):
    return _each(spark, d, C.remove_page_numbers("text"))


_MARKERS = "(" + " or ".join(f"contains(x, {quoted(m)})" for m in C.SITE_MARKERS) + ")"
_REST = f"regexp_replace(regexp_replace({strip_sql('l')}, '{C.TRAILING_BRACKET}', ''), '{W}+$', '')"


@query(f"""
with l as (select rec_id, unnest({LINES}) as l, unnest(range(1, len({LINES}) + 1)) as line_no from metadata where text is not null),
r as (select rec_id, line_no, {strip_sql('l')} as x from l)
select rec_id, cast(line_no as bigint) as line_no from r where x <> '' and length(x) <= 200 and {_MARKERS}
""")
def site_line_flags(spark, d):
    each = _records(spark, d).select("rec_id", F.posexplode(T.lines("text")).alias("at", "line"))
    return each.where(C.is_site_line(T.strip("line"))).select("rec_id", (F.col("at") + 1).cast("long").alias("line_no"))


@query(f"""
select rec_id, array_to_string(list_transform(list_filter(list_transform({LINES}, lambda l: {{'own': l, 'x': {_REST}}}),
  lambda p: {strip_sql('p.own')} = '' or (p.x <> '' and not (length(p.x) <= 200 and {_MARKERS.replace('(x,', '(p.x,')}))),
  lambda p: case when {strip_sql('p.own')} = '' then p.own else p.x end), chr(10)) as out
from metadata where text is not null
""")
def remove_ads(spark, d):
    return _each(spark, d, C.remove_ads("text"))


@query(f"""
with l as (select rec_id, unnest({LINES}) || case when rec_id % 3 = 0 then '（本章未完，请收藏）' when rec_id % 3 = 1 then '【第{{}}页】' else '' end as l from metadata where text is not null)
select rec_id, count(*) as brackets from l where regexp_matches({strip_sql('l')}, '{C.TRAILING_BRACKET}') group by rec_id
""")
def bracket_lines(spark, d):
    """Lines with a site's bracket at their end; as the table has none, every third record's lines get one, another third's a harmless one."""
    end = F.when(F.col("rec_id") % 3 == 0, "（本章未完，请收藏）").when(F.col("rec_id") % 3 == 1, "【第{}页】").otherwise("")
    each = _records(spark, d).select("rec_id", F.explode(T.lines("text")).alias("line")).withColumn("line", F.concat("line", end))
    return each.where(T.strip("line").rlike(C.TRAILING_BRACKET)).groupBy("rec_id").agg(F.count(F.lit(1)).alias("brackets"))


_MERGED = f"array_to_string(list_transform(list_filter(list_transform({LINES.replace('text', 'text')}, lambda l: {strip_sql('l')}), lambda l: l <> ''), lambda l: case when {_TITLE_SQL} then chr(2) || l || chr(3) else l end), '')"


@query(f"select doc_id, regexp_replace(regexp_replace(replace(replace({_MERGED}, chr(2), chr(10) || chr(10)), chr(3), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as out from documents where text is not null")
def merge_paragraphs(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.merge_paragraphs("text").alias("out"))


_UNIFORM = "regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n|[\\r\\x{2028}\\x{2029}\\x{85}]', chr(10), 'g'), '[ \\t\\x{3000}]+', ' ', 'g')"


@query(f"select doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_UNIFORM}, chr(10)), lambda l: {strip_sql('l')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as out from documents")
def normalize_structure(spark, d):
    return table(spark, d, "documents").select("doc_id", C.normalize_structure("text").alias("out"))


@query(f"""select doc_id, {strip_sql("regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^#{1,6}\\s+', '', 'g'), '\\*\\*(.+?)\\*\\*', '\\1', 'g'), '\\*(.+?)\\*', '\\1', 'g'), '`+', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '(?m)^[-*_]{3,}[ \\t]*$', '', 'g'), '(?m)^>[ \\t]?', '', 'g'), '(?m)^[ \\t]*[-*+][ \\t]+', '', 'g'), '(?m)^[ \\t]*[0-9]+\\.[ \\t]+', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} as out from documents where text is not null""")
def markdown_strip(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.strip_markdown("text").alias("out"))


@query(f"select rec_id, regexp_replace(text, '{W}+', '', 'g') as out from metadata where text is not null")
def squeeze_space(spark, d):
    return _each(spark, d, T.squeeze("text"))


@query("select project_id, regexp_replace(project_name, '[^\\p{L}\\p{N}_\\-]', '_', 'g') as folder from projects")
def project_folder(spark, d):
    return table(spark, d, "projects").select("project_id", C.safe_name("project_name").alias("folder"))


_BLANKLESS = f"array_to_string(list_filter({LINES}, lambda l: {strip_sql('l')} <> ''), chr(10))"
_PAGELESS = f"array_to_string(list_filter({LINES}, lambda l: not regexp_matches({strip_sql('l')}, '{C.PAGE_LINE}')), chr(10))"
_MERGE = f"regexp_replace(regexp_replace(replace(replace({_MERGED}, chr(2), chr(10) || chr(10)), chr(3), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"
_NORMAL = f"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_UNIFORM}, chr(10)), lambda l: {strip_sql('l')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')"


def _adless(custom: str = "false") -> str:
    site = f"(length(p.x) <= 200 and {_MARKERS.replace('(x,', '(p.x,')})"
    return f"""array_to_string(list_transform(list_filter(list_transform({LINES}, lambda l: {{'own': l, 'x': {_REST}}}),
  lambda p: {strip_sql('p.own')} = '' or (p.x <> '' and not {site} and not {custom})), lambda p: case when {strip_sql('p.own')} = '' then p.own else p.x end), chr(10))"""


def _steps(rules: list[str]) -> str:
    """Each rule over what the one before it left."""
    steps = ["s0 as (select rec_id, text from metadata)"]
    for n, rule in enumerate(rules):
        steps.append(f"s{n + 1} as materialized (select rec_id, {rule} as text from s{n})")
    return f"with {', '.join(steps)} select rec_id, text as out from s{len(rules)}"


_FIRST_RULES = [_fold(_ENCODING, "text"), _fold(C.SYLLABLES.items(), "text"), _BLANKLESS, _PAGELESS]


@query(_steps([*_FIRST_RULES, _adless(), _NORMAL]))
def clean_default(spark, d):
    """All default rules in their fixed order as one projection."""
    return C.clean(spread(table(spark, d, "metadata").select("rec_id", "text"), "rec_id")).select("rec_id", "out")


@query(_steps([*_FIRST_RULES, _adless("(contains(p.x, '月票') and length(p.x) <= 40)"), _MERGE, _NORMAL]))
def clean_all_rules(spark, d):
    return C.clean(spread(table(spark, d, "metadata").select("rec_id", "text"), "rec_id"), list(C.RULES), ["月票"]).select("rec_id", "out")
