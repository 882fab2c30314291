"""Objects and lists out of texts that hold JSON somewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import col, strip


def json_object(text: Column | str) -> Column:
    """The JSON object in a text: in a fenced block, else the whole text, else from the first to the last brace.

    A list stands for an object with entities; null where there is none.
    """
    text = col(text)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    found = []
    for part in (strip(fenced), strip(text), F.regexp_extract(text, r"(?s)(\{.*\})", 1)):
        whole = F.get_json_object(part, "$")
        found.append(F.when(part.startswith("{"), whole).when(part.startswith("["), F.concat(F.lit('{"entities":'), whole, F.lit("}"))))
    return F.coalesce(*found)


def short_strings(items: Column, most: int, longest: int) -> Column:
    """Up to so many different strings without quotes around them; blank and longer ones are left out."""
    bare = F.transform(items, lambda x: strip(F.regexp_replace(strip(x), "^[\"'“”]+|[\"'“”]+$", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != "") & (F.length(x) <= longest))), F.lit(1), F.lit(most))


def rewrites(reply: Column | str) -> Column:
    """entities and queries of a model's reply to a request to rewrite a question: three of each at most."""
    found = F.from_json(json_object(reply), "struct<entities:array<string>,queries:array<string>>")
    return F.struct(short_strings(found["entities"], 3, 20).alias("entities"), short_strings(found["queries"], 3, 60).alias("queries"))
