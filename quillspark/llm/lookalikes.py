"""Problem 2: texts that look the same but are written with other characters.

Method: characters are mapped to one of those that look alike; mapped texts are grouped under the accent-sensitive
collation UNICODE in SQL, which also makes composed and decomposed accents equal; one member of each class is chosen
and joined back to all of them. Texts whose letters and digits, without accents, nobody shares in another writing
can't be in a class with another text; they are set aside by a digest before the texts are shuffled.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import cut_lineage, spread

#: Letters of other scripts and the Latin letters that look like them.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХЗаеіјорсухѕԁһԛԝѵ", "ABESIJKMHOPCTYX3aeijopcyxsdhqwv")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲαικρυ", "ABEZHIKMNOPTYXovcaikpu")
ARMENIAN = ("օսոց", "ounq")
CHEROKEE = ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏆᏋᏎᏒᏔᏙᏚᏞᏟᏢᏦ", "DRTAJEWMHGZIE4RWVSLCPK")
#: Radicals of the supplement block and the ideographs they show.
RADICALS = (
    "⺁⺃⺄⺅⺆⺇⺉⺊⺋⺎⺏⺐⺒⺓⺔⺕⺖⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺨⺩⺪⺫⺬⺭⺯⺰⺱⺲⺶⺷⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻞⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乚乙亻冂几刂卜㔾兀尣尢巳幺彑彐忄扌攵旡日月歺民氵氺灬爫爫丬犭王疋目示礻糹纟罓罒羊羊耂肀聿肉臼艹艹艹虎衤覀西见角角讠贝足车辶辶辶阝钅長镸长门阝雨青韦页风飞食食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)
#: Other code points for the same sign.
SIGNS = {"-": "‐‑‒−﹣－⁃", ":": "∶꞉", ".": "․", "·": "‧・･•∙⋅", ",": "‚", "'": "ʹʼˈ′＇", '"': "″〃", "—": "―─"}
_TYPES = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<small>", "<vertical>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")
_INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x206A, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]
#: Combining marks that the accents of Latin letters use.
_ACCENTS = "̧̨̣̀́̂̃̄̆̇̈̊̋̌"


@cache
def _tables() -> tuple[tuple[str, str], dict[str, str], tuple[str, str], list[tuple[str, str]]]:
    """Single characters to single characters, to several, letters to their base, and accented pairs to one letter."""
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    base: dict[str, str] = {}
    pairs: list[tuple[str, str]] = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category in ("Cn", "Cs", "Co") or char == "…":  # the sign itself is the usual form here
            continue
        parts = unicodedata.decomposition(char).split()
        if parts and parts[0] in _TYPES or parts and not parts[0].startswith("<") and len(parts) == 1:
            to = unicodedata.normalize("NFKC", char)
            if len(to) == 1:
                single[char] = to
            elif 1 < len(to) <= 3 and code < 0xFE00 and "<compat>" in parts[:1] and " " not in to or 0xFB00 <= code <= 0xFB06:
                several[char] = to
        elif category == "Zs":
            single[char] = " "
        elif parts and not parts[0].startswith("<") and len(parts) == 2 and not 0xAC00 <= code <= 0xD7A3:
            base[char] = unicodedata.normalize("NFD", char)[0]
            if code < 0x250 and chr(int(parts[1], 16)) in _ACCENTS:
                pairs.append(("".join(chr(int(p, 16)) for p in parts), char))
    for other, latin in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, RADICALS):
        single.update(zip(other, latin, strict=True))
    single.update((other, sign) for sign, others in SIGNS.items() for other in others)
    single["\t"] = " "
    for char, to in list(single.items()):  # what a mapping leads to is mapped too
        single[char] = single.get(to, to)
    for char in map(chr, _INVISIBLE):
        single.pop(char, None)
        several.pop(char, None)
    invisible = "".join(map(chr, _INVISIBLE))
    return ("".join(single) + invisible, "".join(single.values())), several, ("".join(base), "".join(base.values())), pairs


#: Texts of only these characters have no accent, no other width of a letter and nothing invisible.
_PLAIN = r"[^\x00-\x7f\x{4e00}-\x{9fa5}，。、！？：；“”‘’…—（）《》【】\x{3000}]"


def _holds(text: Column, chars: dict[str, str]) -> Column:
    """Whether any of the characters occurs: looked up in a table, where a pattern would try one after the other."""
    return F.length(F.translate(text, "".join(chars), "")) != F.length(text)


def _swaps(pairs) -> Column:
    """What is put in place of what, as one constant."""
    return F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in pairs])), "array<struct<a:string,b:string>>")


def with_clean_form(rows: DataFrame, text: str = "text", to: str = "clean") -> DataFrame:
    """Adds the text in mapped characters, without invisible ones, with accented Latin letters composed."""
    (source, target), several, _, pairs = _tables()
    spelled, accents = _swaps(several.items()), _swaps(pairs)
    swap = lambda table: F.aggregate(table, F.col(to), lambda t, p: F.replace(t, p["a"], p["b"]))
    rows = rows.withColumn(to, F.translate(F.col(text), source, target))
    rows = rows.withColumn(to, F.when(_holds(F.col(to), several), swap(spelled)).otherwise(F.col(to)))
    return rows.withColumn(to, F.when(F.col(to).rlike(f"[{_ACCENTS}]"), swap(accents)).otherwise(F.col(to)))


def _skeleton(letters: Column) -> Column:
    plain = F.regexp_replace(letters, r"[^\p{L}\p{N}]|[\x{1100}-\x{11ff}\x{ac00}-\x{d7a3}]", "")
    return F.xxhash64(plain, F.length(plain))


def _with_skeleton(texts: DataFrame) -> DataFrame:
    """Adds a digest of letters and digits without accents: equal wherever the collation finds two clean forms equal.

    A text of plain characters is its own clean form as far as letters and digits go; only the others are mapped.
    """
    _, several, (source, target), _ = _tables()
    (mapped, to), *_ = _tables()
    folded = F.translate(F.when(F.col("text").rlike(_PLAIN), F.translate("text", mapped, to)), source, target)
    rows = texts.withColumn("folded", folded)
    swapped = F.aggregate(_swaps(several.items()), F.col("folded"), lambda t, p: F.replace(t, p["a"], p["b"]))
    rows = rows.withColumn("folded", F.when(_holds(F.col("folded"), several), swapped).otherwise(F.col("folded")))
    return rows.withColumn("skeleton", _skeleton(F.coalesce("folded", "text"))).drop("folded")


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (rec_id, digest, clean) that may share a reading, and classes (reading, class_id) by collation."""
    texts = records.select("rec_id", "text").where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    keyed = _with_skeleton(spread(texts, "rec_id")).select("rec_id", "skeleton", F.xxhash64("text", F.length("text")).alias("digest"))
    keyed = cut_lineage(keyed)  # three numbers a row, so that texts are mapped once
    shared = keyed.groupBy("skeleton").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high").select("skeleton")
    wanted = keyed.join(shared, "skeleton", "left_semi").select("rec_id", "digest")
    members = with_clean_form(texts.join(wanted, "rec_id")).select("rec_id", "digest", "clean", (F.col("text") != F.col("clean")).alias("changed"))
    members = cut_lineage(members)
    chosen = F.min(F.struct("changed", "rec_id"))
    grouped = members.groupBy(F.collate("clean", "UNICODE").alias("reading")).agg(chosen.alias("best"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    chosen_ids = grouped.where("low != high").select("reading", F.col("best.rec_id").alias("class_id"))
    return members, chosen_ids


def _placed(records: DataFrame) -> DataFrame:
    members, chosen = classes(records)
    return members.withColumn("reading", F.collate("clean", "UNICODE")).join(chosen, "reading").select("rec_id", "digest", "clean", "class_id")


def same_reading(records: DataFrame) -> DataFrame:
    """Pairs (rec_id_a, rec_id_b) of records that read the same but aren't written the same; each pair once.

    Needs a unique rec_id and text. Texts without letter or digit, null and empty ones are in no pair. Copies of one
    writing meet only the other writings of their class, so that a large group of copies yields no more than its
    result.
    """
    placed = _placed(records).select("rec_id", "digest", "class_id")
    writings = placed.select("class_id", "digest").distinct()
    other = writings.select("class_id", F.col("digest").alias("digest_b"))
    both = writings.join(other, "class_id").where(F.col("digest") < F.col("digest_b"))
    left = both.join(placed, ["class_id", "digest"]).select("class_id", "digest_b", F.col("rec_id").alias("a"))
    right = placed.select("class_id", F.col("digest").alias("digest_b"), F.col("rec_id").alias("b"))
    pairs = left.join(right, ["class_id", "digest_b"]).where(F.col("a") != F.col("b"))
    return pairs.select(F.least("a", "b").alias("rec_id_a"), F.greatest("a", "b").alias("rec_id_b"))


def one_form(records: DataFrame) -> DataFrame:
    """rec_id, class_id and form of every record: the chosen member's clean form, or the text's own.

    The member chosen is the smallest rec_id among those already clean, else the smallest of all. A null text has a
    null form. Records in no class have their own rec_id as class_id.
    """
    placed = _placed(records)
    forms = placed.where(F.col("rec_id") == F.col("class_id")).select("class_id", F.col("clean").alias("form")).dropDuplicates(["class_id"])
    shared = placed.select("rec_id", "class_id").join(forms, "class_id")
    own = with_clean_form(records.select("rec_id", "text"), to="own").select("rec_id", "own")
    return own.join(shared, "rec_id", "left").select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.coalesce("form", "own").alias("form"))


def p2_found(spark, folder: str) -> DataFrame:
    return same_reading(spark.read.parquet(f"{folder}/metadata.parquet"))


def p2_forms(spark, folder: str) -> DataFrame:
    return one_form(spark.read.parquet(f"{folder}/metadata.parquet"))
