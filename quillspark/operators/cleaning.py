"""Rules that clean texts, each a column expression, and their fixed order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import BLANKS, WS, col, lines, strip, unlines

#: Characters after which a misread first character is put right.
AFTER_REN = "马物生间命心眼手面身头脸群流海山世界道德品格性情欲意志力才杰雄豪王皇帝圣仙神魔鬼妖精灵魂魄气势运寿福祸灾劫难苦乐喜怒哀愁忧思念想知觉悟明暗阴阳"
AFTER_TIAN = "马皇赋才道地罚威命意机象文数运光色云风雨雷电火水山海河星月德心理法路途门涯宇宙空际时人物志规律则经纬纲常伦梯桥窗顶底角穹"
AFTER_JING = "然是有敢会"
#: Rare characters that stand for common ones.
RARE_CHARACTERS = {"龘": "压", "垚": "堆", "犇": "奔", "骉": "马", "鱻": "鲜", "麤": "粗", "飝": "飞", "靐": "雷", "焱": "火", "淼": "水", "鑫": "金", "森": "木"}
#: Syllables left in place of characters.
SYLLABLES = {
    "sè": "色", "rì": "日", "zhàn": "战", "bō": "波", "jīng": "精", "mō": "摸", "chén": "沉", "xùn": "迅", "nù": "怒", "qì": "气", "yì": "意", "wēi": "威",
    "zhèn": "震", "hōng": "轰", "cāng": "苍", "máng": "茫", "hán": "寒", "qīng": "清", "yōu": "幽", "xuán": "玄", "míng": "明", "àn": "暗", "guāng": "光", "yuè": "月",
    "xīng": "星", "lóng": "龙", "fēng": "风", "yún": "云", "léi": "雷", "diàn": "电", "huǒ": "火", "shuǐ": "水", "shān": "山", "hé": "河", "hǎi": "海", "tiān": "天",
    "dì": "地", "rén": "人", "xīn": "心", "yǎn": "眼", "yǔ": "雨", "yǐng": "影", "shēng": "声", "yīn": "音", "dào": "道", "fǎ": "法", "lì": "力", "dà": "大",
    "xiǎo": "小", "gāo": "高", "dī": "低", "cháng": "长", "duǎn": "短", "zhòng": "重", "kuài": "快", "màn": "慢", "qián": "前", "nán": "南", "běi": "北", "dōng": "东",
    "xī": "西", "zhōng": "中", "mén": "门", "shū": "书", "gōng": "功", "dòu": "斗", "shā": "杀", "zhǎn": "斩", "sǐ": "死", "yǒu": "有", "wú": "无", "shí": "实",
    "zhēn": "真", "hǎo": "好", "xǐ": "喜", "lè": "乐", "yáng": "阳", "lěng": "冷", "rè": "热", "chūn": "春", "jiǔ": "九", "bǎi": "百", "qiān": "千",
    "wàn": "万", "shén": "神", "xiān": "仙", "mó": "魔",
}
#: What marks a line as a site's, and what marks a bracket at a line's end.
SITE_MARKERS = [
    "看小说到网", "笔趣阁", "顶点小说", "燃文", "看书网", "16977", "www.", "http://", "https://", ".com", ".net", "txt下载", "全本",
    "本站", "首发", "无弹窗", "手打更新", "最快更新", "更新最快", "最新章节", "阅读最新章节", "本章未完", "阅读网址", "手机版阅读网址",
    "手机阅读", "加入书签", "推荐阅读", "天才一秒记住", "请收藏", "请牢记", "如果您觉得", "请到", "支持正版", "看书",
]
BRACKET_MARKERS = "未完待续|本章未完|首发|阅读网址|请收藏|推荐阅读|手打|更新最快|最新章节|免费阅读|请牢记|看小说到网"
TRAILING_BRACKET = rf"[（(【\[][^）)】\]]{{0,60}}?(?:{BRACKET_MARKERS}).{{0,40}}?[）)】\]]{WS}*$"
LONGEST_SITE_LINE, LONGEST_CUSTOM_LINE = 200, 40
PAGE_LINE = r"^(\p{Nd}+|第[一二三四五六七八九十百千万\p{Nd}]+页|-?\p{Nd}+-?)$"
TITLE = r"^(第[一二三四五六七八九十百千万零〇两\p{Nd}]+[章节回卷部集篇话]|序章|楔子|引子|番外|后记|尾声|完本感言)"
LONGEST_TITLE = 32


def is_title(line: Column | str) -> Column:
    """A chapter heading: short, without a full stop, beginning with a numbered or a known heading."""
    bare = strip(line)
    return (F.length(bare) <= LONGEST_TITLE) & ~F.contains(bare, F.lit("。")) & bare.rlike(TITLE)


def fix_encoding(text: Column | str) -> Column:
    text = col(text)
    for wrong, right, after in (("入", "人", AFTER_REN), ("夭", "天", AFTER_TIAN), ("竞", "竟", AFTER_JING)):
        text = F.regexp_replace(text, f"{wrong}(?=[{after}])", right)
    text = F.replace(F.replace(text, F.lit("镇龘压"), F.lit("镇压")), F.lit("镇龘"), F.lit("镇"))
    return F.translate(text, "".join(RARE_CHARACTERS), "".join(RARE_CHARACTERS.values()))


def remove_pinyin(text: Column | str) -> Column:
    text = col(text)
    put = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SYLLABLES.items(), text)
    return F.when(text.rlike("[āáǎàēéěèīíǐìōóǒòūúǔù]"), put).otherwise(text)


def _keep(text: Column | str, wanted) -> Column:
    return unlines(F.filter(lines(text), wanted))


def remove_empty_lines(text: Column | str) -> Column:
    return _keep(text, lambda line: strip(line) != "")


def remove_page_numbers(text: Column | str) -> Column:
    return _keep(text, lambda line: ~strip(line).rlike(PAGE_LINE))


def is_site_line(line: Column) -> Column:
    found = line.rlike("|".join(re.escape(m) for m in SITE_MARKERS))
    return (line != "") & (F.length(line) <= LONGEST_SITE_LINE) & found


def without_bracket(bare: Column) -> Column:
    """A stripped line without a site's bracket at its end."""
    closed = F.right(bare, F.lit(1)).isin("）", ")", "】", "]")
    return F.when(closed, F.rtrim(F.regexp_replace(bare, TRAILING_BRACKET, ""), F.lit(BLANKS))).otherwise(bare)


def remove_ads(text: Column | str, custom_words: Sequence[str] = ()) -> Column:
    """Blank lines stay as they are; other lines lose their bracket, and go if nothing or a site's line is left."""
    stripped = F.transform(lines(text), lambda line: F.struct(line.alias("own"), strip(line).alias("bare")))
    pairs = F.transform(stripped, lambda p: F.struct(p["own"].alias("own"), (p["bare"] == "").alias("blank"), without_bracket(p["bare"]).alias("rest")))

    def stays(pair: Column) -> Column:
        rest = pair["rest"]
        custom = reduce(lambda a, b: a | b, [F.contains(rest, F.lit(w)) for w in custom_words], F.lit(False)) & (F.length(rest) <= LONGEST_CUSTOM_LINE)
        return pair["blank"] | ((rest != "") & ~is_site_line(rest) & ~custom)

    return unlines(F.transform(F.filter(pairs, stays), lambda p: F.when(p["blank"], p["own"]).otherwise(p["rest"])))


def merge_paragraphs(text: Column | str) -> Column:
    """Body lines between headings run together; a heading stands alone with a blank line before it."""
    bare = F.filter(F.transform(lines(text), strip), lambda line: line != "")
    marked = F.transform(bare, lambda line: F.when(is_title(line), F.concat(F.lit("\x02"), line, F.lit("\x03"))).otherwise(line))
    joined = F.array_join(marked, "")
    spaced = F.replace(F.replace(joined, F.lit("\x02"), F.lit("\n\n")), F.lit("\x03"), F.lit("\n"))
    # Between two headings there is one blank line, as after any other line.
    return F.regexp_replace(F.regexp_replace(spaced, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def normalize_structure(text: Column | str) -> Column:
    """One kind of line break and of space, stripped lines, at most one blank line in a row, none at the ends."""
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n|[\r\\x{2028}\\x{2029}\\x{85}]", "\n")
    out = F.regexp_replace(out, "[ \t\\x{3000}]+", " ")
    out = unlines(F.transform(lines(out), strip))
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def strip_markdown(text: Column | str) -> Column:
    """Without headings, emphasis, code marks, images, links, rules, quotes and list marks; images go before links."""
    out = col(text)
    for rule, to in (
        (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"`+", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^[-*_]{3,}[ \t]*$", ""), (r"(?m)^>[ \t]?", ""), (r"(?m)^[ \t]*[-*+][ \t]+", ""), (r"(?m)^[ \t]*[0-9]+\.[ \t]+", ""), (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, rule, to)
    return strip(out)


def safe_name(name: Column | str) -> Column:
    """A project's name as a folder's: anything but letters, digits, _, ideographs and - becomes _."""
    return F.regexp_replace(col(name), r"[^\p{L}\p{N}_\-]", "_")


#: Rules by name in the order they always run; structure is normalised at the end whatever is asked for.
RULES = {
    "fix_encoding": fix_encoding, "remove_pinyin": remove_pinyin, "remove_empty_lines": remove_empty_lines, "remove_page_numbers": remove_page_numbers,
    "remove_ads": remove_ads, "merge_paragraphs": merge_paragraphs, "normalize_structure": normalize_structure,
}
DEFAULT_RULES = tuple(name for name in RULES if name != "merge_paragraphs")


def clean(rows: DataFrame, rules: Sequence[str] | None = None, custom_words: Sequence[str] = (), text: str = "text", to: str = "out") -> DataFrame:
    """Adds the text after the rules in their fixed order; none or an empty list means the defaults.

    A null text comes out empty. Each rule is a step of its own, so that no rule works out the one before it again.
    """
    wanted = set(rules or DEFAULT_RULES)
    unknown = wanted - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    rows = rows.withColumn(to, F.col(text))
    for name, rule in RULES.items():
        if name in wanted and name != "normalize_structure":
            rows = rows.withColumn(to, rule(to, custom_words) if name == "remove_ads" else rule(to))
    return rows.withColumn(to, normalize_structure(to))
