"""The older parser: a chain of pattern rewrites that tags the text, then one extraction of the tags.

All of it but the last pass is one string expression per document, so it needs no exchange before the elements exist.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import BLANK, trim_newlines
from inkwell.operators.fast import ELEMENT_COLUMNS
from inkwell.operators.normalize import dealt

# The patterns and templates of the markup, in the order in which they are applied. (?U) stands before those
# whose classes are meant for Unicode.
REWRITES = [
    (r"\r\n|\r|\n", "\n"),
    (r"\n\/\*([^<>]+?)\*\/\n", "\n<Boneyard>$1</Boneyard>\n"),
    (r"\n\[{2}([^<>]+?)\]{2}\n", "\n<Comment>$1</Comment>\n"),
    (r"\n={1}([^<>=][^<>]+?)\n", "\n<Synopsis>$1</Synopsis>\n"),
    (r"(?U)(?<=\n)(\s*[\=\-\_]{3,8}\s*)\n{1}", "\n<Page Break></Page Break>\n"),
    (r"(?U)\n((&gt;|>)\s*[^<>\n]+(&lt;\s*))\n", "\n<Action>$1</Action>"),
    (r"(?U)\n((&gt;|>)\s*[^<>\n]+)\n", "\n<Transition>$1</Transition>"),
    (r"(?U)(?<=\n)(([iI][nN][tT]|[eE][xX][tT]|[^\w][eE][sS][tT]|\.|[iI]\.?\/[eE]\.?)([^\n]+))\n", "\n<Scene Heading>$1</Scene Heading>"),
    (r"^\n\n([^<>\n#]*?)\n", "<Action>$1</Action>\n"),
    (r"\n([\*_]*([^<>\na-z]*TO:|FADE TO BLACK\.|FADE OUT\.|CUT TO BLACK\.)[\*_]*)\n", "\n<Transition>$1</Transition>"),
    (r"(?U)(?<=\n)([ \t]*[^<>a-z\s\/\n][^<>a-z:!\?\n]*[^<>a-z\(!\?:,\n\.][ \t]?)\n{1}(?!\n)", "<Character>$1</Character>"),
    (r"(?U)(\([^<>]*?\)[\s]?)\n", "<Parenthetical>$1</Parenthetical>"),
    (r"(<(Character|Parenthetical)>[^<>\n]+<\/(Character|Parenthetical)>)([^<>]*?)(?=\n{2}|\n{1}<Parenthetical>)", "$1<Dialogue>$4</Dialogue>"),
    (r"(?U)((#+)(\s*[^\n]*))\n?", "<Section Heading>$1</Section Heading>"),
    (r"([^<>]*?)(\n{2}|\n<)", "<Action>$1</Action>$2"),
    (r"(?U)<Action>\s*<\/Action>", ""),
    ("@@@@@", "\n"),
]
BLOCK_COMMENT, BRACKET_COMMENT, SCENE_HEADER, TRANSITION, SECTION = REWRITES[1][0], REWRITES[2][0], REWRITES[7][0], REWRITES[9][0], REWRITES[13][0]
KEPT_NEWLINE = "@@@@@"
ACTION = REWRITES[14][0]
SCENE_NUMBER = r"(?i)(\#([0-9A-Za-z\.\)-]+)\#)"
TAGS = r"(?U)<([a-zA-Z\s]+)>([^<>]*)<\/[a-zA-Z\s]+>"
DUAL = r"(?U)\^\s*$"
CENTERED = r"^>[^<>\n]+<"
TITLE_PAGE = r"^([^\n]+:(([ \t]*|\n)[^\n]+\n)+)+\n"
INLINE = r"(?U)^([\w\s&]+):\s*([^\s][\w&,\.\?!:\(\)\/\s\-©\*\_]+)$"
DIRECTIVE = r"(?U)^([\w\s&]+):\s*$"
DATA = r"^([ ]{2,8}|\t)([^<>]+)$"
# End of fixed values.

#: A match of ACTION that fails where tags end fails at every place up to the next tag; tried at each of them it takes time
#: that grows with the square of the text between. It can only begin behind a tag's bracket or the match before it.
FASTER = {ACTION: r"(?:\G|(?<=[<>]))" + ACTION}


def _split_title(text: Column) -> tuple[Column, Column]:
    """The title block ("" if there is none) and the body, padded with blank lines."""
    body = F.regexp_replace(text, r"^\n+", "")
    top = F.concat(F.substring_index(body, "\n\n", 1), F.lit("\n\n"))
    found = body.contains("\n\n") & top.rlike(TITLE_PAGE)
    title = F.when(found, F.substring_index(body, "\n\n", 1)).otherwise("")
    rest = F.when(found, F.substring(body, F.length(F.substring_index(body, "\n\n", 1)) + 2, F.lit(2**31 - 1))).otherwise(body)
    return title, F.concat(F.lit("\n\n"), rest, F.lit("\n\n"))


def _protected(body: Column, pattern: str) -> Column:
    """Line ends inside comments that match pattern replaced, wherever the comment's text stands."""
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    return F.aggregate(found, body, lambda text, m: F.replace(text, m, F.replace(m, F.lit("\n"), F.lit(KEPT_NEWLINE))))


def tagged(scripts: DataFrame) -> DataFrame:
    """script_id and tagged: a script's body with every element in a tag.

    Each step that is read twice is a column of its own, so that it is worked out once."""
    df = dealt(scripts.where(F.col("text").isNotNull()).select("script_id", "text")).select("script_id", _split_title(F.col("text"))[1].alias("body"))
    for pattern in (BLOCK_COMMENT, BRACKET_COMMENT):
        df = df.withColumn("body", _protected(F.col("body"), pattern))
    body = F.col("body")
    for plain, safe in (("<", "&lt;"), (">", "&gt;"), ("...", "::trip::")):
        body = F.replace(body, F.lit(plain), F.lit(safe))
    rewritten = reduce(lambda c, rewrite: F.regexp_replace(c, FASTER.get(rewrite[0], rewrite[0]), rewrite[1]), REWRITES, body)
    return df.select("script_id", F.explode(F.array(rewritten)).alias("tagged"))  # a generator isn't merged into its readers


def _restored(text: Column) -> Column:
    for safe, plain in (("&lt;", "<"), ("&gt;", ">"), ("::trip::", "...")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def elements(scripts: DataFrame) -> DataFrame:
    """The same columns as the line-by-line parser gives."""
    df = tagged(scripts)
    pairs = F.arrays_zip(F.regexp_extract_all("tagged", F.lit(TAGS), F.lit(1)).alias("kind"), F.regexp_extract_all("tagged", F.lit(TAGS), F.lit(2)).alias("text"))
    df = df.select("script_id", F.posexplode(pairs).alias("elem_idx", "tag")).select("script_id", "elem_idx", F.col("tag.kind").alias("element_type"), _restored(F.col("tag.text")).alias("text"))
    kind, text = F.col("element_type"), F.col("text")
    numbered = (kind == "Scene Heading") & text.rlike(SCENE_NUMBER)
    df = df.withColumn("scene_number", F.when(numbered, F.regexp_extract(text, SCENE_NUMBER, 2)))
    df = df.withColumn("text", F.when(numbered, F.replace(text, F.regexp_extract(text, SCENE_NUMBER, 1), F.lit(""))).otherwise(text))
    df = df.withColumn("text", trim_newlines(text)).withColumn("is_centered", text.rlike(CENTERED))
    inner = F.regexp_replace(F.regexp_extract(text, r"(?U)(>?)\s*([^<>\n]*)\s*(<?)", 2), f"^{BLANK}+|{BLANK}+$", "")
    df = df.withColumn("text", F.when(F.col("is_centered"), inner).otherwise(text))
    df = df.withColumn("text", F.when(kind == "Scene Heading", F.regexp_extract(text, r"^\.?(.+)", 1)).otherwise(text))
    df = df.withColumn("section_depth", F.when(kind == "Section Heading", F.length(F.regexp_extract(text, SECTION, 2))).otherwise(0))
    df = df.withColumn("text", F.when(kind == "Section Heading", F.regexp_extract(text, SECTION, 3)).otherwise(text))
    # a caret's partner is the element before its cue's dialogue run, if that is a cue
    df = df.withColumns({"caret": (kind == "Character") & (F.col("elem_idx") > 1) & text.rlike(DUAL), "in_run": kind.isin("Dialogue", "Parenthetical")})
    beside = Window.partitionBy("script_id", "in_run").orderBy("elem_idx")
    partner = (kind == "Character") & F.coalesce(F.lead("caret").over(beside), F.lit(False))
    df = df.withColumn("partner", partner)
    df = df.withColumn("text", F.when(F.col("caret"), F.regexp_replace(text, r"(?U)\s*\^$", "")).otherwise(text))
    df = df.withColumn("element_text", F.when(F.col("partner"), F.replace(text, F.lit("^"), F.lit(""))).otherwise(text))
    return df.withColumn("is_dual_dialogue", F.col("caret") | F.col("partner")).select(*ELEMENT_COLUMNS)


def title_page(scripts: DataFrame) -> DataFrame:
    """As the line-by-line parser's; directives without values are dropped, and values must be indented."""
    tops = dealt(scripts.where(F.col("text").isNotNull()).select("script_id", _split_title(F.col("text"))[0].alias("top")).where("top <> ''"))
    lines = tops.select("script_id", F.posexplode(F.split(F.regexp_replace("top", r"^\n+|\n+$", ""), "\n", -1)).alias("line_no", "line"))
    line = F.col("line")
    lines = lines.withColumn("inline", line.rlike(INLINE)).withColumn("directive", ~F.col("inline") & line.rlike(DIRECTIVE))
    so_far = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("entry", F.sum((F.col("inline") | F.col("directive")).cast("int")).over(so_far))
    name = F.lower(F.regexp_extract(line, r"^([^:]+):", 1))
    name = F.when(name.isin("author", "author(s)"), "authors").otherwise(name)
    value = F.when(F.col("inline"), F.regexp_extract(line, INLINE, 2)).when(~F.col("directive") & line.rlike(DATA), F.regexp_extract(line, DATA, 2))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "inline", value.alias("value"))))
    groups = lines.where("entry > 0").groupBy("script_id", "entry").agg(F.max(F.when(F.col("inline") | F.col("directive"), name)).alias("key"), F.max("inline").alias("inline"), rows.alias("rows"))
    own = F.transform(F.filter("rows", lambda r: r["value"].isNotNull() & (r["inline"] | ~F.col("inline"))), lambda r: r["value"])
    groups = groups.select("script_id", "entry", "key", own.alias("values")).where(F.size("values") > 0)
    number = (F.row_number().over(Window.partitionBy("script_id").orderBy("entry")) - 1).alias("entry_idx")
    return groups.select("script_id", number, "key", "values")
