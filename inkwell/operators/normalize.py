"""From document text to numbered body lines (line-by-line parser)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import IN_SPACE, NEWLINES, NOT_SPACE, SPACE

DIRECTIVE = f"^({NOT_SPACE}[^:]+):{SPACE}*$"
INLINE = f"^({NOT_SPACE}[^:]+):{SPACE}*({NOT_SPACE}.*)$"


def contents(text: Column) -> Column:
    """Leading white space dropped, line ends unified, a blank line guaranteed at the end."""
    trimmed = F.regexp_replace(text, f"^[{IN_SPACE}]*", "")
    return F.concat(F.regexp_replace(trimmed, r"\r\n|\r|\n", "\n"), F.lit("\n\n"))


def normalized(scripts: DataFrame) -> DataFrame:
    """script_id, contents, top (the lines before the first blank one), has_title and body."""
    df = scripts.where(F.col("text").isNotNull()).select("script_id", contents(F.col("text")).alias("contents"))
    df = df.withColumn("top", F.substring_index("contents", "\n\n", 1))
    lines = F.split("top", "\n", -1)
    keys = F.filter(lines, lambda line: line.rlike(DIRECTIVE) | line.rlike(INLINE))
    # a lone directive with no value, such as FADE IN:, is part of the body
    lone = (F.size(keys) == 1) & F.element_at(lines, -1).rlike(DIRECTIVE)
    df = df.withColumn("has_title", (F.size(keys) > 0) & ~lone)
    cut = F.when(F.col("has_title"), F.replace("contents", F.col("top"), F.lit(""))).otherwise(F.col("contents"))
    return df.withColumn("body", F.concat(F.lit("\n"), cut))


def dealt(df: DataFrame) -> DataFrame:
    """df dealt by script into as many partitions as the session shuffles into: few bytes can be much parsing, so a small
    exchange isn't to be coalesced into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "script_id")


def body_lines(scripts: DataFrame) -> DataFrame:
    """script_id, line_no and line, dealt by script before the rows multiply, so that later windows need no other exchange."""
    bodies = dealt(normalized(scripts).select("script_id", "body"))
    return bodies.select("script_id", F.posexplode(F.split("body", NEWLINES, -1)).alias("line_no", "line"))
