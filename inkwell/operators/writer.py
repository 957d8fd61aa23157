"""Elements and title page back to markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import IN_SPACE, ordered_join, trim_newlines
from inkwell.operators.legacy import SCENE_HEADER, TRANSITION


def _line(suppress_scene_numbers: bool) -> Column:
    kind, text = F.col("element_type"), F.col("element_text")
    heading = F.when(F.concat(F.lit("\n"), text, F.lit("\n")).rlike(SCENE_HEADER), text).otherwise(F.concat(F.lit("."), text))
    if not suppress_scene_numbers:
        heading = F.when(F.col("scene_number").isNotNull(), F.concat(heading, F.lit(" #"), "scene_number", F.lit("#"))).otherwise(heading)
    out = (
        F.when(kind == "Comment", F.concat(F.lit("\n[["), text, F.lit("]]")))
        .when(kind == "Boneyard", F.concat(F.lit("/*"), text, F.lit("*/"))).when(kind == "Synopsis", F.concat(F.lit("="), text))
        .when(kind == "Scene Heading", heading).when(kind == "Page Break", "====")
        .when(kind == "Section Heading", F.concat(F.expr("repeat('#', section_depth)"), text))
        .when(kind == "Transition", F.when(text.rlike(TRANSITION), "(null)").otherwise(F.concat(F.lit("> "), text))).otherwise(text)
    )
    closed = F.when(out.endswith(" "), F.concat(F.lit("> "), out, F.lit("<"))).otherwise(F.concat(F.lit("> "), out, F.lit(" <")))
    return F.when(F.col("is_centered"), closed).otherwise(out)


def bodies(elements: DataFrame, suppress_scene_numbers: bool = False) -> DataFrame:
    """script_id and body; of the cues in dual dialogue every second gets its caret."""
    shown = elements.where((F.col("element_type") == "Page Break") | ~F.coalesce(F.col("element_text").rlike(f"^[{IN_SPACE}]*$"), F.lit(True)))
    in_order = Window.partitionBy("script_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, 0)
    dual = (F.col("element_type") == "Character") & F.col("is_dual_dialogue")
    shown = shown.withColumn("dual_no", F.when(dual, F.sum(dual.cast("int")).over(in_order)))
    text = F.concat(_line(suppress_scene_numbers), F.when(F.col("dual_no") % 2 == 0, " ^").otherwise(""))
    tight = F.col("element_type").isin("Dialogue", "Parenthetical", "Comment")
    piece = F.concat(F.when(tight, "").otherwise("\n"), text, F.lit("\n"))
    return shown.groupBy("script_id").agg(ordered_join([F.col("elem_idx")], piece, "").alias("body"))


def title_texts(title_page: DataFrame) -> DataFrame:
    """script_id and title."""
    name = F.concat(F.upper(F.substring("key", 1, 1)), F.substring("key", 2, 2**31 - 1))
    one = F.concat(F.when(F.col("key") == "authors", "Author").otherwise(name), F.lit(": "), F.element_at("values", 1), F.lit("\n"))
    many = F.concat(name, F.lit(":\n"), F.array_join(F.transform("values", lambda v: F.concat(F.lit("\t"), v, F.lit("\n"))), ""))
    entry = F.when(F.size("values") == 1, F.try_element_at("values", F.lit(1)).isNotNull()).isNotNull()
    piece = F.when(entry, one).otherwise(many)
    return title_page.groupBy("script_id").agg(ordered_join([F.col("entry_idx")], piece, "").alias("title"))


def documents(elements: DataFrame, title_page: DataFrame, suppress_scene_numbers: bool = False) -> DataFrame:
    """script_id and text of every script with elements or a title page."""
    both = bodies(elements, suppress_scene_numbers).join(title_texts(title_page), "script_id", "full")
    head = F.when(F.col("title") != "", F.concat("title", F.lit("\n"))).otherwise("")
    return both.select("script_id", trim_newlines(F.concat(F.coalesce(head, F.lit("")), F.coalesce("body", F.lit("")))).alias("text"))
