"""One-line descriptions of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def description() -> Column:
    flag = F.when(F.col("is_centered"), " (centered)").when(F.col("is_dual_dialogue"), " (dual dialogue)")
    flag = flag.when(F.col("section_depth") > 0, F.concat(F.lit(" ("), F.col("section_depth").cast("string"), F.lit("d)"))).otherwise("")
    return F.concat("element_type", flag, F.lit(": "), "element_text")


def described(elements: DataFrame) -> DataFrame:
    return elements.select("script_id", "elem_idx", description().alias("description"))
