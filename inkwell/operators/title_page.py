"""Title-page entries, in order, duplicate keys kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import trim
from inkwell.operators.normalize import DIRECTIVE, INLINE, dealt, normalized


def title_page(scripts: DataFrame) -> DataFrame:
    """script_id, entry_idx, key and values of every entry.

    A directive takes the lines below it, up to the next key; lines below an inline key belong to nothing."""
    tops = dealt(normalized(scripts).where("has_title").select("script_id", "top"))
    lines = tops.select("script_id", F.posexplode(F.split("top", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumns({"directive": F.col("line").rlike(DIRECTIVE), "inline": F.col("line").rlike(INLINE)})
    lines = lines.withColumn("is_key", F.col("directive") | F.col("inline"))
    so_far = Window.partitionBy("script_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("entry_idx", (F.sum(F.col("is_key").cast("int")).over(so_far) - 1).cast("int")).where("entry_idx >= 0")
    name = F.lower(F.regexp_extract("line", r"^([^:]+):", 1))
    name = F.when(name == "author", "authors").otherwise(name)
    value = F.when(F.col("inline") & ~F.col("directive"), F.regexp_extract("line", INLINE, 2)).when(~F.col("is_key"), trim(F.col("line")))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "is_key", "directive", value.alias("value"))))
    entries = lines.groupBy("script_id", "entry_idx").agg(F.max(F.when(F.col("is_key"), name)).alias("key"), rows.alias("rows"))
    own = F.filter("rows", lambda r: r["value"].isNotNull() & (r["is_key"] | F.element_at("rows", 1)["directive"]))
    return entries.select("script_id", "entry_idx", "key", F.transform(own, lambda r: r["value"]).alias("values"))
