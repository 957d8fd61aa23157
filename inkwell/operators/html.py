"""Pages and title page to HTML."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import ordered_join
from inkwell.operators.paginate import LETTER, paginate

# Emphasis patterns of the markup and the tags that they become, in order of application.
EMPHASIS = [
    (r"(_\*{3}|\*{3}_)([^<>]+)(_\*{3}|\*{3}_)", "<strong><em><u>$2</strong></em></u>"),
    (r"(\*{3})([^<>]+)(\*{3})", "<strong><em>$2</strong></em>"),
    (r"(_\*{2}|\*{2}_)([^<>]+)(_\*{2}|\*{2}_)", "<strong><u>$2</u></strong>"),
    (r"(_\*{1}|\*{1}_)([^<>]+)(_\*{1}|\*{1}_)", "<em><u>$2</em></u>"),
    (r"(\*{2})([^<>]+)(\*{2})", "<strong>$2</strong>"),
    (r"(?<!\\)(\*{1})([^<>]+)(\*{1})", "<em>$2</em>"),
    (r"(_)([^<>_]+)(_)", "<u>$2</u>"),
]
INLINE_NOTE = r"\[{2}(.*?)\]{2}"
HIDDEN = ("Boneyard", "Comment", "Synopsis", "Section Heading")
SPEECH = ("Character", "Dialogue", "Parenthetical")
# End of fixed values.

DEFAULT_CSS = """body { font: 12pt Courier, monospace; }
section { width: 6in; margin: 1in auto; }
p.character { margin-left: 2in; }
p.dialogue { margin-left: 1in; width: 3.5in; }
p.parenthetical { margin-left: 1.4in; width: 3in; }
p.transition { text-align: right; }
p.center { text-align: center; }
div.dual-dialogue-left, div.dual-dialogue-right { display: inline-block; width: 45%; vertical-align: top; }
"""


def emphasised(c: Column) -> Column:
    """Emphasis marks as tags."""
    return reduce(lambda text, rewrite: F.regexp_replace(text, *rewrite), EMPHASIS, c)


def without_notes(c: Column) -> Column:
    return F.regexp_replace(c, INLINE_NOTE, "")


def css_class(kind: Column) -> Column:
    return F.replace(F.lower(kind), F.lit(" "), F.lit("-"))


def _dual_marks(pages: DataFrame) -> DataFrame:
    """pages with opened (what a cue of dual dialogue opens: 1 the left side, 2 the right) and closes.

    The count of cues starts anew only at an element that isn't speech and finds two of them, so it is carried along."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page_idx", "pos_in_page"]).reset_index(drop=True)
        count, opened, closes = 0, [], []
        for kind, dual in zip(rows["element_type"], rows["is_dual_dialogue"]):
            skipped = kind is None or kind in HIDDEN or kind == "Page Break"
            starts = not skipped and kind == "Character" and dual
            count += starts
            ends = not skipped and count >= 2 and kind not in SPEECH
            opened.append(count if starts and count <= 2 else 0)
            closes.append(ends)
            count = 0 if ends else count
        return rows.assign(opened=opened, closes=closes)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields) + ", opened int, closes boolean"
    return pages.groupBy("script_id").applyInPandas(run, schema)


def element_html(escape: bool = False) -> Column:
    """The paragraph of an element, "" if nothing of its text is left."""
    kind = F.col("element_type")
    text = F.col("element_text")
    if escape:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
    span = lambda side: F.concat(F.lit(f"<span class='scene-number-{side}'>"), "scene_number", F.lit("</span>"))
    text = F.when((kind == "Scene Heading") & F.col("scene_number").isNotNull(), F.concat(span("left"), text, span("right"))).otherwise(text)
    text = F.when((kind == "Character") & F.col("is_dual_dialogue"), F.replace(text, F.lit("^"), F.lit(""))).otherwise(text)
    for of, mark in (("Character", "@"), ("Scene Heading", r"\."), ("Lyrics", "~"), ("Action", "!")):
        text = F.when(kind == of, F.regexp_replace(text, f"^{mark}", "")).otherwise(text)
    text = without_notes(emphasised(text))
    centre = F.when(F.col("is_centered"), " center").otherwise("")
    return F.when(text != "", F.concat(F.lit("<p class='"), css_class(kind), centre, F.lit("'>"), text, F.lit("</p>\n"))).otherwise("")


def title_html(title_page: DataFrame) -> DataFrame:
    """script_id and title_html; of a repeated key the last entry counts."""
    last = title_page.groupBy("script_id", "key").agg(F.max_by("values", "entry_idx").alias("values"))
    byname = last.groupBy("script_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("entries"))
    value = lambda key: F.try_element_at("entries", F.lit(key))
    block = lambda key, inner: F.concat(F.lit(f"<p class='{key}'>"), inner, F.lit("</p>"))
    lines = lambda key: F.array_join(F.transform(value(key), lambda v: F.concat(v, F.lit("<br>"))), "")
    has = lambda key: value(key).isNotNull()
    either = lambda key, default: block(key, F.when(has(key), lines(key)).otherwise(default))
    people = F.when(has("credit") | has("authors"), F.concat(either("credit", "written by"), either("authors", "Anonymous"))).otherwise("")
    rest = [F.when(has(key), block(key, lines(key))).otherwise("") for key in ("source", "draft date", "contact")]
    return byname.select("script_id", F.concat(F.lit("<div id='script-title'>"), either("title", "Untitled"), people, *rest, F.lit("</div>")).alias("title_html"))


def html(elements: DataFrame, title_page: DataFrame, css: str = DEFAULT_CSS, size: tuple[int, int] = LETTER, escape: bool = False) -> DataFrame:
    """script_id and html of every script with elements or a title page. Text isn't escaped unless asked."""
    rows = _dual_marks(paginate(elements, size))
    number = F.when(F.col("pos_in_page") == 0, F.concat(F.lit("<p class='page-break'>"), (F.col("page_idx") + 1).cast("string"), F.lit(".</p>\n"))).otherwise("")
    opening = F.when(F.col("opened") == 1, "<div class='dual-dialogue'>\n<div class='dual-dialogue-left'>\n").when(F.col("opened") == 2, "</div>\n<div class='dual-dialogue-right'>\n").otherwise("")
    closing = F.when(F.col("closes"), "</div>\n</div>\n").otherwise("")
    shown = F.when(F.col("element_type").isNull() | F.col("element_type").isin(*HIDDEN), "").when(F.col("element_type") == "Page Break", "</section>\n<section>\n").otherwise(F.concat(opening, closing, element_html(escape)))
    pages = rows.groupBy("script_id").agg(ordered_join([F.col("page_idx"), F.col("pos_in_page")], F.concat(number, shown), "").alias("pages"))
    both = pages.join(title_html(title_page), "script_id", "full")
    head = f"<!DOCTYPE html>\n<html>\n<head>\n<style type='text/css'>\n{css}</style>\n</head>\n<body>\n<article>\n<section>\n"
    return both.select("script_id", F.concat(F.lit(head), F.coalesce("title_html", F.lit("")), F.coalesce("pages", F.lit("")), F.lit("</section>\n</article>\n</body>\n</html>")).alias("html"))
