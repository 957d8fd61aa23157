"""Elements to pages.

Pages are filled in order, looking ahead over headings and dialogue blocks and splitting speeches, so a script is one task's
work; scripts are independent. Text is measured by a fixed-pitch model: 7.2 points a character, lines broken greedily at
spaces, 12 points a line. Input rows are never changed.
"""

from __future__ import annotations

import textwrap


import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the layout, in points.
LINE, PITCH, MARGINS = 12, 7.2, round(72 * 2.01)
LETTER = (612, 792)
SPACE_BEFORE = {"Scene Heading": 2, "Action": 1, "General": 1, "Character": 1, "Transition": 1}
LEFT_MARGIN = {"Scene Heading": 106, "Action": 106, "General": 106, "Transition": 106, "Character": 247, "Dialogue": 177, "Parenthetical": 205}
WIDTH = {"Action": 430, "General": 430, "Scene Heading": 430, "Transition": 430, "Character": 250, "Dialogue": 250, "Parenthetical": 212}
SENTENCE = regex.compile(r"(.+?[\.\?\!]+\s*)")
# End of fixed values.

SPOKEN = ("Dialogue", "Parenthetical")
FIELDS = ["elem_idx", "element_type", "element_text", "is_centered", "scene_number", "is_dual_dialogue", "section_depth"]
SCHEMA = "script_id long, page_idx int, pos_in_page int, elem_idx int, element_type string, element_text string, is_centered boolean, scene_number string, is_dual_dialogue boolean, section_depth int"


def height(text: str, width: int) -> int:
    """Points that text takes when wrapped to width; 0 points of width mean no limit."""
    if not text:
        return 0
    columns = int(width / PITCH)
    if not columns:
        return LINE * (text.count("\n") + 1)
    return LINE * sum(max(1, len(textwrap.wrap(part, columns, drop_whitespace=True, break_on_hyphens=False))) for part in text.split("\n"))


def _made(kind: str, text: str) -> dict:
    return {"elem_idx": None, "element_type": kind, "element_text": text, "is_centered": False, "scene_number": None, "is_dual_dialogue": False, "section_depth": 0}


class _Pages:
    """Pages being filled: the finished ones, the open one, and how far down it is written."""

    def __init__(self, room: int):
        self.room, self.done, self.open, self.y = room, [], [], 0

    def turn(self, y: int = 0) -> None:
        self.done.append(self.open)
        self.open, self.y = [], y


def _tall(e: dict, width: int | None = None) -> int:
    return height(e["element_text"] or "", WIDTH.get(e["element_type"], 0) if width is None else width)


def _lead(e: dict) -> int:
    return SPACE_BEFORE.get(e["element_type"], 0) * LINE


def _spills_at(block: list[dict], overflow: int) -> int:
    """The member of block at which, from its start, as much height as overflows is reached."""
    reached = 0
    for at, e in enumerate(block):
        reached += _tall(e) + _lead(e)
        if reached >= overflow:
            return at
    return len(block) - 1


def _split_speech(pages: _Pages, block: list[dict], at: int, free: int) -> None:
    """Break the speech block[at] by sentences: what fits stays with (MORE), the rest follows its cue on the next page."""
    sentences = SENTENCE.findall(block[at]["element_text"])
    tall = sum(SPACE_BEFORE.get(e["element_type"], 0) + _tall(e) for e in block[:at])
    first, used = "", -1
    while tall < free and used < len(sentences) - 1:
        used += 1
        tall = height(first + sentences[used], WIDTH.get(block[at]["element_type"], 0))
        if tall < free:
            first += sentences[used]
    if first:
        pages.open += [*block[:at], _made("Dialogue", first), _made("Character", "(MORE)")]
        pages.turn()
    else:
        pages.turn()
        pages.open += block[1:at]
    cue, rest = _made("Character", block[0]["element_text"]), _made("Dialogue", "".join(sentences[max(0, used) :]))
    tail = [cue, rest, *block[at + 1 :]]
    pages.open += tail
    pages.y = sum(map(_tall, tail))


def lay_out(elements: list[dict], size: tuple[int, int] = LETTER) -> list[list[dict]]:
    """The pages of a script's elements."""
    pages = _Pages(size[1] - MARGINS)
    held: list[dict] = []
    tall, earlier_dual = 0, -1
    i = 0
    while i < len(elements):
        e = elements[i]
        i += 1
        if e["element_type"] == "Page Break":
            pages.open += [*held, e]
            held = []
            pages.turn()
            continue
        own, lead = _tall(e), _lead(e)
        if own <= 0:
            continue
        tall += own + (lead if pages.open else 0)
        if e["element_type"] == "Scene Heading" and i < len(elements):
            below = _tall(elements[i])
            if below >= LINE and tall + pages.y + below >= pages.room:
                held.append(_made("Page Break", ""))
            held.append(e)
            continue  # its height counts with the next block
        held.append(e)
        if e["element_type"] == "Character" and i < len(elements):
            width = WIDTH["Character"]
            while i < len(elements) and elements[i]["element_type"] in SPOKEN:
                held.append(elements[i])
                tall += _tall(elements[i], width)
                i += 1
            if e["is_dual_dialogue"]:
                if earlier_dual < 0:
                    earlier_dual = tall
                else:
                    tall, earlier_dual = abs(earlier_dual - tall), -1

        overflow = tall + pages.y - pages.room
        if overflow <= 0:
            pages.y += tall
        elif held[0]["element_type"] != "Character" or overflow < 4 * LINE:
            pages.turn(tall - lead)
        else:
            at = _spills_at(held, overflow)
            if at == 0:
                pages.turn(tall - lead)
            elif held[at]["element_type"] == "Parenthetical":
                if at > 1:
                    pages.open += [*held[:at], _made("Character", "(MORE)")]
                    pages.turn()
                    tail = [{**held[0], "element_text": f"{held[0]['element_text']} (CONT'D)"}, *held[at:]]
                    pages.open += tail
                    pages.y = sum(map(_tall, tail))
                    held = []
            else:
                free = pages.room - pages.y - 2 * LINE
                if free < 5 * LINE:
                    pages.turn(tall - lead)
                    tall = 0
                    continue  # the block waits for what follows it
                _split_speech(pages, held, at, free)
                held = []
        tall = 0
        pages.open += held
        held = []
    pages.open += held
    if pages.open:
        pages.turn()
    return pages.done


def paginate(elements: DataFrame, size: tuple[int, int] = LETTER) -> DataFrame:
    """A row per element and page; elements that the layout makes have no elem_idx. A page that was closed empty has one row
    without an element."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("elem_idx")
        pages = lay_out(rows[FIELDS].to_dict("records"), size)
        out = [{"page_idx": p, "pos_in_page": k, **e} for p, page in enumerate(pages) for k, e in enumerate(page or [dict.fromkeys(FIELDS)])]
        df = pd.DataFrame(out, columns=["page_idx", "pos_in_page", *FIELDS])
        df.insert(0, "script_id", rows["script_id"].iloc[0])
        df = df.astype({"elem_idx": "Int32", "section_depth": "Int32", "is_centered": "boolean", "is_dual_dialogue": "boolean"})
        return df

    return elements.select("script_id", *FIELDS).groupBy("script_id").applyInPandas(run, SCHEMA)


def page_at(pages: DataFrame, index: int) -> DataFrame:
    """The elements of one page of each script; none for a page that is empty or isn't there."""
    return pages.where((F.col("page_idx") == index) & F.col("element_type").isNotNull())


def page_counts(pages: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """The number of pages of each script; of scripts (script_id), where they are given, also of those without any."""
    found = pages.groupBy("script_id").agg((F.max("page_idx") + 1).alias("n_pages"))
    if scripts is None:
        return found
    return scripts.select("script_id").join(found, "script_id", "left").select("script_id", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
