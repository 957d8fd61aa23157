"""The page layout against the recursive SQL, step by step, on random scripts that fill pages in every way."""

import collections
import random

import duckdb
import pandas as pd

from inkwell.operators import paginate
from inkwell.plans.layout_sql import LAYOUT
from inkwell.plans.oracle import ELEMENTS

KINDS = ["Action", "Scene Heading", "Character", "Dialogue", "Parenthetical", "Transition", "Page Break", "Comment", "Lyrics"]


def script(draw, script_id):
    """Elements in bursts: speeches of several sentences, cues without any, headings in a row, tall actions, empty texts."""
    out = []

    def add(kind, text, **more):
        out.append({"script_id": script_id, "elem_idx": len(out), "element_type": kind, "element_text": text, "is_centered": False, "scene_number": None, "is_dual_dialogue": False, "section_depth": 0, **more})

    def words(n):
        return " ".join("x" * draw.randint(1, 9) + draw.choice(["", "", ",", ".", "!", "?.."]) for _ in range(n))

    for _ in range(draw.randint(1, 40)):
        pick = draw.random()
        if pick < 0.45:
            add("Character", "JANE " * draw.randint(1, 2), is_dual_dialogue=draw.random() < 0.3)
            for _ in range(draw.randint(0, 4)):
                kind = draw.choice(["Dialogue", "Dialogue", "Parenthetical"])
                add(kind, words(draw.choice([3, 30, 200])) if kind == "Dialogue" else f"({words(4)})")
        elif pick < 0.6:
            add("Scene Heading", words(draw.randint(1, 4)))
        elif pick < 0.65:
            add("Action", words(draw.choice([300, 900])))
        elif pick < 0.7:
            add("Action", "y" * draw.choice([58, 59, 60, 130]) + " " + "z" * draw.choice([1, 70, 200]))
        else:
            add(draw.choice(KINDS), draw.choice(["", words(5), words(40), f"{words(3)}\n{words(50)}"]))
    return out


def test_pages_match_the_recursive_sql():
    draw = random.Random(5)
    scripts = [script(draw, i) for i in range(400)]
    con = duckdb.connect()
    con.register("elements", pd.DataFrame([e for s in scripts for e in s]))
    chain = LAYOUT.removeprefix(ELEMENTS).lstrip(",\n")
    found = con.execute(f"WITH RECURSIVE {chain} SELECT script_id, page_idx, pos_in_page, elem_idx, element_type, element_text FROM laid_out ORDER BY ALL").fetchall()
    wanted = []
    for s in scripts:
        plain = [{k: v for k, v in e.items() if k != "script_id"} for e in s]
        for p, page in enumerate(paginate.lay_out(plain)):
            wanted += [(s[0]["script_id"], p, k, e["elem_idx"], e["element_type"], e["element_text"]) for k, e in enumerate(page or [dict.fromkeys(plain[0])])]
    key = lambda r: r[:3]
    assert sorted(wanted, key=key) == sorted(found, key=key)
    made = collections.Counter(r[4:] for r in wanted if r[3] is None)
    assert made["Character", "(MORE)"] > 50 and made["Page Break", ""] > 10 and made[None, None] > 10  # splits, headings kept with what follows, empty pages
    assert any(r[5] and r[5].endswith(" (CONT'D)") for r in wanted)
