import random

import pytest

from inkwell.operators import fast
from inkwell.sources.scripts import scripts_from_strings
from tests.line_machine import parse


def spark_parse(spark, texts):
    rows = fast.elements(scripts_from_strings(spark, texts)).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.script_id, r.elem_idx)):
        assert r.elem_idx == len(out[r.script_id])
        out[r.script_id].append({"kind": r.element_type, "text": r.element_text, "centered": r.is_centered, "number": r.scene_number, "dual": r.is_dual_dialogue, "depth": r.section_depth})
    return out


LINES = [
    "", "", "", "INT. HOUSE - DAY", "EXT. ROAD - NIGHT #12A#", "est. sea ", "I/E CAR", ".THE ROOF #1.#", "..not forced", "JOHN", "MARY ^", "JOHN (cont'd)", "@McAvoy", "(softly)",
    " (beat)", "Hello there.", "And more.", "CUT TO:", "FADE OUT.", "  FADE TO BLACK.", "CUT TO: ", "> FADE", "> centred <", "><", ">", "!BANG", "~la la", "# Act", " ## Two", "#", "= synopsis", "  =x",
    "===", "====  ", "[[note]]", "[[open", "a [[b]] c", "/* gone */", "/* begin", "middle", "end */", "tail text */ ", "*/", "  ", "   ", " ", "\t", "ÉÈ", "éè", "1234", "Title: My Script", "Author:", "\tMe", "FADE IN:",
    "  ", "x y", "a\x0bb",
]


def test_random_scripts_against_the_machine(spark):
    draw = random.Random(5)
    texts = ["\n".join(draw.choice(LINES) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    texts += ["", "\n\n", "a", "FADE IN:", "FADE IN:\n\nJOHN\nHi", "A\r\rB\rC", "T: x\r\n\r\nINT. A - DAY\r\n\r\nGo.", "   INT. X - DAY\n\nGo."]
    for text, found, wanted in zip(texts, spark_parse(spark, texts), map(parse, texts), strict=True):
        assert found == wanted, text


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("INT. A\n\nB.", ["Scene Heading", "Action"]),
        ("x\n\nINT. A\nmerged", ["Action", "Action"]),
        ("x\n\nJOHN\nHi.\n  \nMore.", ["Action", "Character", "Dialogue"]),
        ("~a\n\n~b", ["Lyrics", "Lyrics", "Lyrics"]),
        ("x\n\n/* a\nb", ["Action"]),
        ("x\n\n1234\nyes", ["Action", "Character", "Dialogue"]),
        ("x\n\nJOHN\n(a)\nb\nCUT TO:\nc", ["Action", "Character", "Parenthetical", "Dialogue", "Transition", "Dialogue"]),
    ],
)
def test_kinds(spark, text, kinds):
    assert [e["kind"] for e in spark_parse(spark, [text])[0]] == kinds


def test_null_text_has_no_rows(spark):
    assert spark_parse(spark, [None, "a"]) == [[], parse("a")]


def test_one_exchange(spark):
    df = fast.elements(scripts_from_strings(spark, ["a"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan.replace("PythonRDD", "")
