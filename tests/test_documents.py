import pytest

from inkwell.functions import regex as rx
from inkwell.operators import html, paginate, title_page, writer
from inkwell.operators.describe import described
from inkwell.plans.script import Corpus
from inkwell.sources.scripts import scripts_from_strings, write_script_files


def titles(spark, text):
    rows = title_page.title_page(scripts_from_strings(spark, [text])).orderBy("entry_idx").collect()
    return [(r["key"], r["values"]) for r in rows]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Title: A\nAuthor: B\n\nGo.", [("title", ["A"]), ("authors", ["B"])]),
        ("Title:\n\tA\n\tB: C\nDraft date: x\n\nGo.", [("title", ["A", "B: C"]), ("draft date", ["x"])]),
        ("FADE IN:\n\nGo.", []),
        ("Title:\nCredit:\n  by\n\n", [("title", []), ("credit", ["by"])]),
        ("Title: A\nstray\nNotes:\n x\n\n", [("title", ["A"]), ("notes", ["x"])]),
        ("Just text.\n\nMore", []),
        ("", []),
    ],
)
def test_title_page(spark, text, wanted):
    assert titles(spark, text) == wanted


SIMPLE = """Title: Simple
Author: Nobody

INT. ROOM - DAY #1#

A man waits.
He waits more.

JOHN
(softly)
Hello.

MARY ^
Hi.

# Act

=Things happen

> CENTRED <

====

/*gone*/

[[a note]]
"""


def test_round_trip_is_stable(spark):
    """But for scene numbers, before which every writing puts one more space."""
    plain = SIMPLE.replace(" #1#", "")
    first = Corpus.load_string(spark, plain).string_from_document().collect()[0].text
    again = Corpus.load_string(spark, first).string_from_document().collect()[0].text
    assert again == first and first.startswith("Title: Simple\nAuthor: Nobody\n\n\nINT. ROOM - DAY\n")
    assert "INT. ROOM - DAY  #1#" in Corpus.load_string(spark, SIMPLE).string_from_document().collect()[0].text


def test_writer_details(spark):
    def body(text, **k):
        c = Corpus(scripts_from_strings(spark, [text]), **k)
        return c.string_from_body().collect()[0].body

    assert body("x\n\n.THE ROOF") == "\nx\n\n.THE ROOF\n"
    assert body("x\n\nEST. SEA") == "\nx\n\n.EST. SEA\n"
    assert body("x\n\nINT. A #5#", suppress_scene_numbers=True) == "\nx\n\nINT. A \n"
    assert body("x\n\nCUT TO:") == "\nx\n\n> CUT TO:\n"
    assert body("x\n\n## Two") == "\nx\n\n## Two\n"
    assert body("x\n\nA\nb\n\nC ^\nd\n\nE ^\nf") == "\nx\n\nA\nb\n\nC ^\nd\n\nE\nf\n"
    two = "Title:\n\tA\n\tB\nauthor:\n\tX\n\nx"
    assert Corpus.load_string(spark, two).string_from_title_page().collect()[0].title == "Title:\n\tA\n\tB\nAuthor: X\n"


def test_descriptions(spark):
    text = "x\n\n> c <\n\nA\nb\n\nC ^\nd\n\n## s"
    rows = described(Corpus.load_string(spark, text).elements).orderBy("elem_idx").collect()
    assert [r.description for r in rows] == ["Action: x", "Action (centered): c", "Character (dual dialogue): A", "Dialogue: b", "Character (dual dialogue): C", "Dialogue: d", "Section Heading (2d):  s"]


def legacy(spark, text):
    rows = Corpus.load_string(spark, text, "regex").elements.orderBy("elem_idx").collect()
    return [(r.element_type, r.element_text) for r in rows]


def test_legacy_parser(spark):
    found = legacy(spark, "Title: A\n    b\n\nINT. ROOM - DAY\n\nHe waits...\n\nJOHN\n(softly)\nHello.\n\n> FADE OUT.\n\n# Act\n\n/*a\nb*/\n\n===\n\nEnd.")
    assert found[:5] == [("Scene Heading", "INT. ROOM - DAY"), ("Action", "He waits..."), ("Character", "JOHN"), ("Parenthetical", "(softly)"), ("Dialogue", "Hello.")]
    assert ("Transition", "> FADE OUT.") in found and ("Boneyard", "a\nb") in found and ("Page Break", "") in found and found[-1] == ("Action", "End.")
    # the section rewrite takes every #, so a numbered heading ends as a section
    assert legacy(spark, "x\n\nINT. A #4a#\n\ny")[1] == ("Section Heading", "4a#")
    t = Corpus.load_string(spark, "Title:\n    Big\n    Two\nEmpty:\nAuthor: Me\n\nINT. A\n", "regex").title_page.orderBy("entry_idx").collect()
    assert [(r["key"], r["values"]) for r in t] == [("title", ["Big", "Two"]), ("authors", ["Me"])]


def test_legacy_dual_dialogue(spark):
    rows = Corpus.load_string(spark, "INT. A\n\nGo.\n\nJOHN\nHi.\n\nMARY ^\nHo.\n\nEnd.\n", "regex").elements.orderBy("elem_idx").collect()
    assert [(r.element_text, r.is_dual_dialogue) for r in rows if r.element_type == "Character"] == [("JOHN", True), ("MARY", True)]


def test_unknown_parser(spark):
    with pytest.raises(ValueError):
        Corpus.load_string(spark, "x", "other")


def element(kind, text, **more):
    return {"elem_idx": 0, "element_type": kind, "element_text": text, "is_centered": False, "scene_number": None, "is_dual_dialogue": False, "section_depth": 0, **more}


def test_heights():
    assert paginate.height("", 430) == 0
    assert paginate.height("x" * 59, 430) == 12 and paginate.height("x" * 60, 430) == 24
    assert paginate.height("a\nb", 430) == 24 and paginate.height("x" * 500, 0) == 12


def test_pages_fill_and_turn():
    pages = paginate.lay_out([element("Action", f"line {i}") for i in range(60)])
    assert [len(p) for p in pages] == [27, 27, 6]  # 12 points, then 24 each, in 647
    pages = paginate.lay_out([element("Action", "a"), element("Page Break", "==="), element("Action", "b")])
    assert [[e["element_text"] for e in p] for p in pages] == [["a", "==="], ["b"]]
    assert paginate.lay_out([]) == [] and paginate.lay_out([element("Action", "")]) == []


def test_long_speech_is_split_with_more():
    filler = [element("Action", "x") for _ in range(20)]
    speech = " ".join(f"Sentence number {i} goes on." for i in range(60))
    pages = paginate.lay_out([*filler, element("Character", "JOHN"), element("Dialogue", speech), element("Action", "end")])
    assert pages[0][-1]["element_text"] == "(MORE)" and pages[1][0]["element_text"] == "JOHN"
    assert (pages[0][-2]["element_text"] + pages[1][1]["element_text"]).count("Sentence number 59") == 1


def test_speech_is_split_at_a_parenthetical():
    filler = [element("Action", "x") for _ in range(22)]
    block = [element("Character", "JOHN"), *[e for i in range(12) for e in (element("Dialogue", "Words."), element("Parenthetical", f"({i} " + "softly " * 5 + ")"))]]
    pages = paginate.lay_out([*filler, *block])
    texts = [[e["element_text"] for e in p] for p in pages]
    assert texts[0][-1] == "(MORE)" and texts[1][0] == "JOHN (CONT'D)" and texts[1][1].startswith("(8 ")
    assert block[0]["element_text"] == "JOHN"


def test_html(spark):
    out = Corpus.load_string(spark, SIMPLE + "\nHe is ***very*** _late_ *now* [[hidden]].\n").html().collect()[0].html
    for part in ("<p class='title'>Simple<br></p>", "<p class='credit'>written by</p>", "<span class='scene-number-left'>1</span>", "<p class='page-break'>1.</p>",
                 "<div class='dual-dialogue'>\n<div class='dual-dialogue-left'>\n<p class='character'>JOHN</p>", "</div>\n<div class='dual-dialogue-right'>\n<p class='character'>MARY</p>",
                 "<p class='action center'>CENTRED</p>", "<strong><em>very</strong></em> <u>late</u> <em>now</em> .", "</section>\n<section>"):
        assert part in out, part
    assert "gone" not in out and "a note" not in out


def test_html_escapes_on_request(spark):
    c = Corpus.load_string(spark, "x\n\na <b> & c")
    assert "a <b> & c" in c.html().collect()[0].html and "a &lt;b&gt; &amp; c" in c.html(escape=True).collect()[0].html


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.txt").write_text("INT. A - DAY\r\n\r\nHello é.\r\n", encoding="utf-8")
    c = Corpus.load_file(spark, str(tmp_path / "in"))
    assert c.scripts.collect()[0].filename == "one.txt"
    c.write(str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).collect()[0].value.rstrip("\n") == "INT. A - DAY\n\nHello é."
    write_script_files(c.string_from_document(), str(tmp_path / "each"))
    assert len(list((tmp_path / "each").glob("script_id=*"))) == 1


def test_regex_functions(spark):
    df = spark.createDataFrame([("ab12cd345",), ("none",), (None,)], "s string")
    c = df["s"]
    row = lambda col: [r[0] for r in df.select(col).collect()]
    assert row(rx.is_matched(c, "AB", "i")) == [True, False, None]
    assert row(rx.matching(c, r"([a-z]+)(\d+)", 2)) == ["12", None, None]
    assert [r and tuple(r) for r in row(rx.range_of(c, r"\d+"))] == [(2, 2), None, None]
    assert [r and tuple(r) for r in row(rx.range_of(c, r"([a-z]+)(\d+)", 2))][:1] == [(2, 2)]
    assert row(rx.replaced(c, r"(\d)", "<$1>")) == ["ab<1><2>cd<3><4><5>", "none", None]
    assert row(rx.components_matched(c, r"\d+")) == [["12", "345"], [], None]
    assert row(rx.components_separated(c, r"\d+")) == [["ab", "cd", ""], ["none"], None]
    assert row(rx.capture_components(c, r"([a-z]+)(\d+)", 2)) == [["ab12", "ab", "12"], [], None]
    assert row(rx.array_of_captures(c, r"([a-z]+)(\d+)", 2)) == [[["ab12", "ab", "12"], ["cd345", "cd", "345"]], [], None]
    assert row(rx.dictionary(c, r"([a-z]+)(\d+)", {"w": 1, "n": 2})) == [{"w": "ab", "n": "12"}, None, None]
    assert row(rx.array_of_dictionaries(c, r"([a-z])(\d)", {"w": 1})) == [[{"w": "b"}, {"w": "d"}], [], None]
    assert [r[0] for r in df.select(rx.enumerated(c, r"\d+")).collect()] == ["12", "345"]
    assert row(rx.replaced_by(c, r"([a-z]+)(\d+)", lambda m: f"<{m[2]}:{m[1].upper()}>")) == ["<12:AB><345:CD>", "none", None]
    assert row(rx.in_range(c, 1, 3))[0] == "b12"
    assert rx.capture_count(spark, "(a)(b(c))") == 3 and rx.is_valid(spark, "a+") and not rx.is_valid(spark, "(")


def test_page_access(spark):
    pages = Corpus.load_string(spark, "a\n\n===\n\nb").pages()
    assert paginate.page_counts(pages).collect()[0].n_pages == 2
    assert paginate.page_at(pages, 1).collect()[0].element_text == "b" and paginate.page_at(pages, 9).count() == 0


def test_empty_corpus(spark):
    c = Corpus(scripts_from_strings(spark, []))
    assert c.elements.count() == c.title_page.count() == c.pages().count() == c.html().count() == c.string_from_document().count() == 0
    assert html.title_html(c.title_page).count() == writer.bodies(c.elements).count() == 0
