"""The line-by-line parser as window passes over lines.

Whether a line lies in a comment, follows a blank line, or stands in a dialogue block is, for each of these states, the last
event among the lines before it. With the states known, one ordered choice names the rule of each line; rules that go on
with the element before them are told from those that begin one by the kind of the last element begun; a running count of
beginnings numbers the elements, and an ordered aggregation joins their lines. All passes share one exchange by script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from inkwell.functions.text import BLANK, SPACE, ordered_join, trim
from inkwell.operators.normalize import body_lines

# Fixed values of the markup.
SCENE = r"(?i)^(INT|EXT|EST|(I|INT)\.?/(E|EXT)\.?)[.\-\t\n\f\r\p{Z}][^\n]+$"
SCENE_NUMBER = rf"#([^\n#]*?)#{SPACE}*$"
NOTE = rf"^{SPACE}*\[{{2}}{SPACE}*([^\]\n])+{SPACE}*\]{{2}}{SPACE}*$"
CUE = r"^[^a-z]+(\(cont'd\))?$"
CARET = rf"{SPACE}*\^{SPACE}*$"
FADES = ["FADE OUT.", "CUT TO BLACK.", "FADE TO BLACK."]

#: Rule: type of the element that it begins.
KINDS = {
    "lyric": "Lyrics", "forced_action": "Action", "forced_cue": "Character", "dialogue_gap": "Dialogue", "spaces": "Action",
    "boneyard": "Boneyard", "boneyard_end": "Boneyard", "page_break": "Page Break", "synopsis": "Synopsis", "note": "Comment",
    "section": "Section Heading", "forced_scene": "Scene Heading", "scene": "Scene Heading", "transition": "Transition",
    "centered": "Action", "forced_transition": "Transition", "cue": "Character", "parenthetical": "Parenthetical", "dialogue": "Dialogue",
}
ELEMENT_COLUMNS = ["script_id", "elem_idx", "element_type", "element_text", "is_centered", "scene_number", "is_dual_dialogue", "section_depth"]


def _by_line() -> WindowSpec:
    return Window.partitionBy("script_id").orderBy("line_no")


def _before() -> WindowSpec:
    return _by_line().rowsBetween(Window.unboundedPreceding, -1)


def _state(event: Column) -> Column:
    """The last event before a line, false without one."""
    return F.coalesce(F.last(event, ignorenulls=True).over(_before()), F.lit(False))


def line_facts(lines: DataFrame) -> DataFrame:
    """What each line looks like, whatever stands around it."""
    line = F.col("line")
    return lines.withColumn("following", F.lead("line").over(_by_line())).withColumns({
        "tilde": line.startswith("~"), "bang": line.startswith("!"), "at": line.startswith("@"),
        "two_spaces": line.rlike(f"^{SPACE}{{2}}$"), "all_spaces": line.rlike(f"^{SPACE}{{2,}}$"), "blank": line == "",
        "opens": line.startswith("/*"), "closes": line.rlike(rf"\*/{SPACE}*$"), "rule_line": line.rlike(f"^={{3,}}{SPACE}*$"),
        "equals": line.rlike(f"^{BLANK}*="), "bracketed": line.rlike(NOTE), "hash": line.rlike(f"^{BLANK}*#"),
        "dotted": line.rlike(r"^\.[^.]"), "heading": line.rlike(SCENE), "to_end": line.endswith("TO:"),
        "fade": F.regexp_replace(line, f"^{SPACE}*", "").isin(FADES), "arrow": line.startswith(">"),
        "cue_like": line.rlike(CUE) & F.col("following").isNotNull() & (F.col("following") != ""), "paren": line.rlike(rf"^{SPACE}*\("),
    })


def comment_state(facts: DataFrame) -> DataFrame:
    """marked (lines taken before comments are looked for) and in_comment."""
    df = facts.withColumn("marked", F.col("tilde") | F.col("bang") | F.col("at") | F.col("all_spaces"))
    event = F.when(F.col("marked"), F.lit(None)).when(F.col("opens"), ~F.col("closes")).when(F.col("closes"), F.lit(False))
    return df.withColumn("in_comment", _state(event))


def blank_state(df: DataFrame) -> DataFrame:
    """after_blank: whether a blank line has come since the last line that counts."""
    silent = F.lit(None).cast("boolean")
    event = (
        F.when(F.col("marked"), F.lit(False))
        .when(F.col("blank") & ~F.col("in_comment"), F.lit(True))
        .when(F.col("opens"), F.when(F.col("closes"), F.lit(False)))
        .when(F.col("closes"), F.lit(False))
        .when(F.col("in_comment"), silent)
        .when(F.col("rule_line"), F.lit(False))
        .when(F.col("equals") | F.col("bracketed"), silent)
        .otherwise(F.lit(False))
    )
    return df.withColumn("after_blank", _state(event))


def dialogue_state(df: DataFrame) -> DataFrame:
    """is_cue and in_dialogue: only a blank line ends a block."""
    taken = F.col("marked") | F.col("opens") | F.col("closes") | F.col("in_comment") | F.col("rule_line") | F.col("equals") | F.col("bracketed")
    taken = taken | F.col("hash") | F.col("dotted") | F.col("heading") | F.col("to_end") | F.col("fade") | F.col("arrow")
    df = df.withColumn("is_cue", F.col("after_blank") & F.col("cue_like") & ~taken)
    event = F.when(F.col("at") | F.col("is_cue"), F.lit(True)).when(F.col("blank") & ~F.col("in_comment"), F.lit(False))
    return df.withColumn("in_dialogue", _state(event))


def with_rules(df: DataFrame) -> DataFrame:
    """rule: the first that fits."""
    c = F.col
    rest = F.regexp_replace("line", f"^{SPACE}*#+", "")
    rule = (
        F.when(c("tilde"), "lyric").when(c("bang"), "forced_action").when(c("at"), "forced_cue")
        .when(c("two_spaces") & c("in_dialogue"), "dialogue_gap").when(c("all_spaces"), "spaces")
        .when(c("blank") & ~c("in_comment"), "blank")
        .when(c("opens") & c("closes"), "boneyard").when(c("opens"), "boneyard_begin").when(c("closes"), "boneyard_end")
        .when(c("in_comment"), "boneyard_line").when(c("rule_line"), "page_break").when(c("equals"), "synopsis")
        .when(c("after_blank") & c("bracketed"), "note").when(c("hash"), F.when(rest == "", "empty_section").otherwise("section"))
        .when(c("dotted"), "forced_scene").when(c("after_blank") & c("heading"), "scene").when(c("to_end") | c("fade"), "transition")
        .when(c("arrow") & (F.length("line") > 1) & c("line").endswith("<"), "centered").when(c("arrow"), "forced_transition")
        .when(c("is_cue"), "cue").when(c("in_dialogue") & ~c("after_blank") & c("paren"), "parenthetical").when(c("in_dialogue"), "dialogue")
        .otherwise("plain")
    )
    return df.withColumn("rule", rule)


def classified(scripts: DataFrame) -> DataFrame:
    """script_id, line_no, line and rule of every body line, with the states."""
    df = with_rules(dialogue_state(blank_state(comment_state(line_facts(body_lines(scripts))))))
    return df.select("script_id", "line_no", "line", "in_comment", "after_blank", "in_dialogue", "rule")


def _piece() -> Column:
    """What a line that begins an element gives to its text."""
    line, c = F.col("line"), F.col("rule")
    unnumbered = F.regexp_replace(line, SCENE_NUMBER, "")
    inner = trim(F.substring(line, 2, 2**31 - 1))
    return (
        F.when(c == "boneyard", F.replace(F.replace(line, F.lit("/*"), F.lit("")), F.lit("*/"), F.lit("")))
        .when(c == "boneyard_end", "").when(c == "synopsis", F.regexp_replace(line, f"^{SPACE}*=", ""))
        .when(c == "note", trim(F.replace(F.replace(line, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))))
        .when(c == "section", F.regexp_replace(line, f"^{SPACE}*#+", "")).when(c == "forced_scene", trim(F.substring(unnumbered, 2, 2**31 - 1)))
        .when(c == "scene", unnumbered).when(c == "centered", trim(F.substring(inner, F.lit(1), F.length(inner) - 1)))
        .when(c == "forced_transition", inner).when(c == "cue", F.regexp_replace(line, CARET, "")).otherwise(line)
    )


def elements(scripts: DataFrame) -> DataFrame:
    """ELEMENT_COLUMNS of every element of every script; a script without text has none."""
    rule = F.col("rule")
    df = classified(scripts).withColumn("kind", F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[rule])
    leaves = F.col("kind").isNotNull() | (rule == "plain")
    df = df.withColumn("any_before", F.coalesce(F.max(leaves).over(_before()), F.lit(False)))
    fresh = (rule == "plain") & (F.col("after_blank") | ~F.col("any_before"))
    df = df.withColumn("kind", F.when(fresh, "Action").otherwise(F.col("kind")))
    df = df.withColumn("last_kind", F.coalesce(F.last("kind", ignorenulls=True).over(_before()), F.lit("")))
    goes_on = rule.isin("dialogue", "dialogue_gap") & (F.col("last_kind") == "Dialogue")
    df = df.withColumn("starts", F.col("kind").isNotNull() & ~goes_on)
    df = df.withColumn("spacer", (rule == "lyric") & (F.col("last_kind") == "Lyrics") & F.col("after_blank"))
    begun = F.sum(F.col("starts").cast("int") + F.col("spacer").cast("int")).over(_by_line().rowsBetween(Window.unboundedPreceding, 0)) - 1
    df = df.withColumn("idx", begun.cast("int"))
    backwards = Window.partitionBy("script_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(rule == "boneyard_end", F.col("idx")), ignorenulls=True).over(backwards)  # where its comment ends
    in_block = rule.isin("boneyard_begin", "boneyard_line")
    df = df.withColumn("idx", F.when(in_block, ahead).otherwise(F.col("idx"))).where(~rule.isin("blank", "empty_section") & F.col("idx").isNotNull())

    piece = (
        F.when(rule == "boneyard_begin", "\n").when(rule == "boneyard_line", F.concat("line", F.lit("\n")))
        .when(F.col("starts"), _piece()).otherwise(F.concat(F.lit("\n"), "line"))
    )
    number = F.when(rule.isin("scene", "forced_scene") & F.col("line").rlike(SCENE_NUMBER), F.regexp_extract("line", SCENE_NUMBER, 1))
    depth = F.when(rule == "section", F.length(F.regexp_extract("line", f"^({SPACE}*#+)", 1))).otherwise(0)
    both = F.when(F.col("spacer"), F.array(F.col("idx") - 1, F.col("idx"))).otherwise(F.array("idx"))
    df = df.select("script_id", "line_no", "idx", "kind", "starts", "rule", piece.alias("piece"), number.alias("number"), depth.alias("depth"), F.col("line").rlike(CARET).alias("caret"), F.explode(both).alias("elem_idx"))
    df = df.withColumn("piece", F.when(F.col("elem_idx") != F.col("idx"), " ").otherwise(F.col("piece")))
    joined = df.groupBy("script_id", "elem_idx").agg(
        F.max(F.when(F.col("starts"), F.col("kind"))).alias("element_type"),
        F.max((rule == "plain") & ~F.col("starts")).alias("merged"),
        ordered_join([F.col("line_no")], F.col("piece"), "").alias("element_text"),
        F.max(rule == "centered").alias("is_centered"),
        F.max("number").alias("scene_number"),
        F.max((rule == "cue") & F.col("caret")).alias("caret"),
        F.max("depth").alias("section_depth"),
    )
    kind = F.when((F.col("element_type") == "Scene Heading") & F.col("merged"), "Action").otherwise(F.col("element_type"))
    joined = joined.withColumn("element_type", kind)
    same_type = Window.partitionBy("script_id", "element_type").orderBy("elem_idx")
    dual = (F.col("element_type") == "Character") & (F.col("caret") | F.coalesce(F.lead("caret").over(same_type), F.lit(False)))
    return joined.withColumn("is_dual_dialogue", dual).select(*ELEMENT_COLUMNS)
