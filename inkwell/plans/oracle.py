"""The line-by-line parser and the writer in plain SQL, to hold results against."""

from __future__ import annotations

from inkwell.functions.text import BLANK, IN_SPACE, NEWLINES, SPACE
from inkwell.operators.fast import CARET, CUE, FADES, KINDS, NOTE, SCENE, SCENE_NUMBER
from inkwell.operators.normalize import DIRECTIVE, INLINE
from inkwell.plans.corpus import quoted


def m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def sub(column: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({column}, {quoted(pattern)}, {quoted(to)}, 'g')"


def trim(column: str) -> str:
    return sub(column, f"^{BLANK}+|{BLANK}+$")


NORMAL = f"""
norm AS (SELECT script_id, regexp_replace(regexp_replace(text, {quoted(f"^[{IN_SPACE}]*")}, ''), '\\r\\n|\\r|\\n', chr(10), 'g') || chr(10) || chr(10) AS contents FROM scripts),
tops AS (SELECT *, string_split(contents, chr(10) || chr(10))[1] AS top FROM norm),
keyed AS (SELECT *, len([x FOR x IN string_split(top, chr(10)) IF {m("x", DIRECTIVE)} OR {m("x", INLINE)}]) AS n_keys, {m("string_split(top, chr(10))[-1]", DIRECTIVE)} AS ends_open FROM tops),
titled AS (SELECT *, n_keys > 0 AND NOT (n_keys = 1 AND ends_open) AS has_title FROM keyed),
bodies AS (SELECT script_id, chr(10) || CASE WHEN has_title THEN replace(contents, top, '') ELSE contents END AS body FROM titled),
lines AS (SELECT script_id, (i - 1)::INT AS line_no, ls[i] AS line FROM (SELECT script_id, string_split_regex(body, {quoted(NEWLINES)}) AS ls FROM bodies), unnest(range(1, len(ls) + 1)) AS t(i))"""

_LAST = "OVER (PARTITION BY script_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

RULES = f"""{NORMAL},
facts AS (SELECT *, lead(line) OVER (PARTITION BY script_id ORDER BY line_no) AS following, line[1] IN ('~', '!', '@') OR {m("line", f"^{SPACE}{{2,}}$")} AS marked,
  starts_with(line, '/*') AS opens, {m("line", rf"\*/{SPACE}*$")} AS closes, {m("line", f"^={{3,}}{SPACE}*$")} AS rule_line, {m("line", f"^{BLANK}*=")} AS equals, {m("line", NOTE)} AS bracketed,
  {m("line", f"^{BLANK}*#")} AS hash, {m("line", r"^\.[^.]")} AS dotted, {m("line", SCENE)} AS heading,
  ends_with(line, 'TO:') OR {sub("line", f"^{SPACE}*")} IN ({", ".join(map(quoted, FADES))}) AS moves FROM lines),
c1 AS (SELECT *, coalesce(last_value(CASE WHEN marked THEN NULL WHEN opens THEN NOT closes WHEN closes THEN false END IGNORE NULLS) {_LAST}, false) AS in_comment FROM facts),
c2 AS (SELECT *, coalesce(last_value(CASE WHEN marked THEN false WHEN line = '' AND NOT in_comment THEN true WHEN opens THEN CASE WHEN closes THEN false END WHEN closes THEN false
  WHEN in_comment THEN NULL WHEN rule_line THEN false WHEN equals OR bracketed THEN NULL ELSE false END IGNORE NULLS) {_LAST}, false) AS after_blank FROM c1),
c3 AS (SELECT *, after_blank AND {m("line", CUE)} AND following IS NOT NULL AND following <> '' AND NOT (marked OR opens OR closes OR in_comment OR rule_line OR equals OR bracketed OR hash OR dotted OR heading OR moves OR starts_with(line, '>')) AS is_cue FROM c2),
c4 AS (SELECT *, coalesce(last_value(CASE WHEN line[1] = '@' OR is_cue THEN true WHEN line = '' AND NOT in_comment THEN false END IGNORE NULLS) {_LAST}, false) AS in_dialogue FROM c3),
rules AS (SELECT *, CASE WHEN line[1] = '~' THEN 'lyric' WHEN line[1] = '!' THEN 'forced_action' WHEN line[1] = '@' THEN 'forced_cue'
  WHEN marked AND length(line) = 2 AND in_dialogue THEN 'dialogue_gap' WHEN marked THEN 'spaces' WHEN line = '' AND NOT in_comment THEN 'blank'
  WHEN opens AND closes THEN 'boneyard' WHEN opens THEN 'boneyard_begin' WHEN closes THEN 'boneyard_end' WHEN in_comment THEN 'boneyard_line'
  WHEN rule_line THEN 'page_break' WHEN equals THEN 'synopsis' WHEN after_blank AND bracketed THEN 'note'
  WHEN hash THEN CASE WHEN {sub("line", f"^{SPACE}*#+")} = '' THEN 'empty_section' ELSE 'section' END
  WHEN dotted THEN 'forced_scene' WHEN after_blank AND heading THEN 'scene' WHEN moves THEN 'transition'
  WHEN starts_with(line, '>') AND length(line) > 1 AND ends_with(line, '<') THEN 'centered' WHEN starts_with(line, '>') THEN 'forced_transition'
  WHEN is_cue THEN 'cue' WHEN in_dialogue AND NOT after_blank AND {m("line", rf"^{SPACE}*\(")} THEN 'parenthetical' WHEN in_dialogue THEN 'dialogue' ELSE 'plain' END AS rule FROM c4)"""

_UNNUMBERED = sub("line", SCENE_NUMBER)
_INNER = trim("substr(line, 2)")
ELEMENTS = f"""{RULES},
e1 AS (SELECT *, CASE rule {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} END AS kind0, coalesce(bool_or(rule NOT IN ('blank', 'boneyard_begin', 'boneyard_line', 'empty_section')) {_LAST}, false) AS any_before FROM rules),
e2 AS (SELECT *, CASE WHEN rule = 'plain' AND (after_blank OR NOT any_before) THEN 'Action' ELSE kind0 END AS kind FROM e1),
e3 AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) {_LAST}, '') AS last_kind FROM e2),
e4 AS (SELECT *, kind IS NOT NULL AND NOT (rule IN ('dialogue', 'dialogue_gap') AND last_kind = 'Dialogue') AS starts, rule = 'lyric' AND last_kind = 'Lyrics' AND after_blank AS spacer FROM e3),
e5 AS (SELECT *, sum(starts::INT + spacer::INT) OVER (PARTITION BY script_id ORDER BY line_no) - 1 AS idx FROM e4),
e6 AS (SELECT *, CASE WHEN rule IN ('boneyard_begin', 'boneyard_line') THEN first_value(CASE WHEN rule = 'boneyard_end' THEN idx END IGNORE NULLS) OVER (PARTITION BY script_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE idx END AS slot FROM e5),
e7 AS (SELECT *, CASE WHEN rule = 'boneyard_begin' THEN chr(10) WHEN rule = 'boneyard_line' THEN line || chr(10) WHEN NOT starts THEN chr(10) || line
  WHEN rule = 'boneyard' THEN replace(replace(line, '/*', ''), '*/', '') WHEN rule = 'boneyard_end' THEN '' WHEN rule = 'synopsis' THEN {sub("line", f"^{SPACE}*=")}
  WHEN rule = 'note' THEN {trim("replace(replace(line, '[[', ''), ']]', '')")} WHEN rule = 'section' THEN {sub("line", f"^{SPACE}*#+")}
  WHEN rule = 'forced_scene' THEN {trim(f"substr({_UNNUMBERED}, 2)")} WHEN rule = 'scene' THEN {_UNNUMBERED}
  WHEN rule = 'centered' THEN {trim(f"substr({_INNER}, 1, length({_INNER}) - 1)")} WHEN rule = 'forced_transition' THEN {_INNER}
  WHEN rule = 'cue' THEN {sub("line", CARET)} ELSE line END AS piece,
  CASE WHEN rule IN ('scene', 'forced_scene') AND {m("line", SCENE_NUMBER)} THEN regexp_extract(line, {quoted(SCENE_NUMBER)}, 1) END AS number,
  CASE WHEN rule = 'section' THEN length(regexp_extract(line, {quoted(f"^({SPACE}*#+)")}, 1)) ELSE 0 END AS depth, rule = 'cue' AND {m("line", CARET)} AS caret
  FROM e6 WHERE rule NOT IN ('blank', 'empty_section') AND slot IS NOT NULL),
e8 AS (SELECT script_id, slot, kind, starts, rule, line_no, piece, number, depth, caret FROM e7 UNION ALL SELECT script_id, slot - 1, kind, starts, rule, line_no, ' ', NULL, 0, false FROM e7 WHERE spacer),
e9 AS (SELECT script_id, slot AS elem_idx, max(CASE WHEN starts THEN kind END) AS kind, bool_or(rule = 'plain' AND NOT starts) AS merged, string_agg(piece, '' ORDER BY line_no) AS element_text,
  bool_or(rule = 'centered') AS is_centered, max(number) AS scene_number, bool_or(caret) AS caret, max(depth) AS section_depth FROM e8 GROUP BY script_id, slot),
e10 AS (SELECT *, CASE WHEN kind = 'Scene Heading' AND merged THEN 'Action' ELSE kind END AS element_type FROM e9),
elements AS (SELECT script_id, elem_idx::INT AS elem_idx, element_type, element_text, is_centered, scene_number,
  element_type = 'Character' AND (caret OR coalesce(lead(caret) OVER (PARTITION BY script_id, element_type ORDER BY elem_idx), false)) AS is_dual_dialogue, section_depth::INT AS section_depth FROM e10)"""

TITLES = f"""{NORMAL},
t1 AS (SELECT script_id, i AS line_no, ls[i] AS line FROM (SELECT script_id, string_split(top, chr(10)) AS ls FROM titled WHERE has_title), unnest(range(1, len(ls) + 1)) AS t(i)),
t2 AS (SELECT *, {m("line", DIRECTIVE)} AS directive, {m("line", INLINE)} AS inline FROM t1),
t3 AS (SELECT *, sum((directive OR inline)::INT) OVER (PARTITION BY script_id ORDER BY line_no) - 1 AS entry_idx FROM t2),
t4 AS (SELECT script_id, entry_idx::INT AS entry_idx, max(CASE WHEN directive OR inline THEN lower(regexp_extract(line, '^([^:]+):', 1)) END) AS name, bool_or(directive) AS open,
  array_agg(CASE WHEN inline AND NOT directive THEN regexp_extract(line, {quoted(INLINE)}, 2) ELSE {trim("line")} END ORDER BY line_no) FILTER (NOT directive) AS rest,
  array_agg(CASE WHEN inline THEN regexp_extract(line, {quoted(INLINE)}, 2) END ORDER BY line_no) FILTER (inline AND NOT directive) AS own FROM t3 WHERE entry_idx >= 0 GROUP BY script_id, entry_idx),
titles AS (SELECT script_id, entry_idx, CASE WHEN name = 'author' THEN 'authors' ELSE name END AS key, coalesce(CASE WHEN open THEN rest ELSE own END, []) AS "values" FROM t4)"""

# RE2 has no look-behind; a heading's text stands between line ends, so that anchors at line starts say the same.
_HEADER = r"(?m)^(([iI][nN][tT]|[eE][xX][tT]|[^\w\n][eE][sS][tT]|\.|[iI]\.?/[eE]\.?)([^\n]+))$"
_MOVE = r"\n([\*_]*([^<>\na-z]*TO:|FADE TO BLACK\.|FADE OUT\.|CUT TO BLACK\.)[\*_]*)\n"
BODIES = f"""{ELEMENTS},
w1 AS (SELECT *, CASE WHEN element_type = 'Character' AND is_dual_dialogue THEN sum((element_type = 'Character' AND is_dual_dialogue)::INT) OVER (PARTITION BY script_id ORDER BY elem_idx) END AS dual_no
  FROM elements WHERE element_type = 'Page Break' OR NOT {m("element_text", f"^[{IN_SPACE}]*$")}),
w2 AS (SELECT *, CASE element_type WHEN 'Comment' THEN chr(10) || '[[' || element_text || ']]' WHEN 'Boneyard' THEN '/*' || element_text || '*/' WHEN 'Synopsis' THEN '=' || element_text
  WHEN 'Scene Heading' THEN (CASE WHEN {m("element_text", _HEADER)} THEN '' ELSE '.' END) || element_text || coalesce(' #' || scene_number || '#', '')
  WHEN 'Page Break' THEN '====' WHEN 'Section Heading' THEN repeat('#', section_depth) || element_text
  WHEN 'Transition' THEN CASE WHEN {m("element_text", _MOVE)} THEN '(null)' ELSE '> ' || element_text END ELSE element_text END AS t FROM w1),
w3 AS (SELECT *, CASE WHEN is_centered THEN '> ' || t || (CASE WHEN ends_with(t, ' ') THEN '<' ELSE ' <' END) ELSE t END || (CASE WHEN dual_no % 2 = 0 THEN ' ^' ELSE '' END) AS u FROM w2),
written AS (SELECT script_id, string_agg((CASE WHEN element_type IN ('Dialogue', 'Parenthetical', 'Comment') THEN '' ELSE chr(10) END) || u || chr(10), '' ORDER BY elem_idx) AS body FROM w3 GROUP BY script_id)"""
TITLE_TEXTS = f"""{TITLES},
named AS (SELECT script_id, string_agg(CASE WHEN len("values") = 1 THEN (CASE WHEN key = 'authors' THEN 'Author' ELSE upper(key[1]) || substr(key, 2) END) || ': ' || "values"[1] || chr(10)
  ELSE upper(key[1]) || substr(key, 2) || ':' || chr(10) || array_to_string([chr(9) || v || chr(10) FOR v IN "values"], '') END, '' ORDER BY entry_idx) AS title FROM titles GROUP BY script_id)"""
