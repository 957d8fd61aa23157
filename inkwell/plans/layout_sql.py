"""Page layout and page HTML in plain SQL, to hold results against: a recursive query that places one block a step.

It knows greedy wrapping of words between single spaces, which is all that the driver's tables ask for."""

from __future__ import annotations

from inkwell.plans.oracle import ELEMENTS

# Fixed values of the layout: columns of text and lines before an element.
_COLS = "CASE WHEN element_type IN ('Action', 'General', 'Scene Heading', 'Transition') THEN 59 WHEN element_type IN ('Character', 'Dialogue') THEN 34 WHEN element_type = 'Parenthetical' THEN 29 ELSE 0 END"
_LEAD = "CASE WHEN element_type = 'Scene Heading' THEN 24 WHEN element_type IN ('Action', 'General', 'Character', 'Transition') THEN 12 ELSE 0 END"
# End of fixed values.


def _height(text: str, cols: str) -> str:
    """Lines are counted word by word: a state is 100,000 times the lines that are full, plus what the last one holds."""
    fill = f"greatest(0, {cols} - acc % 100000 - 1)"
    word = f"""CASE WHEN acc % 100000 + (acc % 100000 > 0)::INT + x <= {cols} THEN acc + x + (acc % 100000 > 0)::INT
      WHEN x <= {cols} THEN (acc // 100000 + 1) * 100000 + x
      WHEN acc % 100000 = 0 THEN (acc // 100000 + (x - 1) // {cols}) * 100000 + (x - 1) % {cols} + 1
      ELSE (acc // 100000 + 1 + (x - {fill} - 1) // {cols}) * 100000 + (x - {fill} - 1) % {cols} + 1 END"""
    part = f"list_reduce([length(w) FOR w IN string_split(l, ' ') IF w <> ''], lambda acc, x: {word}, 0::BIGINT) // 100000 + 1"
    return f"""(CASE WHEN coalesce({text}, '') = '' THEN 0 WHEN {cols} = 0 THEN 12 * len(string_split({text}, chr(10)))
      ELSE 12 * list_sum([{part} FOR l IN string_split({text}, chr(10))]) END)::INT"""


def _made(kind: str, text: str, cols: int) -> str:
    return f"""{{'elem_idx': NULL::INT, 'element_type': '{kind}', 'element_text': {text}, 'is_centered': false, 'scene_number': NULL::VARCHAR, 'is_dual_dialogue': false, 'section_depth': 0::INT,
      'cols': {cols}::INT, 'h': {_height(text, str(cols))}, 'hc': 0::INT, 'lead': {12 if kind == "Character" else 0}::INT, 'stop': 0::INT}}"""


_FIELDS = ["elem_idx", "element_type", "element_text", "is_centered", "scene_number", "is_dual_dialogue", "section_depth"]
_SPOKEN = "('Dialogue', 'Parenthetical')"
_SUM = "coalesce(list_sum([x.h FOR x IN {}]), 0)::INT"
LAYOUT = f"""{ELEMENTS},
l1 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY script_id) AS n, {_COLS} AS cols, {_LEAD} AS lead FROM elements WINDOW w AS (PARTITION BY script_id ORDER BY elem_idx)),
l2 AS (SELECT *, {_height("element_text", "cols")} AS h, {_height("element_text", "34")} AS hc,
  coalesce(min(CASE WHEN element_type NOT IN {_SPOKEN} THEN i END) OVER (PARTITION BY script_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n + 1) AS stop FROM l1),
packed AS (SELECT script_id, count(*)::INT AS n, list({{{", ".join(f"'{f}': {f}" for f in _FIELDS)}, 'cols': cols::INT, 'h': h, 'hc': hc, 'lead': lead::INT, 'stop': stop::INT}} ORDER BY i) AS es FROM l2 GROUP BY script_id),
steps AS (SELECT script_id, 0 AS step, 1 AS k, 0 AS was, es[1:0] AS before, es[1:0] AS after, 0 AS page, 0 AS y, false AS filled, es[1:0] AS held, 0 AS tall, -1 AS dual FROM packed
 UNION ALL SELECT script_id, step + 1, k2, page, CASE WHEN mode IN ('break', 'fit', 'stay') THEN held1 WHEN mode = 'paren' THEN list_append(held1[1:spot], more) WHEN mode = 'split' AND begun <> '' THEN held1[1:spot] || [{_made("Dialogue", "begun", 34)}, more] ELSE es[1:0] END,
  CASE WHEN mode = 'turn' THEN held1 WHEN mode IN ('paren', 'split') THEN tail0 || tail ELSE es[1:0] END,
  page + (mode IN ('break', 'turn', 'paren', 'split', 'wait'))::INT,
  CASE mode WHEN 'break' THEN 0 WHEN 'fit' THEN y + t3 WHEN 'turn' THEN t3 - e.lead WHEN 'wait' THEN t3 - e.lead WHEN 'paren' THEN {_SUM.format("tail")} WHEN 'split' THEN {_SUM.format("tail")} ELSE y END,
  CASE WHEN mode IN ('break', 'wait') THEN false WHEN mode = 'skip' THEN filled ELSE true END,
  CASE WHEN mode IN ('skip', 'wait') THEN held1 ELSE es[1:0] END, CASE WHEN mode IN ('skip', 'break') THEN t1 ELSE 0 END, dual2
 FROM (SELECT *, CASE WHEN mode = 'paren' THEN list_prepend({{**}}, held1[spot + 1:]) WHEN mode = 'split' THEN [{_made("Character", "held1[1].element_text", 34)}, {_made("Dialogue", "others", 34)}] || held1[spot + 2:] ELSE es[1:0] END AS tail,
   CASE WHEN mode = 'split' AND begun = '' THEN held1[2:spot] ELSE es[1:0] END AS tail0, {_made("Character", "'(MORE)'", 34)} AS more
 FROM (SELECT *, array_to_string(parts[1:fits], '') AS begun, array_to_string(parts[greatest(0, CASE WHEN high0 >= free THEN -1 ELSE least(fits, len(parts) - 1) END) + 1:], '') AS others
 FROM (SELECT *, CASE WHEN high0 >= free THEN 0 ELSE len([j FOR j IN range(1, len(parts) + 1) IF {_height("array_to_string(parts[1:j], '')", "held1[spot + 1].cols")} < free]) END AS fits
 FROM (SELECT *, 647 - y - 24 AS free, CASE WHEN spot IS NULL THEN NULL ELSE coalesce(list_sum([x.lead // 12 + x.h FOR x IN held1[1:spot]]), 0) END AS high0,
   CASE WHEN spot IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(held1[spot + 1].element_text, '.+?[.?!]+[\\s]*') END AS parts,
   CASE WHEN NOT places THEN (CASE WHEN brk THEN 'break' ELSE 'skip' END) WHEN over <= 0 THEN 'fit' WHEN spot IS NULL OR spot = 0 THEN 'turn'
     WHEN held1[spot + 1].element_type = 'Parenthetical' THEN CASE WHEN spot > 1 THEN 'paren' ELSE 'stay' END WHEN 647 - y - 24 < 60 THEN 'wait' ELSE 'split' END AS mode
 FROM (SELECT *, CASE WHEN places AND over >= 48 AND held1[1].element_type = 'Character' THEN least(len(held1) - 1, len([j FOR j IN range(1, len(held1) + 1) IF list_sum([x.h + x.lead FOR x IN held1[1:j]]) < over])) END AS spot
 FROM (SELECT *, t3 + y - 647 AS over
 FROM (SELECT *, NOT (brk OR zero OR head) AS places, CASE WHEN pair AND dual >= 0 THEN abs(dual - t2) ELSE t2 END AS t3, CASE WHEN pair THEN CASE WHEN dual < 0 THEN t2 ELSE -1 END ELSE dual END AS dual2
 FROM (SELECT *, cue AND e.is_dual_dialogue AS pair, CASE WHEN cue THEN e.stop ELSE k + 1 END AS k2, (t1 + CASE WHEN cue THEN coalesce(list_sum([x.hc FOR x IN es[k + 1:e.stop - 1]]), 0) ELSE 0 END)::INT AS t2,
   CASE WHEN zero THEN held WHEN cue THEN held || es[k:e.stop - 1] WHEN head AND es[k + 1].h >= 12 AND t1 + y + es[k + 1].h >= 647 THEN held || [{_made("Page Break", "''", 0)}, e] ELSE list_append(held, e) END AS held1
 FROM (SELECT *, NOT brk AND e.h <= 0 AS zero, NOT brk AND e.h > 0 AND k < n AND e.element_type = 'Scene Heading' AS head, NOT brk AND e.h > 0 AND k < n AND e.element_type = 'Character' AS cue,
   tall + CASE WHEN brk OR e.h <= 0 THEN 0 ELSE e.h + CASE WHEN filled THEN e.lead ELSE 0 END END AS t1
 FROM (SELECT s.*, p.es, p.n, p.es[k] AS e, p.es[k].element_type = 'Page Break' AS brk FROM steps s JOIN packed p USING (script_id) WHERE k <= n))))))))))),
placed AS (SELECT script_id, step, 0 AS part, was AS page_idx, unnest(before) AS e, unnest(range(len(before))) AS j FROM steps
 UNION ALL SELECT script_id, step, 1, page, unnest(after), unnest(range(len(after))) FROM steps
 UNION ALL SELECT script_id, step, 2, page, unnest(held), unnest(range(len(held))) FROM steps JOIN packed USING (script_id) WHERE k > n),
turned AS (SELECT script_id, unnest(range(max(page))) AS page_idx FROM steps GROUP BY script_id),
laid_out AS (SELECT script_id, page_idx::INT AS page_idx, (row_number() OVER (PARTITION BY script_id, page_idx ORDER BY step, part, j) - 1)::INT AS pos_in_page, {", ".join(f"e.{f} AS {f}" for f in _FIELDS)} FROM placed
 UNION ALL SELECT script_id, page_idx::INT, 0, {", ".join("NULL" for _ in _FIELDS)} FROM turned ANTI JOIN placed USING (script_id, page_idx))"""
_CONTINUED = "{" + ", ".join(f"'{f}': " + ("held1[1].element_text || ' (CONT''D)'" if f == "element_text" else _height("held1[1].element_text || ' (CONT''D)'", "34") if f == "h" else f"held1[1].{f}") for f in [*_FIELDS, "cols", "h", "hc", "lead", "stop"]) + "}"
LAYOUT = LAYOUT.replace("{**}", _CONTINUED)

# Emphasis marks and their tags, in order; RE2 has no look-behind for an escaped star.
_EMPHASIS = [
    (r"(_\*{3}|\*{3}_)([^<>]+)(_\*{3}|\*{3}_)", r"<strong><em><u>\2</strong></em></u>"),
    (r"(\*{3})([^<>]+)(\*{3})", r"<strong><em>\2</strong></em>"),
    (r"(_\*{2}|\*{2}_)([^<>]+)(_\*{2}|\*{2}_)", r"<strong><u>\2</u></strong>"),
    (r"(_\*{1}|\*{1}_)([^<>]+)(_\*{1}|\*{1}_)", r"<em><u>\2</em></u>"),
    (r"(\*{2})([^<>]+)(\*{2})", r"<strong>\2</strong>"),
    (r"(\*{1})([^<>]+)(\*{1})", r"<em>\2</em>"),
    (r"(_)([^<>_]+)(_)", r"<u>\2</u>"),
    (r"\[{2}(.*?)\]{2}", ""),
]
# End of fixed values.


def _shown(text: str) -> str:
    for pattern, tags in _EMPHASIS:
        text = f"regexp_replace({text}, '{pattern}', '{tags}', 'g')"
    return text


def _lines(key: str) -> str:
    return f"array_to_string([v || '<br>' FOR v IN {key}], '')"


def html_sql(css: str) -> str:
    """The documents of scripts with pages or titles; titles must be among the tables before."""
    entry = lambda key: f"max_by(\"values\", entry_idx) FILTER (key = '{key}')"
    block = lambda name, key, default: f"'<p class=''{name}''>' || CASE WHEN {key} IS NULL THEN '{default}' ELSE {_lines(key)} END || '</p>'"
    optional = " || ".join(f"CASE WHEN {key} IS NULL THEN '' ELSE '<p class=''{name}''>' || {_lines(key)} || '</p>' END" for name, key in (("source", "origin"), ("draft date", "draft"), ("contact", "contact")))
    return f"""
h0 AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY page_idx, pos_in_page) AS r, coalesce(element_type, 'Page Break') IN ('Page Break', 'Boneyard', 'Comment', 'Synopsis', 'Section Heading') AS skipped FROM laid_out),
h1 AS (SELECT DISTINCT script_id, 0::BIGINT AS r, 0 AS cues, 0 AS opened, false AS closes FROM laid_out
 UNION ALL SELECT script_id, r, CASE WHEN ends THEN 0 ELSE c END, CASE WHEN starts AND c <= 2 THEN c ELSE 0 END, ends
 FROM (SELECT *, NOT skipped AND c >= 2 AND element_type NOT IN ('Character', 'Dialogue', 'Parenthetical') AS ends
 FROM (SELECT x.script_id, x.r, x.element_type, x.skipped, NOT x.skipped AND x.element_type = 'Character' AND x.is_dual_dialogue AS starts, p.cues + (NOT x.skipped AND x.element_type = 'Character' AND x.is_dual_dialogue)::INT AS c
 FROM h1 p JOIN h0 x ON x.script_id = p.script_id AND x.r = p.r + 1))),
h2 AS (SELECT *, {_shown("""regexp_replace(CASE WHEN element_type = 'Scene Heading' AND scene_number IS NOT NULL THEN '<span class=''scene-number-left''>' || scene_number || '</span>' || element_text || '<span class=''scene-number-right''>' || scene_number || '</span>'
   WHEN element_type = 'Character' AND is_dual_dialogue THEN replace(element_text, '^', '') ELSE element_text END, CASE element_type WHEN 'Character' THEN '^@' WHEN 'Scene Heading' THEN '^\\.' WHEN 'Lyrics' THEN '^~' WHEN 'Action' THEN '^!' ELSE '^$' END, '')""")} AS t FROM h0 JOIN h1 USING (script_id, r)),
h3 AS (SELECT script_id, string_agg((CASE WHEN pos_in_page = 0 THEN '<p class=''page-break''>' || (page_idx + 1) || '.</p>' || chr(10) ELSE '' END)
  || CASE WHEN element_type IS NULL THEN '' WHEN element_type = 'Page Break' THEN '</section>' || chr(10) || '<section>' || chr(10) WHEN skipped THEN ''
     ELSE (CASE opened WHEN 1 THEN '<div class=''dual-dialogue''>' || chr(10) || '<div class=''dual-dialogue-left''>' || chr(10) WHEN 2 THEN '</div>' || chr(10) || '<div class=''dual-dialogue-right''>' || chr(10) ELSE '' END)
       || (CASE WHEN closes THEN '</div>' || chr(10) || '</div>' || chr(10) ELSE '' END)
       || CASE WHEN t <> '' THEN '<p class=''' || replace(lower(element_type), ' ', '-') || (CASE WHEN is_centered THEN ' center' ELSE '' END) || '''>' || t || '</p>' || chr(10) ELSE '' END END, '' ORDER BY r) AS pages FROM h2 GROUP BY script_id),
k1 AS (SELECT script_id, {entry("title")} AS title, {entry("credit")} AS credit, {entry("authors")} AS people, {entry("source")} AS origin, {entry("draft date")} AS draft, {entry("contact")} AS contact FROM titles GROUP BY script_id),
k2 AS (SELECT script_id, '<div id=''script-title''>' || {block("title", "title", "Untitled")} || (CASE WHEN credit IS NULL AND people IS NULL THEN '' ELSE {block("credit", "credit", "written by")} || {block("authors", "people", "Anonymous")} END) || {optional} || '</div>' AS title_html FROM k1),
rendered AS (SELECT script_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<style type=''text/css''>' || chr(10) || '{css.replace("'", "''")}' || '</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<article>' || chr(10) || '<section>' || chr(10)
  || coalesce(title_html, '') || coalesce(pages, '') || '</section>' || chr(10) || '</article>' || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM h3 FULL JOIN k2 USING (script_id))"""
