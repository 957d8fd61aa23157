"""The older parser in plain SQL, to hold results against.

RE2 has no look-around. Where a pattern looks at line ends that it doesn't consume, these carry marks: behind each stands \\x01,
or \\x02 if another follows, for looking ahead, and then \\x03 for looking behind; \\x04 stands where a speech may end."""

from __future__ import annotations

from inkwell.plans.corpus import quoted

# The patterns and templates of the markup, in order, with marks for look-around.
_LEGACY = [
    ("", r"\r\n|\r|\n", "\n"),
    ("", r"\n/\*([^<>]+?)\*/\n", "\n<Boneyard>\\1</Boneyard>\n"),
    ("", r"\n\[{2}([^<>]+?)\]{2}\n", "\n<Comment>\\1</Comment>\n"),
    ("", r"\n={1}([^<>=][^<>]+?)\n", "\n<Synopsis>\\1</Synopsis>\n"),
    ("lines", r"\x03([\s\x01-\x03]*[=\-_]{3,8}[\s\x01-\x03]*)\n", "\n<Page Break></Page Break>\n"),
    ("", r"\n((&gt;|>)\s*[^<>\n]+(&lt;\s*))\n", "\n<Action>\\1</Action>"),
    ("", r"\n((&gt;|>)\s*[^<>\n]+)\n", "\n<Transition>\\1</Transition>"),
    ("lines", r"\x03(([iI][nN][tT]|[eE][xX][tT]|(?:\n[\x01\x02]\x03|[^\pL\pN_\n\x01-\x03])[eE][sS][tT]|\.|[iI]\.?/[eE]\.?)([^\n\x01-\x03]+))\n", "\n<Scene Heading>\\1</Scene Heading>"),
    ("", r"^\n\n([^<>\n#]*?)\n", "<Action>\\1</Action>\n"),
    ("", r"\n([\*_]*([^<>\na-z]*TO:|FADE TO BLACK\.|FADE OUT\.|CUT TO BLACK\.)[\*_]*)\n", "\n<Transition>\\1</Transition>"),
    ("lines", r"\x03([ \t]*[^<>a-z\s/\x01-\x03][^<>a-z:!\?\n\x01-\x03]*[^<>a-z\(!\?:,\n\.\x01-\x03][ \t]?)\n\x01", "<Character>\\1</Character>"),
    ("", r"(\([^<>]*?\)[\s]?)\n", "<Parenthetical>\\1</Parenthetical>"),
    ("speech", r"(<(Character|Parenthetical)>[^<>\n]+</(Character|Parenthetical)>)([^<>\x04]*)\x04", "\\1<Dialogue>\\4</Dialogue>"),
    ("", r"((#+)(\s*[^\n]*))\n?", "<Section Heading>\\1</Section Heading>"),
    ("", r"([^<>]*?)(\n{2}|\n<)", "<Action>\\1</Action>\\2"),
    ("", r"<Action>\s*</Action>", ""),
    ("", "@@@@@", "\n"),
]
_TITLE = r"^([^\n]+:(([ \t]*|\n)[^\n]+\n)+)+\n"
_INLINE = r"^([\w\s&]+):\s*([^\s][\w&,\.\?!:\(\)/\s\-©\*_]+)$"
_DIRECTIVE = r"^([\w\s&]+):\s*$"
_DATA = r"^([ ]{2,8}|\t)([^<>]+)$"
_NUMBER = r"(?i)(#([0-9A-Za-z\.\)-]+)#)"
_SECTION = r"((#+)(\s*[^\n]*))\n?"
_TAG = r"<([a-zA-Z\s]+)>([^<>]*)</[a-zA-Z\s]+>"
_ENDS = r"^[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+$"
# End of fixed values.


def _rewritten() -> str:
    """One table a rewrite."""
    out, last = [], "safe"
    for k, (marks, pattern, template) in enumerate(_LEGACY):
        text = "body"
        if marks == "lines":
            text = "replace(replace(body, '\n', '\n\x01\x03'), '\x01\x03\n', '\x02\x03\n')"
        elif marks == "speech":
            text = "replace(replace(body, '\n\n', '\x04\n\n'), '\n<Parenthetical>', '\x04\n<Parenthetical>')"
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(template)}, 'g')"
        if marks:
            text = f"regexp_replace({text}, '[\\x01-\\x04]', '', 'g')"
        out.append(f"r{k} AS (SELECT script_id, {text} AS body FROM {last})")
        last = f"r{k}"
    return ",\n".join(out) + f",\nrewritten AS (SELECT * FROM {last})"


def _protected(column: str, pattern: str) -> str:
    return f"list_reduce(regexp_extract_all({column}, {quoted(pattern)}, 1), lambda text, found: replace(text, found, replace(found, '\n', '@@@@@')), {column})"


_SPLIT = f"""
led AS (SELECT script_id, regexp_replace(text, '^\\n+', '') AS text FROM scripts WHERE text IS NOT NULL),
topped AS (SELECT *, string_split(text, '\n\n')[1] AS top, contains(text, '\n\n') AND regexp_matches(string_split(text, '\n\n')[1] || '\n\n', {quoted(_TITLE)}) AS titled FROM led)"""
LEGACY = f"""{_SPLIT},
b0 AS (SELECT script_id, '\n\n' || CASE WHEN titled THEN substr(text, length(top) + 2) ELSE text END || '\n\n' AS body FROM topped),
b1 AS (SELECT script_id, {_protected("body", _LEGACY[1][1])} AS body FROM b0),
b2 AS (SELECT script_id, {_protected("body", _LEGACY[2][1])} AS body FROM b1),
safe AS (SELECT script_id, replace(replace(replace(body, '<', '&lt;'), '>', '&gt;'), '...', '::trip::') AS body FROM b2),
{_rewritten()},
x1 AS (SELECT script_id, unnest(range(len(kinds)))::INT AS elem_idx, unnest(kinds) AS element_type, unnest(texts) AS tag FROM (SELECT script_id, regexp_extract_all(body, {quoted(_TAG)}, 1) AS kinds, regexp_extract_all(body, {quoted(_TAG)}, 2) AS texts FROM rewritten)),
x2 AS (SELECT *, replace(replace(replace(tag, '&lt;', '<'), '&gt;', '>'), '::trip::', '...') AS t FROM x1),
x3 AS (SELECT *, CASE WHEN element_type = 'Scene Heading' AND regexp_matches(t, {quoted(_NUMBER)}) THEN regexp_extract(t, {quoted(_NUMBER)}, 2) END AS scene_number FROM x2),
x4 AS (SELECT * REPLACE (regexp_replace(CASE WHEN scene_number IS NOT NULL THEN replace(t, regexp_extract(t, {quoted(_NUMBER)}, 1), '') ELSE t END, {quoted(_ENDS)}, '', 'g') AS t) FROM x3),
x5 AS (SELECT *, regexp_matches(t, '^>[^<>\\n]+<') AS is_centered FROM x4),
x6 AS (SELECT * REPLACE (CASE WHEN is_centered THEN regexp_replace(regexp_extract(t, '(>?)\\s*([^<>\\n]*)\\s*(<?)', 2), '^[\\t\\p{{Zs}}]+|[\\t\\p{{Zs}}]+$', '', 'g') ELSE t END AS t) FROM x5),
x7 AS (SELECT * REPLACE (CASE element_type WHEN 'Scene Heading' THEN regexp_extract(t, '^\\.?(.+)', 1) WHEN 'Section Heading' THEN regexp_extract(t, {quoted(_SECTION)}, 3) ELSE t END AS t),
  (CASE WHEN element_type = 'Section Heading' THEN length(regexp_extract(t, {quoted(_SECTION)}, 2)) ELSE 0 END)::INT AS section_depth FROM x6),
x8 AS (SELECT *, element_type = 'Character' AND elem_idx > 1 AND regexp_matches(t, '\\^\\s*$') AS caret, element_type IN ('Dialogue', 'Parenthetical') AS in_run FROM x7),
x9 AS (SELECT *, element_type = 'Character' AND coalesce(lead(caret) OVER (PARTITION BY script_id, in_run ORDER BY elem_idx), false) AS partner FROM x8),
x10 AS (SELECT * REPLACE (CASE WHEN caret THEN regexp_replace(t, '\\s*\\^$', '') ELSE t END AS t) FROM x9),
old_elements AS (SELECT script_id, elem_idx, element_type, CASE WHEN partner THEN replace(t, '^', '') ELSE t END AS element_text, is_centered, scene_number, caret OR partner AS is_dual_dialogue, section_depth FROM x10)"""
LEGACY_TITLES = f"""{_SPLIT},
y1 AS (SELECT script_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT script_id, string_split(regexp_replace(top, '^\\n+|\\n+$', '', 'g'), '\n') AS ls FROM topped WHERE titled)),
y2 AS (SELECT *, regexp_matches(line, {quoted(_INLINE)}) AS inline, NOT regexp_matches(line, {quoted(_INLINE)}) AND regexp_matches(line, {quoted(_DIRECTIVE)}) AS directive FROM y1),
y3 AS (SELECT *, sum((inline OR directive)::INT) OVER (PARTITION BY script_id ORDER BY line_no) AS entry, CASE WHEN inline THEN regexp_extract(line, {quoted(_INLINE)}, 2) WHEN NOT directive AND regexp_matches(line, {quoted(_DATA)}) THEN regexp_extract(line, {quoted(_DATA)}, 2) END AS value FROM y2),
y4 AS (SELECT script_id, entry, lower(max(CASE WHEN inline OR directive THEN regexp_extract(line, '^([^:]+):', 1) END)) AS name, bool_or(inline) AS one, list(value ORDER BY line_no) FILTER (value IS NOT NULL) AS all_values, list(value ORDER BY line_no) FILTER (inline) AS own FROM y3 WHERE entry > 0 GROUP BY script_id, entry),
y5 AS (SELECT script_id, entry, CASE WHEN name IN ('author', 'author(s)') THEN 'authors' ELSE name END AS key, CASE WHEN one THEN own ELSE all_values END AS "values" FROM y4),
old_titles AS (SELECT script_id, (row_number() OVER (PARTITION BY script_id ORDER BY entry) - 1)::INT AS entry_idx, key, "values" FROM y5 WHERE len("values") > 0)"""
