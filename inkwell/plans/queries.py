"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import regex as rx
from inkwell.operators import fast, html, legacy, normalize, paginate, title_page, writer
from inkwell.operators.describe import described
from inkwell.plans import oracle as o
from inkwell.plans.corpus import CONVERSATION_SQL, DOCUMENT_SQL, conversation_scripts, document_scripts
from inkwell.plans.layout_sql import LAYOUT, html_sql
from inkwell.plans.legacy_sql import LEGACY, LEGACY_TITLES
from inkwell.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _with(chain: str, select: str, scripts: str = CONVERSATION_SQL) -> str:
    return f"WITH RECURSIVE {scripts},{chain}\n{select}"


@query("normalize_lines", _with(o.NORMAL, "SELECT script_id, line_no, line FROM lines"))
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.body_lines(conversation_scripts(spark, sf_dir))


@query("normalize_documents", _with(o.NORMAL, "SELECT script_id, line_no, line FROM lines", DOCUMENT_SQL))
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.body_lines(document_scripts(spark, sf_dir))


@query("line_states", _with(o.RULES, "SELECT script_id, line_no, in_comment, after_blank, in_dialogue FROM rules"))
def line_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast.classified(conversation_scripts(spark, sf_dir)).select("script_id", "line_no", "in_comment", "after_blank", "in_dialogue")


@query("classify_fast", _with(o.RULES, "SELECT script_id, line_no, line, rule FROM rules"))
def classify_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast.classified(conversation_scripts(spark, sf_dir)).select("script_id", "line_no", "line", "rule")


@query("elements_fast", _with(o.ELEMENTS, "SELECT * FROM elements"))
def elements_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast.elements(conversation_scripts(spark, sf_dir))


@query("elements_documents", _with(o.ELEMENTS, "SELECT * FROM elements", DOCUMENT_SQL))
def elements_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast.elements(document_scripts(spark, sf_dir))


@query("element_type_counts", _with(o.ELEMENTS, "SELECT element_type, count(*) AS n FROM elements GROUP BY element_type"))
def element_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_fast(spark, sf_dir).groupBy("element_type").agg(F.count("*").alias("n"))


@query("scene_numbers", _with(o.ELEMENTS, "SELECT script_id, elem_idx, scene_number, element_text FROM elements WHERE scene_number IS NOT NULL"))
def scene_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_fast(spark, sf_dir).where("scene_number is not null").select("script_id", "elem_idx", "scene_number", "element_text")


@query("sections", _with(o.ELEMENTS, "SELECT script_id, elem_idx, section_depth, element_text FROM elements WHERE element_type = 'Section Heading'"))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_fast(spark, sf_dir).where("element_type = 'Section Heading'").select("script_id", "elem_idx", "section_depth", "element_text")


@query("dual_dialogue", _with(o.ELEMENTS, "SELECT script_id, elem_idx, element_text FROM elements WHERE is_dual_dialogue"))
def dual_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_fast(spark, sf_dir).where("is_dual_dialogue").select("script_id", "elem_idx", "element_text")


@query("describe_elements", _with(o.ELEMENTS, "SELECT script_id, elem_idx, element_type || CASE WHEN is_centered THEN ' (centered)' WHEN is_dual_dialogue THEN ' (dual dialogue)' WHEN section_depth > 0 THEN ' (' || section_depth || 'd)' ELSE '' END || ': ' || element_text AS description FROM elements"))
def describe_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(elements_fast(spark, sf_dir))


@query("title_page", _with(o.TITLES, 'SELECT script_id, entry_idx, key, len("values") AS n_values, array_to_string("values", \'|\') AS values_text FROM titles'))
def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_page.title_page(conversation_scripts(spark, sf_dir)).select("script_id", "entry_idx", "key", F.size("values").cast("long").alias("n_values"), F.array_join("values", "|").alias("values_text"))


@query("write_body", _with(o.BODIES, "SELECT * FROM written"))
def write_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.bodies(elements_fast(spark, sf_dir))


@query("write_title", _with(o.TITLE_TEXTS, "SELECT * FROM named"))
def write_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writer.title_texts(title_page.title_page(conversation_scripts(spark, sf_dir)))


_ENDS = r"^[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+$"


_WRITTEN = _with(o.BODIES + o.TITLE_TEXTS.removeprefix(o.NORMAL), f"SELECT script_id, regexp_replace(coalesce(title || chr(10), '') || coalesce(body, ''), '{_ENDS}', '', 'g') AS text FROM written FULL JOIN named USING (script_id)")


@query("write_document", _WRITTEN)
def write_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = conversation_scripts(spark, sf_dir)
    return writer.documents(fast.elements(scripts), title_page.title_page(scripts))


@query("round_trip", _with(o.ELEMENTS, "SELECT * FROM elements", f"scripts AS ({_WRITTEN})"))
def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of written documents, parsed again."""
    return fast.elements(write_document(spark, sf_dir))


@query("legacy_elements", _with(LEGACY, "SELECT * FROM old_elements"))
def legacy_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.elements(conversation_scripts(spark, sf_dir))


@query("legacy_title_page", _with(LEGACY_TITLES, "SELECT script_id, entry_idx, key, array_to_string(\"values\", '|') AS values_text FROM old_titles"))
def legacy_title_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legacy.title_page(conversation_scripts(spark, sf_dir)).select("script_id", "entry_idx", "key", F.array_join("values", "|").alias("values_text"))


@query("paginate", _with(LAYOUT, "SELECT * FROM laid_out"))
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate.paginate(elements_fast(spark, sf_dir))


@query("page_counts", _with(LAYOUT, "SELECT script_id, coalesce(max(page_idx) + 1, 0)::INT AS n_pages FROM scripts LEFT JOIN laid_out USING (script_id) GROUP BY script_id"))
def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate.page_counts(pages(spark, sf_dir), conversation_scripts(spark, sf_dir))


@query("first_pages", _with(LAYOUT, "SELECT * FROM laid_out WHERE page_idx = 0 AND element_type IS NOT NULL"))
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate.page_at(pages(spark, sf_dir), 0)


@query("html", _with(f"{LAYOUT}{o.TITLES.removeprefix(o.NORMAL)},{html_sql(html.DEFAULT_CSS)}", "SELECT * FROM rendered"))
def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = conversation_scripts(spark, sf_dir)
    return html.html(fast.elements(scripts), title_page.title_page(scripts))


_RE2_EMPHASIS = [(p.replace(r"(?<!\\)(\*{1})", r"(\*{1})"), t.replace("$2", r"\2")) for p, t in html.EMPHASIS]


def _emphasis_sql(column: str) -> str:
    for pattern, template in _RE2_EMPHASIS:
        column = f"regexp_replace({column}, '{pattern}', '{template}', 'g')"
    return column


@query("emphasis_html", f"SELECT doc_id, md5({_emphasis_sql('text')}) AS html_md5 FROM documents")
def emphasis_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emphasis over all documents. The SQL has no look-behind, which only texts with an escaped star would show."""
    return _documents(spark, sf_dir).select("doc_id", F.md5(html.emphasised(F.col("text")).cast("binary")).alias("html_md5"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/pages.parquet")


URL = r"^(https?)://([^/?#]+)(/[^?#]*)?"


@query("regex_is_matched", "SELECT doc_id, regexp_matches(text, '(?i)the [a-z]+ing') AS hit FROM documents")
def regex_is_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rx.is_matched(F.col("text"), "the [a-z]+ing", rx.CASELESS).alias("hit"))


@query("regex_matching", "SELECT doc_id, CASE WHEN regexp_matches(text, '([a-z]+)\\.\\n') THEN regexp_extract(text, '([a-z]+)\\.\\n', 1) END AS word FROM documents")
def regex_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rx.matching(F.col("text"), r"([a-z]+)\.\n", 1).alias("word"))


@query("regex_range", "SELECT doc_id, CASE WHEN hit <> '' THEN strpos(text, hit) - 1 END::INT AS location, CASE WHEN hit <> '' THEN length(hit) END::INT AS length FROM (SELECT doc_id, text, regexp_extract(text, '[A-Z][a-z]+\\.', 0) AS hit FROM documents)")
def regex_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rx.range_of(F.col("text"), r"[A-Z][a-z]+\.").alias("r")).select("doc_id", "r.location", "r.length")


@query("regex_replaced", "SELECT doc_id, md5(regexp_replace(text, '([aeiou])([a-z])', '\\2\\1', 'g')) AS text_md5 FROM documents")
def regex_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(rx.replaced(F.col("text"), "([aeiou])([a-z])", "$2$1").cast("binary")).alias("text_md5"))


@query("regex_components_matched", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z]\\w*')) AS n, array_to_string(regexp_extract_all(text, '[A-Z]\\w*'), ' ') AS words FROM documents")
def regex_components_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rx.components_matched(F.col("text"), r"[A-Z]\w*")
    return _documents(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("words"))


@query("regex_components_separated", "SELECT doc_id, len(string_split_regex(text, '[.,]\\s+')) AS n, md5(array_to_string(string_split_regex(text, '[.,]\\s+'), '|')) AS parts_md5 FROM documents")
def regex_components_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = rx.components_separated(F.col("text"), r"[.,]\s+")
    return _documents(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n"), F.md5(F.array_join(parts, "|").cast("binary")).alias("parts_md5"))


@query("regex_captures", f"SELECT page_id, CASE WHEN regexp_matches(url, '{URL}') THEN concat_ws('|', regexp_extract(url, '{URL}', 0), regexp_extract(url, '{URL}', 1), regexp_extract(url, '{URL}', 2), regexp_extract(url, '{URL}', 3)) ELSE '' END AS captures FROM pages WHERE url IS NOT NULL")
def regex_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).where("url is not null").select("page_id", F.array_join(rx.capture_components(F.col("url"), URL, 3), "|").alias("captures"))


@query("regex_dictionary", f"SELECT page_id, regexp_extract(url, '{URL}', 1) AS scheme, regexp_extract(url, '{URL}', 2) AS host FROM pages WHERE regexp_matches(url, '{URL}')")
def regex_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _urls(spark, sf_dir).select("page_id", rx.dictionary(F.col("url"), URL, {"scheme": 1, "host": 2}).alias("m")).where("m is not null")
    return found.select("page_id", F.col("m")["scheme"].alias("scheme"), F.col("m")["host"].alias("host"))


PARAMETER = r"[?&]([^=&#]+)=([^&#]*)"


@query("regex_dictionaries", f"SELECT page_id, unnest(regexp_extract_all(url, '{PARAMETER}', 1)) AS name, unnest(regexp_extract_all(url, '{PARAMETER}', 2)) AS value FROM pages")
def regex_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _urls(spark, sf_dir).select("page_id", F.explode(rx.array_of_dictionaries(F.col("url"), PARAMETER, {"name": 1, "value": 2})).alias("m"))
    return found.select("page_id", F.col("m")["name"].alias("name"), F.col("m")["value"].alias("value"))


@query("regex_array_of_captures", f"SELECT page_id, array_to_string([concat_ws('|', x[1], x[2], x[3]) FOR x IN list_zip(regexp_extract_all(url, '{PARAMETER}', 0), regexp_extract_all(url, '{PARAMETER}', 1), regexp_extract_all(url, '{PARAMETER}', 2))], ';') AS captures FROM pages")
def regex_array_of_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rx.array_of_captures(F.col("url"), PARAMETER, 2)
    return _urls(spark, sf_dir).select("page_id", F.array_join(F.transform(found, lambda c: F.array_join(c, "|")), ";").alias("captures"))


@query("regex_enumerated", "SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS found FROM documents")
def regex_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rx.enumerated(F.col("text"), "[0-9]+").alias("found"))


@query("regex_enumerated_between", "SELECT doc_id, unnest(string_split_regex(text, '\\n+')) AS part FROM documents")
def regex_enumerated_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", rx.enumerated_between(F.col("text"), r"\n+").alias("part"))


@query("characters_speaking", _with(o.ELEMENTS, "SELECT element_text AS cue, count(*) AS n_speeches, count(DISTINCT script_id) AS n_scripts FROM elements WHERE element_type = 'Character' GROUP BY element_text"))
def characters_speaking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches of each cue over the corpus: an extension of the inventory."""
    cues = elements_fast(spark, sf_dir).where("element_type = 'Character'")
    return cues.groupBy(F.col("element_text").alias("cue")).agg(F.count("*").alias("n_speeches"), F.countDistinct("script_id").alias("n_scripts"))
