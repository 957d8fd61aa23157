"""Quality rules on repetition: what share of a text's characters lies in n-grams and lines that it has had before.

Every text is taken whole. Word hashes come from prefix sums over its bytes, n-gram hashes of several lengths roll over
these, and equal hashes of one text are found by sorting. A null text counts as empty; a text without words fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import covered, flat, gram_hashes, mix64, slices, span_hashes, table, words

SYMBOLS = b"#*$%&|<>"
BASE_GRAM = 5
#: n-gram length: percentage of word characters that may lie in n-grams had before.
GRAM_LIMITS = {5: 15, 6: 14, 8: 12, 10: 10}
#: Percentage of word characters that may lie in lines had before.
LINE_LIMIT = 30
MIN_WORDS, MAX_REPEAT = 10, 20

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}gram_chars" for n in GRAM_LIMITS)]
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order[1:]] == keys[order[:-1]]
    again, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return again, before


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The COLUMNS of texts laid out in data, each ending at its offset."""
    starts, ends, rows = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    char = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=char[1:])
    size = char[ends] - char[starts]
    out = {"n_words": np.diff(rows), "word_chars": _sums(size, rows), "n_symbols": _sums(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), offsets)}

    salt = mix64(np.arange(len(offsets), dtype=np.uint64) + np.uint64(1 << 40))
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    stops = np.minimum(np.r_[begins[1:], len(data)], np.r_[breaks, len(data)][np.searchsorted(breaks, begins)])
    first_word = np.searchsorted(starts, begins)
    last_word = np.searchsorted(starts, stops)
    full = last_word > first_word
    begins, stops, first_word, last_word = begins[full], stops[full], first_word[full], last_word[full]
    line_row = row[first_word]
    _, before = _equal(span_hashes(data, begins, stops) ^ salt[line_row])
    chars = np.r_[0, np.cumsum(size)]
    out["n_dup_lines"] = np.bincount(line_row[before], minlength=len(offsets) - 1)
    out["dup_line_chars"] = np.bincount(line_row[before], (chars[last_word] - chars[first_word])[before], minlength=len(offsets) - 1).astype(np.int64)

    h = span_hashes(data, starts, ends)
    for n in sorted({BASE_GRAM, *GRAM_LIMITS}):
        at = np.flatnonzero(row[: max(0, len(row) - n + 1)] == row[n - 1 :])
        again, before = _equal(gram_hashes(h, n)[at] ^ salt[row[at]])
        if n == BASE_GRAM:
            out["n_repeat_words"] = _sums(covered(len(h), at[again], at[again] + n), rows)
        if n in GRAM_LIMITS:
            out[f"dup_{n}gram_chars"] = _sums(size * covered(len(h), at[before], at[before] + n), rows)
    return out


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails, and whether the text is kept."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
    bad = failed | (100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"])
    for n, limit in GRAM_LIMITS.items():
        bad |= 100 * m[f"dup_{n}gram_chars"] > limit * m["word_chars"]
    return failed, ~bad


def repetition(docs: DataFrame) -> DataFrame:
    """doc_id, COLUMNS, base_failed and kept of every row of docs; other columns are left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            m = measure(*flat(batch.column(1)))
            failed, kept = verdicts(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(kept)], names=["doc_id", *COLUMNS, "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def _gram_sql(n: int) -> str:
    return f"""
grams{n} AS (SELECT doc_id, i, array_to_string(ws[i : i + {n - 1}], ' ') AS g FROM w, unnest(range(1, len(ws) - {n - 2})) AS t(i)),
seen{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS r FROM grams{n}),
at{n} AS (SELECT doc_id, p, max(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS later FROM (SELECT doc_id, r, unnest(range(i, i + {n})) AS p FROM seen{n} WHERE c > 1) GROUP BY doc_id, p),
cover{n} AS (SELECT a.doc_id, count(*) AS n_all, sum(a.later * length(w.ws[a.p]))::BIGINT AS chars FROM at{n} a JOIN w USING (doc_id) GROUP BY a.doc_id)"""


OP2_SQL = (
    r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
line AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0),
lines AS (SELECT doc_id, count(*) AS n, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')))::BIGINT AS chars FROM line WHERE r > 1 GROUP BY doc_id),"""
    + ",".join(_gram_sql(n) for n in GRAM_LIMITS)
    + """, m AS (SELECT b.*, coalesce(l.n, 0) AS n_dup_lines, coalesce(l.chars, 0) AS dup_line_chars, coalesce(c5.n_all, 0) AS n_repeat_words, """
    + ", ".join(f"coalesce(c{n}.chars, 0) AS dup_{n}gram_chars" for n in GRAM_LIMITS)
    + " FROM base b LEFT JOIN lines l USING (doc_id) "
    + " ".join(f"LEFT JOIN cover{n} c{n} USING (doc_id)" for n in GRAM_LIMITS)
    + f""")
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words OR 100 * dup_line_chars > {LINE_LIMIT} * word_chars OR """
    + " OR ".join(f"100 * dup_{n}gram_chars > {limit} * word_chars" for n, limit in GRAM_LIMITS.items())
    + ") AS kept FROM m"
)
