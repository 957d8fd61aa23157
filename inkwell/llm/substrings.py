"""Exact substring de-duplication over bytes and over words.

op5: every byte of a 50-byte string goes that also starts in a document with a smaller id. op10: every word of a 35-word
window goes whose words also start anywhere else. Both judge the texts as they came in. cut_repeats, for a corpus that is to
lose no passage, leaves each in the document with the smallest id.

Null texts are empty (cut_repeats leaves them null), null ids come after all others; texts shorter than a window lose nothing,
and an empty table gives an empty one. Rows that repeat an id are documents of their own for op10; for op5 and cut_repeats
neither has a smaller id, so that both keep what only they share. A text is held whole by one task, with some 15 bytes for
each of its bytes; it is hashed block by block. Columns of any name but doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import flat, table
from inkwell.llm.repeats import Crate, Shape, with_repeats

BYTES, WORDS = 50, 35


def _hex(parts: list[bytes], between: bytes) -> str:
    return hashlib.sha256(between.join(parts)).hexdigest()


def byte_digests(batch: pa.RecordBatch, crate: Crate, gone: np.ndarray) -> pa.RecordBatch:
    data, offsets = flat(pc.fill_null(batch["text"], ""))
    total = np.r_[0, np.cumsum(gone)]
    begins = gone & ~np.r_[False, gone[:-1]]
    begins[offsets[:-1][offsets[:-1] < len(gone)]] = gone[offsets[:-1][offsets[:-1] < len(gone)]]
    spans = np.r_[0, np.cumsum(begins)]
    kept = [_hex([data[a:b][~gone[a:b]].tobytes()], b"") for a, b in zip(offsets[:-1], offsets[1:])]
    columns = [batch["doc_id"], pa.array(np.diff(offsets)), pa.array(total[offsets[1:]] - total[offsets[:-1]]), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_words(batch: pa.RecordBatch, crate: Crate, gone: np.ndarray) -> list[list[bytes]]:
    """The words of each text that stay."""
    out = []
    for text, a, b in zip(batch["text"].to_pylist(), crate.offsets[:-1], crate.offsets[1:]):
        found = (text or "").encode().split()  # at the six ASCII spaces
        out.append([w for w, x in zip(found, gone[a:b].tolist()) if not x] if gone[a:b].any() else found)
    return out


def word_digests(batch: pa.RecordBatch, crate: Crate, gone: np.ndarray) -> pa.RecordBatch:
    total = np.r_[0, np.cumsum(gone)]
    at = crate.offsets
    columns = [batch["doc_id"], pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), pa.array([_hex(x, b" ") for x in kept_words(batch, crate, gone)], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def byte_dedup(docs: DataFrame, n: int = BYTES) -> DataFrame:
    return with_repeats(docs.select("doc_id", "text"), Shape(n, max(1, n * 2 // 5), False, True), byte_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def word_dedup(docs: DataFrame, n: int = WORDS) -> DataFrame:
    return with_repeats(docs.select("doc_id", "text"), Shape(n, max(1, n // 2), True, False), word_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """docs with all their columns, windows of n words cut from text that also stand in a document with a smaller id; a text
    that loses none stays as it is. n_chars, where there is such a column, is that of the text that is left."""
    names = docs.columns

    def make(batch: pa.RecordBatch, crate: Crate, gone: np.ndarray) -> pa.RecordBatch:
        loses = [bool(gone[a:b].any()) for a, b in zip(crate.offsets[:-1], crate.offsets[1:])]
        if not any(loses):
            return batch
        texts = [b" ".join(ws).decode() if lost else text for ws, lost, text in zip(kept_words(batch, crate, gone), loses, batch["text"].to_pylist())]
        batch = batch.set_column(names.index("text"), "text", pa.array(texts, batch["text"].type))
        if "n_chars" in names:
            sizes = [len(x) if lost else old for x, lost, old in zip(texts, loses, batch["n_chars"].to_pylist())]
            batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(sizes, batch["n_chars"].type))
        return batch

    return with_repeats(docs, Shape(n, max(1, n // 2), True, True), make, docs.schema)


def op5_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(table(spark, sf_dir, "documents"))


def op10_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM h, unnest(range(0, length(h) // 2 - 49)) AS t(i)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE least < doc_id),
marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS begins FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cuts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS rest, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256 FROM h LEFT JOIN cuts USING (doc_id)"""
OP10_SQL = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
hits AS (SELECT doc_id, i FROM windows JOIN (SELECT g FROM windows GROUP BY g HAVING count(*) > 1) USING (g)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hits),
places AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
