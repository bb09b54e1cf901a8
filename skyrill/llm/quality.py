"""Quality rules: line-first cleaning.

Every line of a text is judged alone by three groups of rules; failing lines
are removed, and a document that loses more than ``max_lost`` of its word
characters is rejected. Before that a base test rejects documents that are too
short or that repeat themselves.

* punctuation: the line ends in a mark of ``TERMINAL``; it holds fewer than
  three doubled exclamation marks and at most one symbol of ``SYMBOLS`` for
  ten word characters;
* navigation: fewer than three vertical bars or guillemets that separate items;
* boilerplate: no phrase of ``BOILERPLATE``.

Defined results: a null or empty text has zero counts, fails the base test and
is not kept; a text of any length is judged whole; blank lines are no loss; repeated rows give repeated results; an
empty table gives an empty table; columns beyond ``id_col`` and ``text_col``
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import table

SYMBOLS = "#*$%&|<>"
TERMINAL = ".!?\"'…:;)"
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "sign up",
    "subscribe to our",
)
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50

_SPACE = "\x20\x09-\x0d"
_BAD_LINE = regex.compile(
    rf"(?:!!.*){{3}}|(?:[|»›](?:.*)){{3}}|{'|'.join(BOILERPLATE)}|[^{regex.escape(TERMINAL)}]\Z",
    regex.IGNORECASE | regex.DOTALL,
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_bad_lines long, lost_chars long"


def line_fails(line: str) -> bool:
    """Whether a line (without blanks at its ends, not empty) breaks a punctuation, navigation or boilerplate rule."""
    if _BAD_LINE.search(line):
        return True
    symbols = sum(map(line.count, SYMBOLS))
    return bool(symbols) and symbols * 10 > sum(not (c in " \t\n\x0b\x0c\r") for c in line)


def repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per document, the words inside windows of ``width`` words that occur twice or more in it."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    windows = flat.window_hash(h, width)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    keyed = flat.mix(windows[whole] ^ flat.mix(doc[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    same = np.zeros(len(ranked), bool)
    if len(ranked):
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    edge = np.zeros(len(h) + 1, np.int32)
    at = whole[order[same]]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def _line_spans(chunk: flat.Chunk) -> tuple[flat.Spans, np.ndarray]:
    """Lines that are not empty, and whether each has a word."""
    newline = chunk.buf == 10
    lines = flat.spans(chunk.buf, chunk.offsets, newline)
    ink = np.concatenate([[0], np.cumsum(~flat.space_mask(chunk.buf))])
    return lines, ink[lines.end] > ink[lines.start]


def _judge(chunk: flat.Chunk) -> dict[str, np.ndarray]:
    n = chunk.n_docs
    words = flat.words(chunk)
    n_words = np.bincount(words.doc, minlength=n)
    start_of_char = (chunk.buf & 0xC0) != 0x80
    ink = start_of_char & ~flat.space_mask(chunk.buf)
    cum = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    ink_cum = cum(ink)
    symbols = cum(_SYMBOL[chunk.buf])
    lo, hi = chunk.offsets[:-1], chunk.offsets[1:]
    lines, has_word = _line_spans(chunk)
    worded = np.flatnonzero(has_word)
    key = flat.mix(lines.hash[worded] ^ flat.mix(lines.doc[worded].astype(np.uint64) + np.uint64(1)))
    n_lines = np.bincount(lines.doc[worded], minlength=n)
    _, first = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(lines.doc[worded][first], minlength=n)
    raw = chunk.buf.tobytes()
    bad = np.zeros(len(worded), bool)
    for k, w in enumerate(worded):
        line = raw[lines.start[w] : lines.end[w]].strip(b" \t\n\x0b\x0c\r")
        bad[k] = line_fails(line.decode("utf-8", "replace"))
    gone = worded[bad]
    lost = np.bincount(lines.doc[gone], weights=ink_cum[lines.end[gone]] - ink_cum[lines.start[gone]], minlength=n).astype(np.int64)
    out = {
        "n_words": n_words,
        "word_chars": ink_cum[hi] - ink_cum[lo],
        "n_symbols": symbols[hi] - symbols[lo],
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(words.hash, words.doc, n),
    }
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & (100 * lost <= MAX_LOST_PERCENT * out["word_chars"])
    out |= {"n_lines": n_lines, "n_bad_lines": np.bincount(lines.doc[gone], minlength=n), "lost_chars": lost}
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in flat.chunks(batch.column(1)):
            ids = batch.column(0).slice(chunk.first, chunk.n_docs)
            cols = {k: pa.array(v.astype(np.int64) if v.dtype != bool else v) for k, v in _judge(chunk).items()}
            yield pa.RecordBatch.from_arrays([ids, *cols.values()], ["doc_id", *cols])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts for each document; no shuffle."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_batches, OUT)


def clean_text(text: str | None) -> str:
    """The text without its failing lines."""
    if not text:
        return ""
    return "\n".join(x for x in text.split("\n") if not (s := x.strip(" \t\n\x0b\x0c\r")) or not line_fails(s))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text_col`` without failing lines."""

    @F.pandas_udf("string")
    def cleaned(s: pd.Series) -> pd.Series:
        return s.map(clean_text)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents"))


_BOILER_SQL = "|".join(BOILERPLATE)
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, text FROM d),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, string_agg(word, ' ') OVER o AS g, count(*) OVER o AS c FROM pos
        WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {REPEAT_WINDOW - 1} FOLLOWING)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS t FROM win WHERE c = {REPEAT_WINDOW}),
cover AS (SELECT p.doc_id, p.i, coalesce(max(CASE WHEN t.t THEN p.i END) OVER
            (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {REPEAT_WINDOW - 1} PRECEDING AND CURRENT ROW), 0) > 0 AS hit
          FROM pos p LEFT JOIN twice t USING (doc_id, i)),
rep AS (SELECT doc_id, count(*) FILTER (hit) AS n_repeat_words FROM cover GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT doc_id, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s,
         length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS ink FROM lines
       WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
judged AS (SELECT *, NOT regexp_matches(s, '[.!?"'':;)…]$')
           OR regexp_matches(s, '!!.*!!.*!!') OR regexp_matches(s, '[|»›].*[|»›].*[|»›]')
           OR regexp_matches(lower(s), '{_BOILER_SQL}')
           OR length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) * 10 > ink AS bad FROM lw),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
        coalesce(sum(ink) FILTER (bad), 0) AS lost_chars FROM judged GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines,
        coalesce(lost_chars, 0) AS lost_chars
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept,
  n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, lost_chars::BIGINT AS lost_chars FROM b
"""
