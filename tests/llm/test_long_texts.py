"""One text of some megabytes among short ones: every operator reads it whole."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from skyrill.llm import decontaminate, langid, linededup, minhash, quality, tokencount, warc
from skyrill.llm.shared import fresh_path

N_LINES, LINE_WORDS = 6000, 40


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(12)
    lines = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(LINE_WORDS)) + "." for _ in range(N_LINES)]
    text = "\n".join(lines)
    assert len(text) > 1_500_000
    return text


def test_line_dedup(spark, docs_of, long_text):
    first, last = long_text.split("\n")[0], long_text.split("\n")[-1]
    rows = {r.doc_id: r for r in linededup.dedup_lines(docs_of([long_text, f"{first}\nown line of this text only\n{last[:-1]}!"])).collect()}
    assert rows[0].text == long_text and rows[0].n_lines == N_LINES
    assert rows[1].text == "own line of this text only" and rows[1].n_dropped == 2


def test_near_dedup(spark, docs_of, long_text):
    words = long_text.split()
    copy = " ".join(["changed" if k % 500 == 0 else w for k, w in enumerate(words)])
    rows = {r.doc_id: r for r in minhash.near_duplicates(docs_of([long_text, copy, "short text"])).collect()}
    assert [rows[k].component_id for k in range(3)] == [0, 0, 2] and rows[0].n_shingles == len(words) - 4


def test_decontamination(spark, docs_of, long_text):
    item = "Which of these words is asked for here today? The answer is this one word of seven."
    at = long_text.index("\n", len(long_text) - 5000)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs_of([long_text, long_text[:at] + " " + item + long_text[at:]]), bench).collect()] == [(1, 5)]


def test_quality_rules(spark, docs_of, long_text):
    r = quality.measure(docs_of([long_text])).first()
    assert (r.n_words, r.n_lines, r.n_bad_lines, r.n_repeat_words, r.kept) == (N_LINES * LINE_WORDS, N_LINES, 0, 0, True)


def test_token_counts_cross_blocks(spark, docs_of, long_text):
    written = tokencount.write_tokens(docs_of([long_text, "a few words", None]), fresh_path(spark, "long"), tokencount.default_ranks()).cache()
    assert written.count() == 3
    counts = tokencount.count_tokens(written.select("file").distinct(), block_bytes=1 << 16)
    n = {r.doc_id: r.n_tokens for r in written.join(counts, ["file", "number"]).collect()}
    assert n[0] > 400_000 and 0 < n[1] < 10 and n[2] == 0


def test_archives(spark, long_text):
    marks = long_text + ("\r\n\r\nWARC/1.0\r\n" * 3000)
    pages = spark.createDataFrame([(1, "http://a", marks), (2, "http://b", "x"), (None, "http://c", "y")], "page_id long, url string, html string")
    path = fresh_path(spark, "long-archives")
    warc.write_archives(warc.plan_records(pages), path)
    rows = warc.read_records(spark, path).select(F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("h"), "header").collect()
    assert sorted((r.n, r.h) for r in rows) == sorted((len(t), hashlib.sha256(t.encode()).hexdigest()) for t in (marks, "x", "y"))
    assert all(b"WARC-Record-ID: <" in r.header.encode() for r in rows)


def test_language(spark, docs_of, long_text):
    rows = langid.identify_documents(docs_of([long_text, "abc def", None])).collect()
    assert len(rows) == 3 and {r.doc_id: r.language for r in rows}[0] == "en"
