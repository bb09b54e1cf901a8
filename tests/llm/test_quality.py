from __future__ import annotations

import re

import pytest

from skyrill.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


TEXTS = [
    None,
    "",
    " \n\t",
    "one two",
    "A fine sentence of words that ends well. " * 3,
    "\n".join(f"Line number {i} of a clean document, with enough words." for i in range(10)),
    "\n".join(f"Home | Item{i} | About | Contact {i}" for i in range(12)),
    "Buy!! now!! it!! is!! good!! " * 6,
    "a### b$$$ c%%% " * 20,
    "é😀 naïve text here.\nAll rights reserved by someone.\nAnother sound line of text that is long enough to stay here as it is.",
    "same line here.\nsame line here.\nother line there, of many words that are not said again in it at all, so it counts.",
]


def test_counts(spark, docs_of):
    rows = {r.doc_id: r for r in quality.measure(docs_of(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), t
    assert [i for i in rows if rows[i].kept] == [9, 10]


@pytest.mark.parametrize("limit", [1, 40, 10_000])
def test_chunks_do_not_matter(limit, monkeypatch, spark):
    import pyarrow as pa

    from skyrill.llm import flat

    whole = [quality._judge(c) for c in flat.chunks(pa.array(TEXTS, pa.string()))]
    parts = [quality._judge(c) for c in flat.chunks(pa.array(TEXTS, pa.string()), limit)]
    for k in whole[0]:
        assert sum((p[k].tolist() for p in parts), []) == sum((p[k].tolist() for p in whole), [])


def test_cleaning_removes_bad_lines(spark, docs_of):
    out = quality.clean(docs_of(["Good line.\nHome | a | b | c\n\nno mark", None])).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["Good line.\n", ""] and out[0].h == "x"
    assert quality.measure(docs_of([])).count() == 0
