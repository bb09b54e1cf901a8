from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skyrill.llm import variants


def counted(rows, damage=97):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if a != b and one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_near_words_equal_all_pairs(spark, seed):
    """Few letters, repeated letters and equal counts: many ties, chains and words within one edit."""
    rng = random.Random(seed)
    words = {}
    for _ in range(500):
        w = "".join(rng.choice("aabé") for _ in range(rng.randint(5, 8)))
        words[w] = rng.choice([3, 3, 4, 6, 12, 13, 25, 60, 200])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.group_variants(df)) == grouped(words)


def test_documents(spark, docs_of):
    rng = random.Random(7)
    stems = ["colour", "grüße", "ÀÉÎÕ×a", "planning", "aaaaaa", "parallel", "Schloss", "abcd", "İstanbul", "naïveté", "ﬁnally", "été÷oui"]
    typo = lambda w: w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "x", w[k] * 2]) + w[k + 1 :]
    texts = [" ".join(rng.choice([str, str.upper, str.title])(typo(rng.choice(stems))) + rng.choice(["", "1", "-b", "."]) for _ in range(60)) for _ in range(150)]
    texts += [None, "", "12 34", texts[0], "word" * 300_000]
    expect = counted(enumerate(texts))
    assert len(expect) > 30
    got = variants.count_words(docs_of(texts).repartition(3))
    assert {r.word: r.n for r in got.collect()} == expect
    assert rows_of(variants.group_variants(got)) == grouped(expect)


def test_damage_is_by_document(spark):
    rows = [(i, f"letters number {'abcdefgh'[i % 8] * 6}") for i in range(400)] + [(None, "letters"), (None, "letters")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in variants.count_words(df).collect()}
    assert got == counted(rows) and got["letters"] < 402
    whole = {r.word: r.n for r in variants.count_words(df, damage=0).collect()}
    assert whole == counted(rows, 0) and whole["letters"] == 402


def test_long_chains(spark):
    """Each word is one edit from the next: pointers double until all reach the end."""
    words = {"a" * (5 + k): 3 * 2**k for k in range(40)}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and {r[1] for r in got.values()} == {"a" * 44}


def test_empty_table(spark, docs_of):
    assert variants.group_variants(variants.count_words(docs_of([]))).count() == 0
    assert variants.group_variants(variants.count_words(docs_of([None, "", "ab cd"]))).count() == 0
