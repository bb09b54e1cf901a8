"""The pipeline against its stages applied by hand, and its parts against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from skyrill.llm import bpe, minhash
from skyrill.llm.shared import stage, table

from . import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_documents(spark):
    docs = table(spark, SF, "documents")
    sizes = [docs.count()]
    columns = docs.columns
    for name, f in P.STAGES:
        out = stage(f(spark, docs, SF), f"test-{name}")
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        assert out.count() == out.select("doc_id").distinct().count()
        if name == "near_dedup":
            kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
            assert {r.doc_id for r in out.select("doc_id").collect()} == kept
        docs = out
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_order_of_stages():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "bpe"]


@pytest.fixture
def small_tables(spark, tmp_path):
    """A corpus of two languages with near copies, repeated lines, leaks, nulls, and columns whose names the stages use inside."""
    rng = random.Random(8)
    syllables = {"aa": ["ka", "lo", "mi", "ta", "ne"], "bb": ["sch", "ung", "ver", "ein", "auf"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4)))
    line = lambda lang, n=12: " ".join(word(lang) for _ in range(n))
    items = [(k, f"{line('aa', 14)}. {line('aa', 6)}.") for k in range(6)]
    common = {x: [line(x) for _ in range(3)] for x in syllables}
    rows = []
    for i in range(120):
        x = ("aa", "bb")[i % 2]
        lines = [line(x) for _ in range(rng.randint(3, 9))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(common[x])[:-1] + rng.choice("xyz"))
        if i % 7 == 0:
            lines += ["short", "short"]
        if i % 11 == 0:
            lines.append(items[i % 6][1])
        rows.append((i, "\n".join(lines), x))
    for i in range(120, 150):  # three of each, with another word in every long line
        x = ("aa", "bb")[i // 3 % 2]
        base = base if i % 3 else [line(x, 60).split(" ") for _ in range(2)]
        rows.append((i, "\n".join(" ".join([*w[: 7 * (i % 3)], "changed" * (i % 3), *w[7 * (i % 3) + 1 :]]) for w in base), x))
    rows += [(150, None, "aa"), (151, "", "bb"), (152, "Ж" * 400, None), (153, rows[3][1], rows[3][2])]
    docs = [(i, t, x, f"host{i % 3}", len(t or ""), "a", "b", "c", "d") for i, t, x in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, id string, dropped string, lines string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), items


def test_stages_equal_brute_force(spark, small_tables):
    """Each stage on what its predecessor kept; the learned stage by what is known of these texts."""
    sf, items = small_tables
    docs = table(spark, sf, "documents")
    columns, removed = docs.columns, 0
    for name, f in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(f(spark, docs, sf), f"brute-{name}")
        after = {r.doc_id: r for r in out.collect()}
        ids = sorted(before)
        texts = [before[i] for i in ids]
        if name == "language_id":
            assert set(after) >= set(range(150)) | {153} and 152 not in after and {r.lang for r in after.values()} == {"aa", "bb"}
        elif name == "line_dedup":
            want = dict(zip(ids, brute_force.lines(texts)))
            assert {i: r.text for i, r in after.items()} == {i: t for i, t in want.items() if t == before[i] or t.strip()}
            assert any(t != before[i] for i, t in want.items())
        elif name == "near_dedup":
            assert set(after) == {ids[k] for k, (_, c) in brute_force.near(texts).items() if c == k}
        elif name == "decontamination":
            bad = {ids[d] for d, _ in brute_force.leaks(texts, items)}
            assert bad and set(after) == set(ids) - bad
        else:
            library = Tokenizer.from_file(bpe.default_vocabulary())
            for i, t in before.items():
                e = library.encode(t or "", add_special_tokens=False).ids
                decoded = library.decode(e, skip_special_tokens=False)
                assert (after[i].n_tokens, after[i].ids_sha256, after[i].decoded_sha256) == (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        removed += len(before) - len(after)
        docs = out
    assert removed > 25 and docs.count() > 60
