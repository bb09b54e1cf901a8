from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyrill.llm import graph, linededup

from .brute_force import distance
from .brute_force import lines as brute


def corpus():
    rng = random.Random(5)
    out = [None, "", "\n\n", "short\nshort"]
    bases = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(24, 70))) for _ in range(12)]
    for _ in range(25):
        lines = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                p, op = rng.randrange(len(x)), rng.randrange(3)
                if op == 0:
                    x.insert(p, rng.choice("xyz"))
                elif op == 1:
                    x[p] = rng.choice("xyz")
                else:
                    del x[p]
            lines.append("".join(x))
        out.append("\n".join(lines))
    return out


def test_equals_brute_force(spark, docs_of):
    texts = corpus()
    rows = linededup.dedup_lines(docs_of(texts)).collect()
    assert {r.doc_id: r.text for r in rows} == dict(enumerate(brute(texts, exact_short=False)))
    assert all(r.h == "x" for r in rows)


def test_banded_distance(spark):
    rng = random.Random(1)
    pairs = []
    while len(pairs) < 400:
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abé") for _ in range(max(0, len(a) + rng.randint(-2, 2))))
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.expr(linededup.banded_distance("x", "y", 2)).alias("d"))
    for r in df.collect():
        d = distance(r.x, r.y)
        assert (r.d == d) if d <= 2 else r.d > 2


def test_empty_and_repeated_rows(spark, docs_of):
    assert linededup.dedup_lines(docs_of([])).count() == 0
    line = "a line of more than twenty-four characters"
    rows = linededup.dedup_lines(docs_of([f"{line}\n{line}\nend"]).union(docs_of([f"{line}\n{line}\nend"]))).collect()
    assert [r.text for r in rows] == [f"{line}\nend"] * 2


def test_clashing_columns_and_null_ids(spark):
    line = "a line of more than twenty-four characters"
    rows = [(1, line, 1, 2, 3, 4), (2, f"{line}!\nx", 1, 2, 3, 4), (None, "another line of more than 24 characters", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, dropped int, node int, label int, pos int")
    got = {r.doc_id: (r.text, r.dropped, r.pos) for r in linededup.dedup_lines(df).collect()}
    assert got == {1: (line, 1, 4), 2: ("x", 1, 4), None: (rows[2][1], 1, 4)}


def test_queries_drop_equal_short_lines(spark, docs_of, tmp_path):
    """Short lines that are not blank go by equality alone, in op2 and in the pipeline's stage."""
    import corpus_pipeline

    line = "a line of more than twenty-four characters"
    texts = [f"short\n\n{line}\nshort", f" \nshort\n\nshore\n{line}!", "\t\n\u00a0\nshort", "\t\n\u00a0\né\né"]
    want = [f"short\n\n{line}", " \n\nshore", "\t\n\u00a0", "\t\n\u00a0\né"]
    docs = docs_of(texts)
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs, exact_short=True).collect()} == dict(enumerate(want))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.n_dropped for r in linededup.op2_line_dedup(spark, str(tmp_path)).collect()} == {0: 1, 1: 2, 2: 1, 3: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()} == dict(enumerate(want))


def _edited(rng, line, alphabet, edits):
    for _ in range(edits):
        k = rng.randrange(len(line))
        line = line[:k] + rng.choice(["", rng.choice(alphabet), rng.choice(alphabet) + line[k]]) + line[k + 1 :]
    return line


@pytest.mark.parametrize("stars,block", [(0, 16), (3, 16), (3, 512)])
def test_lines_of_one_template_equal_brute_force(spark, docs_of, monkeypatch, stars, block):
    """Hot buckets of lines that differ in any kind of character, some within two edits of each other, some repeating themselves."""
    monkeypatch.setattr(graph, "STAR_ROUNDS", stars)
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(stars)
    lines = []
    for alphabet in ("0123456789", "ABCXYZ", "абвгдежз", "天地玄黃宇宙", "ab"):
        some = [f"entry of the ledger number {''.join(rng.choice(alphabet) for _ in range(rng.choice([8, 14])))}" for _ in range(30)]
        some += [_edited(rng, rng.choice(some), alphabet, rng.randint(1, 3)) for _ in range(30)]
        some += [rng.choice(alphabet[:2]) * rng.randint(24, 30) for _ in range(6)] + [(alphabet[0] + alphabet[1]) * 13 + rng.choice(alphabet) for _ in range(4)]
        lines += some
    rng.shuffle(lines)
    texts = ["\n".join(lines[k : k + 5]) for k in range(0, len(lines), 5)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs_of(texts), exact_short=True).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_stage_drops_emptied_documents(spark, docs_of):
    """Documents whose every line went go as a whole, blank lines between or not; those that lost nothing stay, blank ones too."""
    import corpus_pipeline

    line = "a line of more than twenty-four characters"
    texts = [f"{line}\nshort", f"{line}\n\n{line}", f"\t\n{line}\n \n\nshort", f"{line}!\nown", "\n\n", "", None]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs_of(texts), "").collect()}
    assert got == {0: texts[0], 3: "own", 4: "\n\n", 5: "", 6: None}
