from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyrill.llm import fim

def plain_version(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀", "́", "\n", " ", "<", ">", "P", "\r", "\x00", " "]
    texts = [None, "", "x", "😀", "<P>", "a<S>b", "x<M>", "<<P", "S>", "<P" * 40, "same", "same"]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(300)]


@pytest.mark.parametrize("chunk", [1, 3, 64, fim.CHUNK_BYTES])
def test_equals_plain_version(spark, docs_of, chunk):
    texts = odd_texts()
    out = fim.fill_in_middle(docs_of(texts).repartition(3), chunk_bytes=chunk)
    rows = {r.doc_id: r for r in out.withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()}
    assert len(rows) == len(texts) and {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(i, t), (i, t)
        assert r.restored == (t or "") and r.h == "x" and r.text == t


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units(unit):
    """Cuts lie where a unit begins: joined units are the text, and ranks count them."""
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "é", " ", "\n", "  "]) for _ in range(rng.randint(1, 40)))
        raw = text.encode()
        blank = b" \t\n\v\f\r"
        starts = [0] + [i for i in range(1, len(raw)) if (raw[i - 1] == 10 if unit == "line" else raw[i - 1] in blank and raw[i] not in blank)]
        h = np.array([rng.randrange(1 << 32)]), np.array([rng.randrange(1 << 32)])
        n, a, b, at, then = (int(x[0]) for x in fim.cut_places(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), *h, unit=unit, chunk_bytes=7))
        assert n == len(starts) and (a, b) == tuple(sorted((int(h[0][0]) % (n + 1), int(h[1][0]) % (n + 1))))
        assert (at, then) == tuple((starts + [len(raw)])[k] for k in (a, b))


def test_long_text_and_null_id(spark):
    text = "añ漢😀" * 700_000
    rows = spark.createDataFrame([(None, text), (7, "short"), (7, "short"), (8, None)], "doc_id long, text string")
    out = fim.fill_in_middle(rows).withColumn("restored", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(out) == 4
    for r in out:
        assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(r.doc_id, r.text) and r.restored == (r.text or "")


def test_empty_table_and_clash(spark, docs_of):
    assert fim.fill_in_middle(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs_of(["x"]).withColumn("Form", F.lit(1)))


def test_query_stays_in_one_stage(spark):
    plan = fim.op11_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
