from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from skyrill.llm import flat, minhash

from .brute_force import near as brute


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = [None, "", " \n", "one", "one", "One two", "one two three four", "a\x0bb\tc"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 120, 400]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.005, 0.02, 0.04]))):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    shared = [word() for _ in range(60)]
    out += [" ".join([word() for _ in range(40)] + shared + [word() for _ in range(40)]) for _ in range(25)]
    return out


def test_equals_brute_force(spark, docs_of):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(texts)).collect()}
    assert got == brute(texts)


def test_chain_without_direct_link(spark, docs_of):
    base = [f"w{i}" for i in range(300)]
    step = lambda k: " ".join(base[k * 20 : k * 20 + 200])
    texts = [step(k) for k in (4, 0, 2, 1, 3)]
    rows = minhash.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {k: v[1] for k, v in brute(texts).items()}
    assert sum(r.kept for r in rows) == 1


def test_empty_table(spark, docs_of):
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_signature_estimates_similarity():
    words = [f"v{i}" for i in range(600)]
    a, b = " ".join(words[:500]), " ".join(words[50:550])
    (c,) = flat.chunks(pa.array([a, b, "only one"]))
    doc, h = minhash.shingles(c)
    s = minhash.signatures(doc, h, 3)
    j = len(set(h[doc == 0]) & set(h[doc == 1])) / len(set(h[doc <= 1]))
    assert abs(np.mean(s[0] == s[1]) - j) < 0.1
    assert len(set(s[2].tolist())) == 1  # one shingle fills every bin


def test_null_ids(spark):
    text = "some words that are said by two documents"
    df = spark.createDataFrame([(None, text, 0), (3, text, 0), (None, "words of only one document without an id", 0)], "doc_id long, text string, bucket int")
    got = sorted((r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, True), (3, False), (3, True)]


def test_parity_bits_rule_out_no_link(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(260)]
    texts = []
    for _ in range(60):
        copy = list(base[: rng.choice([40, 200, 260])])
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(copy))
    (c,) = flat.chunks(pa.array(texts))
    doc, h = minhash.shingles(c)
    bits = minhash.parity(doc, h, c.n_docs)
    sets = [set(h[doc == k].tolist()) for k in range(len(texts))]
    rows = [(len(s), *b) for s, b in zip(sets, bits.tolist())]
    both = [(a, b, *rows[a], *rows[b]) for a in range(len(texts)) for b in range(a)]
    names = ["n", *minhash.PARITY]
    df = spark.createDataFrame(both, ", ".join(f"{x} long" for x in ["a", "b", *names, *[f"{x}x" for x in names]]))
    admitted = {(r.a, r.b) for r in df.where(minhash.may_link()).collect()}
    linked = {(a, b) for a, b, *_ in both if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= admitted and len(admitted) < len(both)
    for a, b, *_ in both:
        assert sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(bits[a].tolist(), bits[b].tolist())) <= len(sets[a] ^ sets[b])
