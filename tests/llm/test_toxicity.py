from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyrill.llm import flat, toxicity

BAD = ["horribleword", "nastything", "vileperson"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8)))
    out = []
    for _ in range(n):
        toxic = int(rng.random() < 0.3)
        words = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(3):
                b = rng.choice(BAD)
                if rng.random() < 0.3:
                    k = rng.randrange(3, len(b))
                    b = b[:k] + rng.choice("xz") + b[k + 1 :]
                words[rng.randrange(len(words))] = b
        out.append((" ".join(words), toxic))
    return out


def test_held_out_accuracy_and_misspellings(spark, docs_of):
    data = corpus()
    docs = docs_of([t for t, _ in data])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = sum(r.predicted == data[r.doc_id][1] for r in held)
    assert right >= 0.93 * len(held), right / len(held)
    unseen = docs_of(["some words around horriblewrd and nothing else here at all", None, ""], first=5000)
    a, b, c = sorted(toxicity.score(unseen, toxicity.fit(docs, labels)).collect(), key=lambda r: r.doc_id)
    assert a.score > 0.5 > b.score and b.score == c.score and b.predicted == 0


def test_without_labels(spark, docs_of):
    docs = docs_of(["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.5, 0.5]
    assert toxicity.score(docs_of([]), toxicity.fit(docs, none)).count() == 0


def test_bag_is_the_mean_of_word_means():
    """Against plain loops, and the same for every size of a chunk."""
    texts = ["a bad bad  bad bad word", "", "word", "a word " * 40 + "ends"]
    rng = np.random.Generator(np.random.PCG64(2))
    score = rng.normal(size=toxicity.BUCKETS)

    def of_word(w):
        (c,) = flat.chunks(pa.array([w]))
        _, gram = toxicity.word_grams(c.buf, np.array([0]), np.array([len(w)]))
        return np.mean(score[gram])

    want = []
    for t in texts:
        words = [w for k, w in enumerate(t.split()) if k == 0 or w != t.split()[k - 1]]
        weight = {w: math.log2(1 + words.count(w)) for w in set(words)}
        want.append(sum(x * of_word(w) for w, x in weight.items()) / (sum(weight.values()) + toxicity.PAD))
    for limit in (1, 1 << 20):
        bag = toxicity.Bag(flat.chunks(pa.array(texts), limit))
        assert np.allclose(bag.mean(score), want)
        total = np.zeros(len(texts))
        for doc, bucket, value in bag.densities(np.ones(toxicity.BUCKETS, bool), docs=1):
            np.add.at(total, doc, value * score[bucket])
        assert np.allclose(total, want)


def test_sample_is_bounded_by_bytes_of_each_class(spark, monkeypatch):
    """Rare toxic rows beside long clean ones all stay; a class over its share keeps some rows, and one at least."""
    rows = [(i, "x" * (5000 if i % 10 else 50), int(i % 10 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    count = lambda: {r.toxic: (r["count"], r.bytes) for r in toxicity.bounded_by_bytes(df).groupBy("toxic").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("bytes")).collect()}
    assert count() == {0: (360, 1_800_000), 1: (40, 2000)}
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400_000)
    n = count()
    assert n[1] == (40, 2000) and 40 < n[0][0] < 120
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1)
    assert {k: v[0] for k, v in count().items()} == {0: 1, 1: 1}


def test_long_texts_are_scored_whole(spark, docs_of):
    data = corpus(200)
    docs = docs_of([t * (400 if i == 5 else 1) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)], "doc_id long, quality int, toxic int")
    long = "fine words " * 200_000 + "horribleword nastything"
    seen = toxicity.score(docs_of([long, "fine words"]), toxicity.fit(docs, labels)).collect()
    assert len(seen) == 2 and all(0 <= r.score <= 1 for r in seen)
