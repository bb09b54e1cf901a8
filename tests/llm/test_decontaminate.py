from __future__ import annotations

import random
from collections import Counter

import numpy as np

from skyrill.llm import decontaminate as D

from .brute_force import leaks as brute


def test_finds_planted_items_and_nothing_else(spark, docs_of):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = [word() for _ in range(30)]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)).capitalize() + "."
    items = [(i, f"{sentence(rng.randint(8, 90))} {sentence(rng.randint(2, 12))}") for i in range(60)] + [(60, None), (61, ""), (62, "Word.")]
    filler = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n))
    texts, want = [None, ""], set()
    for i in range(60):
        k = len(texts)
        if i % 3 == 0:
            texts.append(f"{filler(rng.randint(0, 300))} {items[i][1]} {filler(80)}")
            want.add((k, i))
        elif i % 3 == 1:
            texts.append(filler(200))
        else:
            texts.append(f"{filler(50)}\n{items[i][1].upper()}!! {filler(5)}")
            want.add((k, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.matches(docs_of(texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert {r.doc_id for r in D.decontaminate(docs_of(texts), bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_half_an_item_is_no_leak(spark, docs_of):
    bench = spark.createDataFrame([(1, "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi.")], "item_id long, text string")
    assert D.matches(docs_of(["alpha beta gamma delta epsilon zeta eta theta and then other words"]), bench).count() == 0


def test_empty_tables_and_many_shards(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(1, "one two three four five six. seven eight nine."), (2, "one two three four five six. seven eight nine.")], "item_id long, text string")
    assert D.matches(docs_of([]), bench).count() == 0
    assert D.matches(docs_of(["x"]), bench.limit(0)).count() == 0
    monkeypatch.setattr(D, "SHARD_BYTES", 10)
    rows = D.matches(docs_of(["a one two three four five six. Seven eight nine b"]), bench).collect()
    assert {r.item_id for r in rows} == {1, 2}


def test_equals_brute_force_for_every_size_of_an_index(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"t{min(int(rng.expovariate(0.004)), 2000)}"
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, f"{sentence(rng.randint(4, 150))} {sentence(rng.randint(2, 20))}") for i in range(70)]
    items += [(70, items[0][1]), (71, None), (72, ""), (73, "One"), (74, "Ünïcode wörds, ÉCOLE. Été!")]
    texts = [None, "", "one", "x ünïcode wörds, école. été! y"]
    for i in range(70):
        said = items[i][1].split()
        for k in range(len(said)):
            if rng.random() < (0, 0.04, 0.1, 0.3)[i % 4]:
                said[k] = word()
        texts.append(" ".join([*(word() for _ in range(rng.randint(0, 200))), *said, *(word() for _ in range(rng.randint(0, 200)))]))
    texts.append(" ".join(items[k][1] for k in range(70)) * 20)  # a long text that holds every item many times
    want = brute(texts, items)
    assert len(want) > 100 and {i for _, i in want} >= {0, 70, 73, 74} and min(x[0] for x in want.values()) < 0.95
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size, shard in ((1 << 10, 8 << 10), (64 << 10, 4 << 20), (4 << 20, 4 << 20)):
        monkeypatch.setattr(D, "INDEX_BYTES", size)
        monkeypatch.setattr(D, "SHARD_BYTES", shard)
        got = {(r.doc_id, r.item_id): (round(r.score, 9), round(r.question_overlap, 9), round(r.answer_overlap, 9)) for r in D.matches(docs_of(texts), bench).collect()}
        assert got == want


def test_bounds_never_cut_a_score(monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice([f"t{j}" for j in range(40)]) for _ in range(rng.randint(5, 40)))) for i in range(50)]
    terms = [np.unique(h) for h in D._hashes([t for _, t in items])]
    df = Counter(t for x in terms for t in x.tolist())
    index = D.Index([D.Item(i, t, x, np.array([df[y] for y in x.tolist()])) for (i, t), x in zip(items, terms)], 50, 20.0)

    for _ in range(30):
        terms = np.unique([rng.randrange(len(index.terms)) for _ in range(60)])
        got = {p: s for _, p, s in index.retrieve(np.zeros(len(terms), int), terms)}
        want = {}
        for t in terms:
            for k in range(index.border[t], index.border[t + 1]):
                want[index.part[k]] = want.get(index.part[k], 0) + index.impact[k]
        want = {p: s for p, s in want.items() if s >= D.THRESHOLD - 1e-9}
        assert set(got) == set(want)
