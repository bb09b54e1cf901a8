"""Extra columns whose names operators use inside, and repeated rows: neither changes a result or ends a run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyrill.llm import bpe, chat, decontaminate, fim, langid, mixing, quality, tokencount, toxicity, variants, warc
from skyrill.llm.shared import fresh_path

NAMES = "id h n c k node label bucket language score digest line lines pos word tree rank head salt payload file number block start size units row copies target words key kind gram all part toxic_ found kept host suffix declared".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word("aeiklmn" if i % 2 else "oszwrtu") for _ in range(40)) + ("\nbadword" if i % 3 else "") for i in range(40)] + [None, ""]
    rows = [(i, t, "ab"[i % 2], f"s{i % 3}.com") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def with_extras(df, upper=False):
    return df.select("*", *[F.lit(f"extra {n}").alias(n.upper() if upper else n) for n in NAMES if n not in {c.lower() for c in df.columns}])


def operators(spark, docs):
    items = spark.createDataFrame([(1, "one question of seven words is here? the answer is that one")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    pages = lambda d: d.select("doc_id", F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), "source", F.lit("/x")).alias("url"), F.col("text").alias("html"), *[c for c in d.columns if c not in ("doc_id", "text", "lang", "source", "url")])
    model = toxicity.fit(docs, labels)
    return {
        "op1": lambda d: langid.identify_documents(d).select("doc_id", "language"),
        "op1_pages": lambda d: langid.identify_pages(pages(d)).select("doc_id", "language"),
        "op3": lambda d: decontaminate.matches(d, with_extras(items)).select("doc_id", "item_id"),
        "op4": lambda d: bpe.digest(d, bpe.default_vocabulary()),
        "op6": lambda d: toxicity.score(d, model),
        "op7": lambda d: warc.plan_records(pages(d)).select("page_id", "payload_digest", "refers_to"),
        "op8": lambda d: tokencount.write_tokens(d, fresh_path(spark, "clash"), tokencount.default_ranks()).select("doc_id"),
        "op9": lambda d: chat.transcripts(d.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text", *[c for c in d.columns if c.lower() in ("line", "key", "kind", "part")])).select("conv_id"),
        "op10": lambda d: quality.measure(d),
        "op11": lambda d: fim.fill_in_middle(d.drop("n", "N")).select("doc_id", "form", "output"),
        "op12": lambda d: mixing.mix(d),
        "op13": lambda d: variants.count_words(d),
    }


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["op1", "op1_pages", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"])
def test_extra_columns_change_nothing(spark, docs, name):
    run = operators(spark, docs)[name]
    want = rows(run(docs))
    assert rows(run(with_extras(docs, upper=name in ("op10", "op12")))) == want


@pytest.mark.parametrize("name", ["op1", "op6", "op10", "op11"])
def test_repeated_rows_repeat(spark, docs, name):
    """Two copies of every row, one id each: each row has its result twice."""
    run = operators(spark, docs)[name]
    once, twice = rows(run(docs)), rows(run(docs.union(docs)))
    if name == "op1":
        assert len(twice) == 2 * len(once) or twice == once
    else:
        assert twice == sorted(once * 2)


def test_repeated_page_ids_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.refers_to or 0) for r in warc.plan_records(pages).collect())
    assert got == [(1, 2), (1, 2), (2, 0), (2, 0)]
