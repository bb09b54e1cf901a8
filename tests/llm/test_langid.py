from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyrill.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["eau", "oux", "ère", "ment"]}


def text(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for i in range(300):
        lang = rng.choice(list(SYLLABLES))
        declared = lang if rng.random() < 0.85 else rng.choice([None, "aa", "bb", "cc"])
        host = f"www.{lang}.example.{lang}" if rng.random() < 0.8 else "mixed.example.org"
        out.append((i, text(lang, rng), declared, host, lang))
    out += [(900, None, None, "www.bb.example.bb", "bb"), (901, "", "cc", None, "cc"), (902, None, None, None, "und"), (903, "ЖЧЩ " * 80, None, "mixed.example.org", "und")]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, truth string")


def test_held_out_accuracy(spark, rows):
    got = {r.doc_id: r for r in langid.identify_documents(rows).collect()}
    truth = {r.doc_id: r.truth for r in rows.collect()}
    assert sum(got[i].language == truth[i] for i in range(300)) >= 297
    assert got[900].language in SYLLABLES and got[901].language == "cc"
    assert got[902].language == "und" or got[902].confidence <= 1
    assert not got[903].kept


def test_evidence_is_fused(spark, rows):
    """A short text is decided by declaration and host."""
    more = spark.createDataFrame([(950, "ka", "bb", "www.bb.example.bb", "bb")], rows.schema)
    got = {r.doc_id: r.language for r in langid.identify_documents(rows.union(more)).collect()}
    assert got[950] == "bb"


def test_address_and_markup(spark):
    df = spark.createDataFrame([("http://u@Www.Site.de:80/x", '<!DOCTYPE html><html class=a lang="DE-at">')], "url string, html string")
    r = df.select(langid.host_of(F.col("url")).alias("h"), langid.suffix_of(langid.host_of(F.col("url"))).alias("s"), langid.markup_language(F.col("html")).alias("m")).first()
    assert tuple(r) == ("www.site.de", "de", "de")


def test_empty_table(spark, rows):
    assert langid.identify_documents(rows.limit(0)).count() == 0


def test_rare_language_is_known(spark):
    """A language of few rows is learned whatever the size of the sample."""
    rng = random.Random(3)
    out = [(i, text("aa", rng), "aa", "h") for i in range(600)] + [(700 + i, text("bb", rng), "bb", "h") for i in range(3)] + [(800, "ver", "cc", "h")]
    docs = spark.createDataFrame(out, "doc_id long, text string, lang string, source string")
    model = langid.fit_text(docs, "doc_id", F.col("text"), F.col("lang"), rows=30)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"), model).collect()}
    assert all(got[700 + i].language == "bb" and got[700 + i].kept for i in range(3))
    assert sum(got[i].language == "aa" for i in range(600)) >= 598


def test_suffix_and_markup_decide_pages(spark, tmp_path):
    """Pages of one text: hosts seen nowhere else are told apart by suffix, pages of one host by markup."""
    from skyrill.llm import registry

    rng = random.Random(4)
    page = lambda words, lang=None: f"<html{f' lang={lang}' if lang else ''}><body><p>{words}</p></body></html>"
    out = [(i, f"http://h{i}.example.{x}/", page(text(x, rng), x)) for i in range(300) for x in [list(SYLLABLES)[i % 3]]]
    out += [(900, "http://new.example.bb/", page("zz")), (901, "http://new.example.cc/", page("zz"))]
    out += [(902, "http://new.example.zz/", page("zz", "bb")), (903, "http://new.example.zz/", page("zz", "cc"))]
    spark.createDataFrame(out, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.language for r in registry.queries()["op1_page_language"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(900, 904)] == ["bb", "cc", "bb", "cc"]
