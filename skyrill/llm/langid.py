"""Language ID by Bayesian evidence fusion.

For each document the posterior over languages (and ``UNKNOWN``) is

    P(l | all) ~ P_host(l) * P(declared | l) * P(text | l)

* ``P(text | l)``: a multinomial over hashed byte trigrams, learned from a
  bounded sample of rows that declare a language, tempered to ``EVIDENCE`` trigrams so that long texts are
  not overconfident. Every language that a row with text declares is learned, by a
  grouped count over all rows: each has an equal share of ``SAMPLE_ROWS`` rows, or
  ``LANGUAGE_ROWS`` if that is more, chosen by a threshold on a hash. ``UNKNOWN`` is the flat distribution over seen trigrams;
* ``P(declared | l)``: how often documents whose text says l declare each
  language, counted over all rows and smoothed; nothing declared is no evidence;
* ``P_host(l)``: a hierarchical prior. Counts of the text's languages over all
  rows by host, by address suffix and in total are grouped aggregates, and each
  level is smoothed by ``STRENGTH`` pseudo-rows of the level above it.

The text is read once; its scores are a narrow staged table. Counts are summed
on the map side, so a host that holds a third of all rows is no hot group, and
the priors meet the scores in an equi-join that the planner may split.

A document is kept when its language is known and its posterior is at least
``MIN_POSTERIOR``.

Defined results: a null or empty text carries no text evidence and is decided by
the rest; with no evidence at all the language is ``UNKNOWN`` and not kept;
ties go to the first language in alphabetical order; unknown or null hosts and
declarations are values of their own; a text of any length is read whole; repeated rows repeat; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import stage, table

UNKNOWN = "und"
SAMPLE_ROWS = 4000
LANGUAGE_ROWS = 200
TABLE_BITS = 15
EVIDENCE = 40.0
FULL_TEXT = 200.0
#: Trigrams from which a text of the sample gains little more weight.
FAIR = 2000.0
STRENGTH = 20.0
UNKNOWN_PRIOR = 0.002
MIN_POSTERIOR = 0.6

_U = np.uint64


def _trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each byte trigram of letters, blanks and marks folded to one separator."""
    b = flat.lower_ascii(buf)
    letter = (b >= 97) & (b <= 122) | (b >= 128)
    b = np.where(letter, b, 32).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint32)
    slot = ((code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)
    border = np.zeros(len(b), bool)
    border[offsets[1:-1][offsets[1:-1] < len(b)]] = True
    inside = ~(border[1:-1] | border[2:])
    inside &= letter[:-2] | letter[1:-1] | letter[2:]
    at = np.flatnonzero(inside)
    return np.searchsorted(offsets, at, "right") - 1, slot[at]


class TextModel:
    """Log likelihood of trigram slots by language; the last row is ``UNKNOWN``."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        counts = counts + 0.5
        p = counts / counts.sum(1, keepdims=True) if len(counts) else counts
        mean = p.mean(0, keepdims=True) if len(p) else np.full((1, 1 << TABLE_BITS), 2.0**-TABLE_BITS)
        # A text in none of the languages shows trigrams that all of them avoid.
        flat_p = 0.5 * np.full_like(mean, 2.0**-TABLE_BITS) + 0.5 * np.sqrt(mean) / np.sqrt(mean).sum()
        self.log = np.log(np.concatenate([p, flat_p])).astype(np.float32)

    def score(self, chunk: flat.Chunk) -> np.ndarray:
        """(documents, languages + 1) tempered log likelihoods; zero where there is no trigram."""
        doc, slot = _trigrams(chunk.buf, chunk.offsets)
        n = np.bincount(doc, minlength=chunk.n_docs)
        out = np.stack([np.bincount(doc, weights=row[slot], minlength=chunk.n_docs) for row in self.log], 1)
        # The mean per trigram, times a weight that grows with the text up to EVIDENCE.
        return out / np.maximum(n, 1)[:, None] * (EVIDENCE * n / (n + FULL_TEXT))[:, None]


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): trigrams of each language in the texts of a batch; a text of n trigrams weighs like n FAIR / (n + FAIR)."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        total = np.zeros((len(langs.dictionary), 1 << TABLE_BITS))
        for chunk in flat.chunks(batch.column(1)):
            doc, slot = _trigrams(chunk.buf, chunk.offsets)
            weight = FAIR / (FAIR + np.bincount(doc, minlength=chunk.n_docs))
            np.add.at(total, (code[chunk.first + doc], slot), weight[doc])
        lang, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(slot, pa.int32()), pa.array(total[lang, slot])], ["lang", "slot", "n"])


def fit_text(docs: DataFrame, id_col: str, text: Column, declared: Column, rows: int = SAMPLE_ROWS) -> TextModel:
    """Learn every declared language, from all rows if they are at most ``rows``, else from an equal share for each.

    Whole texts are counted where they lie; the driver receives one number for each language and trigram slot.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), declared.alias("lang"), text.cast("string").alias("text")).where("lang is not null and text <> ''")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return TextModel([], np.zeros((0, 1 << TABLE_BITS)))
    share = max(rows // len(sizes), LANGUAGE_ROWS) if sum(sizes.values()) > rows else rows
    cuts = spark.createDataFrame([(lang, min(int(share / n * 2**64) - 2**63, 2**63 - 1)) for lang, n in sizes.items()], "lang string, cut long")
    # Rows that repeat share a hash: they count once.
    chosen = known.join(F.broadcast(cuts), "lang").where(F.xxhash64("id", "lang", "text") <= F.col("cut")).select("id", "lang", F.lower("text").alias("text")).distinct()
    counted = chosen.select("lang", "text").mapInArrow(_slot_counts, "lang string, slot int, n double").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), 1 << TABLE_BITS))
    counts[np.searchsorted(langs, counted["lang"].to_numpy(str)), counted["slot"].to_numpy()] = counted["n"]
    return TextModel(langs, counts)


def suffix_of(host: Column) -> Column:
    """The part of a host name after its last dot, else the empty text."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def markup_language(html: Column) -> Column:
    """The two-letter language that a page's html element declares, else null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1))
    return F.when(found != "", found)


def identify(docs: DataFrame, id_col: str, text: Column, declared: Column, host: Column, model: TextModel | None = None) -> DataFrame:
    """(doc_id, language, confidence, text_language, kept) for every row."""
    spark = docs.sparkSession
    model = model or fit_text(docs, id_col, text, declared)
    names = [*model.langs, UNKNOWN]
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in flat.chunks(batch.column(1)):
                ll = held.value.score(chunk)
                best = np.where(ll.any(1), ll.argmax(1), -1)
                part = batch.slice(chunk.first, chunk.n_docs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(chunk.n_docs + 1) * ll.shape[1], pa.int32()), pa.array(ll.reshape(-1), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), lists, pa.array(best, pa.int32())], ["doc_id", "declared", "host", "ll", "best"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text.cast("string")).alias("text"), F.coalesce(declared, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"))
    scored = stage(rows.mapInArrow(run, "doc_id long, declared string, host string, ll array<double>, best int"), "scores").withColumn("suffix", suffix_of(F.col("host")))
    counts = [F.sum((F.col("best") == k).cast("long")).alias(f"n{k}") for k in range(len(names))]
    by_host = scored.groupBy("host", "suffix").agg(*counts)
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(len(names))]
    by_suffix = by_host.groupBy("suffix").agg(*sums)
    overall = by_suffix.agg(*sums).first()
    total = [overall[f"n{k}"] or 0 for k in range(len(names))]
    n_known = sum(total[:-1])
    base = [(total[k] + 1) / (n_known + len(names) - 1) * (1 - UNKNOWN_PRIOR) for k in range(len(names) - 1)] + [UNKNOWN_PRIOR]

    def smooth(own: str, above: list[Column]) -> list[Column]:
        n = sum((F.col(f"{own}.n{k}") for k in range(1, len(names))), F.col(f"{own}.n0"))
        return [(F.col(f"{own}.n{k}") + STRENGTH * above[k]) / (n + STRENGTH) for k in range(len(names))]

    prior = (
        by_host.alias("h")
        .join(by_suffix.alias("s"), F.col("h.suffix") == F.col("s.suffix"))
        .select(F.col("h.host").alias("host"), F.array(*smooth("h", smooth("s", [F.lit(p) for p in base]))).alias("prior"))
    )
    # P(declared | l): at most one row for each declared value and language.
    said = scored.where("declared <> '' and best >= 0").groupBy("declared").agg(*counts)
    column = said.agg(*sums).first()
    heard = [column[f"n{k}"] or 0 for k in range(len(names))]
    confusion = said.select("declared", F.array(*[(F.col(f"n{k}") + 0.5) / F.lit(heard[k] + 0.5 * (len(names) + 1)) for k in range(len(names))]).alias("says"))
    joined = scored.join(prior, "host", "left").join(confusion, "declared", "left")
    log = [F.log(F.col("prior")[k]) + F.coalesce(F.log(F.col("says")[k]), F.lit(0.0)) + F.col("ll")[k] for k in range(len(names))]
    fused = joined.select("doc_id", "best", F.array(*log).alias("log"), (F.exists("ll", lambda x: x != 0) | (F.col("declared") != "") | (F.col("host") != "")).alias("any"))
    fused = fused.withColumn("top", F.array_max("log")).withColumn("at", F.expr("array_position(log, top)").cast("int"))
    name = F.array(*map(F.lit, names))
    confidence = F.lit(1.0) / F.aggregate("log", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    language = F.when(F.col("any"), F.element_at(name, F.col("at"))).otherwise(UNKNOWN)
    text_language = F.when(F.col("best") >= 0, F.element_at(name, F.col("best") + 1))
    out = fused.select("doc_id", language.alias("language"), F.when(F.col("any"), confidence).otherwise(0.0).alias("confidence"), text_language.alias("text_language"))
    return out.withColumn("kept", (F.col("language") != UNKNOWN) & (F.col("confidence") >= MIN_POSTERIOR))


def identify_documents(docs: DataFrame) -> DataFrame:
    """For the documents table: ``lang`` is what the markup declares, ``source`` the host."""
    return identify(docs, "doc_id", F.col("text"), F.col("lang"), F.col("source"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """For the pages table: host and suffix come from the address, the declaration from the markup."""
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return identify(pages, "page_id", text, markup_language(F.col("html")), host_of(F.col("url")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op1_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw pages, which alone have markup and address suffixes."""
    return identify_pages(table(spark, sf_dir, "pages")).withColumnRenamed("doc_id", "page_id")
