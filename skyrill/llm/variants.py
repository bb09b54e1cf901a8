"""Spelling variants: words one edit apart, found by shared keys and never as pairs.

Words are counted over whole texts: a kernel counts the runs of some documents
at a time, so a very frequent word costs a row for each such block and no more.

Each word then gives three kinds of keys. A wildcard key is the word with one
position blanked: words that share one differ by a replacement there. A group of
a key keeps its size and its two best words, so each member knows its number of
partners (the size less itself) and the best of them (the first, or the second
if it is the first). A deletion key is the word without one letter; it meets the
word that it spells, which gives one partner to each side and the best of the
longer words to the shorter. All keys go through one shuffle; no pair of words
is ever a row. A group of a key has at most as many members as letters could
stand in that place, whatever the corpus.

Forms are followed to their last by pointer doubling; as a form has at least
twice its word's count, a chain is no longer than the logarithm of the largest.

Defined results: a null or empty text has no runs; a null id counts as an empty
one; repeated rows count each time; a run of any length is read whole; words
without a near word have n_near 0, no form, and are their own root; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch, stage, table

#: Shortest word in letters, least count of a word, how much more frequent a form is, and of how many runs one loses a letter.
MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2
DAMAGE = 97
#: Stands for the blanked letter; no word holds it.
WILD = "*"

#: Runs of ASCII letters and of U+00C0 to U+00FF in UTF-8, after ASCII letters were lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words that a task counts before it hands them on.
_BLOCK_WORDS = 200_000


def _count_into(counts: Counter, doc_id: bytes, text: bytes, damage: int) -> None:
    """Add a text's words; a run whose checksum ``damage`` divides loses one letter."""
    start = zlib.crc32(doc_id + b":")
    for run, n in Counter(_RUN.findall(text.lower())).items():
        if damage and (h := zlib.crc32(run, start)) % damage == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        counts[run] += n


def count_words(docs: DataFrame, damage: int = DAMAGE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``min_length`` letters and ``min_count`` occurrences; ``damage`` 0 leaves runs whole."""

    def hand_on(counts: Counter) -> pa.RecordBatch:
        known = [(w, n) for b, n in counts.items() if len(w := b.decode()) >= min_length]
        words, ns = zip(*known) if known else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if (value := text.as_py()) is not None:
                    _count_into(counts, (doc_id.as_py() or "").encode(), value, damage)
                if len(counts) > _BLOCK_WORDS:
                    yield hand_on(counts)
                    counts.clear()
        yield hand_on(counts)

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    blocks = rows.mapInArrow(run, "word string, n long")
    return blocks.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column) -> Column:
    """Array of (kind, key): ``r`` the wildcards, ``d`` the distinct deletions, ``w`` the word itself."""
    places = F.sequence(F.lit(1), F.char_length(word))
    head = lambda i: F.substring(word, F.lit(1), i - 1)
    tail = lambda i: F.substring(word, i + 1, F.char_length(word))
    key = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    wild = F.transform(places, lambda i: key("r", F.concat(head(i), F.lit(WILD), tail(i))))
    less = F.transform(F.array_distinct(F.transform(places, lambda i: F.concat(head(i), tail(i)))), lambda x: key("d", x))
    return F.concat(wild, less, F.array(key("w", word)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best_n, best) of each row (word, n), words distinct: its near words' number, and the best with its count.

    The best is the most frequent one, among equals the first in code-point order.
    """
    rows = words.select("word", "n", F.explode(_keys(F.col("word"))).alias("k")).select("word", "n", "k.kind", "k.key")
    # Order of being best: large counts first, then words upwards.
    rows = rows.withColumn("rank", F.struct((-F.col("n")).alias("minus"), "word"))
    group = Window.partitionBy("key")
    kind = F.col("kind")
    rows = rows.withColumns(
        {
            "size": F.count(F.when(kind != "w", 1)).over(group),
            "first": F.min(F.when(kind != "w", F.col("rank"))).over(group),
            "spelled": F.min(F.when(kind == "w", F.col("rank"))).over(group),
        }
    ).where("case kind when 'r' then size > 1 when 'd' then spelled is not null else size > 0 end")
    rows = rows.withColumn("second", F.min(F.when((kind == "r") & (F.col("rank") != F.col("first")), F.col("rank"))).over(group))
    given = (
        F.when(kind == "r", F.struct((F.col("size") - 1).alias("near"), F.when(F.col("rank") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best")))
        .when(kind == "w", F.struct(F.col("size").alias("near"), F.col("first").alias("best")))
        .otherwise(F.struct(F.lit(1).cast("long").alias("near"), F.col("spelled").alias("best")))
    )
    found = rows.select("word", given.alias("g")).groupBy("word").agg(F.sum("g.near").alias("n_near"), F.min("g.best").alias("best"))
    joined = words.join(found, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.minus")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all rows (word, form), each word once, no cycles: forms followed to a word that has none.

    Pointers double in each round; words that have arrived take no further part.
    """
    open_words = stage(forms.select("word", F.col("form").alias("root")), "roots")
    known = open_words
    arrived = None
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage(open_words.join(ahead, "root", "left").select("word", "root", "next"), "roots")
        done = step.where("next is null").select("word", "root")
        arrived = done if arrived is None else arrived.union(done)
        open_words = step.where("next is not null").select("word", F.col("next").alias("root"))
        if open_words.isEmpty():
            return arrived
        # Words that have arrived keep their pointer; the others' reaches twice as far.
        known = arrived.union(open_words)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row (word, n): a word's form is its best near word if that has ``ratio`` times its count."""
    spark = words.sparkSession
    with scratch(spark):
        near = stage(near_words(stage(words, "words")), "near")
        good = F.col("best_n") >= ratio * F.col("n")
        near = near.select("word", F.when(good, F.col("best")).alias("form"), "n", "n_near", F.when(good, F.col("best_n")).alias("form_n"))
        last = roots(near.where("form is not null").select("word", "form"))
        out = near.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return stage(out.select("word", "form", "root", "n", "n_near", "form_n"), "variants", keep=True)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(table(spark, sf_dir, "documents")))
