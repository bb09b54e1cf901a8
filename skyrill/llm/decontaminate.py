"""Benchmark decontamination: a BM25 index of test items queried by every training passage.

Items are cut into parts of at most ``PART_WORDS`` words; a part is one entry
of an inverted index whose impacts are BM25 weights divided by the part's own
total, so a score is the covered share of the part's weight and one threshold
fits all. Every document is read as overlapping passages of
``2 * PART_WORDS`` words, so each run of ``PART_WORDS`` words lies whole in one.

Retrieval is block-max WAND over a batch of passages: the sum of each term's
largest impact bounds a passage, the sum of its largest impact within a block
of parts bounds a passage and a block, and only pairs of passage and block
whose bound reaches the threshold are scored. All parts at or above the
threshold are retrieved; bounds never cut a pair that could reach it.

A retrieved item is verified on the document's exact word sequence: its
question (all sentences but the last) and its answer (the last sentence) must
each have at least ``OVERLAP_PERCENT`` of their runs of five words (one run of
all its words where it has fewer) in the document.

Document frequencies, the number of parts and their mean length are counted
over the whole benchmark by grouped aggregation, so a score does not depend on
the items that share an index. An index holds at most ``INDEX_BYTES`` of item
text, and indexes of at most ``SHARD_BYTES`` together are broadcast, which that
size bounds; a larger benchmark takes more passes over the documents, one for
each shard, each pass written before the next broadcast.

Defined results: a null or empty text or item matches nothing; a text of any
length is read whole, passage after passage; repeated rows
repeat; equal items match alike; empty tables give an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import free_name, scratch, stage, table

PART_WORDS = 64
THRESHOLD = 0.6
OVERLAP_PERCENT = 60
RUN_WORDS = 5
BLOCK_PARTS = 8
#: Rows of passages and terms whose bounds are held at once.
LOOKUP_ROWS = 50_000
K1, B = 1.2, 0.75
#: Item text of one index, and of the indexes that are broadcast together.
INDEX_BYTES = 64 << 10
SHARD_BYTES = 4 << 20
OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

_WORD = np.ones(256, bool)
_WORD[:128] = False
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_U = np.uint64


def word_spans(chunk: flat.Chunk) -> flat.Spans:
    """Runs of ASCII letters, digits and non-ASCII bytes; texts come lower-cased."""
    buf = chunk.buf
    return flat.spans(buf, chunk.offsets, ~_WORD[buf])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in flat.chunks(pa.array(texts, pa.string())):
        w = word_spans(chunk)
        out += np.split(w.hash, np.searchsorted(w.doc, np.arange(1, chunk.n_docs)))
    return out


def runs(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Width of the runs of a part (five words, or all where it has fewer) and their distinct hashes."""
    width = min(RUN_WORDS, len(h))
    return width, np.unique(flat.window_hash(h, width)) if width else h


def _cut_parts(h: np.ndarray) -> list[np.ndarray]:
    return [h[at : at + PART_WORDS] for at in range(0, len(h), PART_WORDS)]


@dataclass
class Item:
    """A test item with its terms and the number of parts of the whole benchmark that hold each."""

    id: int
    text: str
    terms: np.ndarray
    held_by: np.ndarray


class Index:
    """Inverted index of some items with per-term and per-block largest impacts; ``n_parts`` and ``mean_words`` are those of the whole benchmark."""

    def __init__(self, items: list[Item], n_parts: int, mean_words: float):
        self.items = [x.id for x in items]
        halves = [_question_answer(x.text) for x in items]
        words = _hashes([x.text for x in items])
        # Parts of like length share a block: short ones have large impacts, which would loosen other bounds.
        self.question, self.answer = ([runs(h) for h in _hashes([x[k] for x in halves])] for k in (0, 1))
        parts: list[np.ndarray] = []
        self.part_item: list[int] = []
        for k, h in enumerate(words):
            cut = _cut_parts(h)
            parts += cut
            self.part_item += [k] * len(cut)
        by_length = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        parts = [parts[k] for k in by_length]
        self.part_item = np.array([self.part_item[k] for k in by_length], np.int64)
        self.terms, first = np.unique(np.concatenate([x.terms for x in items]), return_index=True)
        held_by = np.concatenate([x.held_by for x in items])[first].astype(float)
        idf = np.log1p((n_parts - held_by + 0.5) / (held_by + 0.5))
        posting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, p in enumerate(parts):
            t, tf = np.unique(p, return_counts=True)
            t = np.searchsorted(self.terms, t)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(p) / mean_words))
            posting.append((t, np.full(len(t), k), impact / impact.sum()))
        term, part, impact = (np.concatenate([x[i] for x in posting]) if posting else np.zeros(0) for i in range(3))
        order = np.lexsort((part, term))
        self.part, self.impact = part[order].astype(np.int64), impact[order]
        self.border = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.top = np.array([self.impact[a:b].max() for a, b in zip(self.border, self.border[1:])])
        n_blocks = -(-len(parts) // BLOCK_PARTS)
        self.block_top = np.zeros((len(self.terms), n_blocks), np.float32)
        np.maximum.at(self.block_top, (term[order].astype(np.int64), self.part // BLOCK_PARTS), self.impact * (1 + 1e-6))
        # A small table of hash bits tells most words that no item has.
        self.filter = np.zeros(1 << 18, bool)
        self.filter[(self.terms >> _U(46)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that some item has, and their term numbers."""
        at = np.flatnonzero(self.filter[(h >> _U(46)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        hit = self.terms[slot] == h[at]
        return at[hit], slot[hit]

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, part, score) of all scores at or above the threshold, from pairs of passage and term that are distinct and ordered by passage."""
        enough = THRESHOLD - 1e-4
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        if not len(first):
            return
        size = np.diff(first, append=len(passage))
        fair = np.repeat(np.add.reduceat(self.top[term], first) >= enough, size)
        passage, term = passage[fair], term[fair]
        for at in range(0, len(term), LOOKUP_ROWS):  # whole passages: a cut one is completed from the next rows
            lo, hi = np.searchsorted(passage, (passage[at], passage[min(at + LOOKUP_ROWS, len(term)) - 1] + 1))
            if at and passage[at] == passage[at - 1]:
                lo = np.searchsorted(passage, passage[at] + 1)
            if lo < hi:
                yield from self._score(passage[lo:hi], term[lo:hi], enough)

    def _score(self, passage: np.ndarray, term: np.ndarray, enough: float) -> Iterator[tuple[int, int, float]]:
        first = np.flatnonzero(np.diff(passage, prepend=-1))
        row = np.repeat(np.arange(len(first)), np.diff(first, append=len(passage)))
        open_ = np.add.reduceat(self.block_top[term], first, axis=0) >= enough
        live = open_.any(1)[row]
        row_, term = row[live], term[live]
        n = self.border[term + 1] - self.border[term]
        place = np.repeat(self.border[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row_ = np.repeat(row_, n)
        part = self.part[place]
        keep = open_[row_, part // BLOCK_PARTS]
        row_, part, place = row_[keep], part[keep], place[keep]
        key, at = np.unique(row_ * len(self.part_item) + part, return_inverse=True)
        score = np.bincount(at, weights=self.impact[place], minlength=len(key))
        for k in np.flatnonzero(score >= THRESHOLD - 1e-9).tolist():
            r, part = divmod(int(key[k]), len(self.part_item))
            yield int(passage[first[r]]), part, float(score[k])

    def scan(self, chunk: flat.Chunk, w: flat.Spans) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, best score, question overlap, answer overlap) of every verified item."""
        at, term = self.lookup(w.hash)
        if not len(at):
            return
        first = np.searchsorted(w.doc, np.arange(chunk.n_docs + 1))
        best: dict[tuple[int, int], float] = {}
        n_words = np.diff(first)
        n_pass = np.maximum(1, -(-(n_words - PART_WORDS) // PART_WORDS))
        doc = np.repeat(np.arange(chunk.n_docs), n_pass)
        start = np.cumsum(n_pass) - n_pass
        # A word of the k-th run of PART_WORDS words belongs to the passages k - 1 and k.
        d = w.doc[at]
        k = (at - first[d]) // PART_WORDS
        pair = np.concatenate([(start[d] + k)[k < n_pass[d]] * len(self.terms) + term[k < n_pass[d]], (start[d] + k - 1)[k > 0] * len(self.terms) + term[k > 0]])
        pair = np.unique(pair)
        for p, part, score in self.retrieve(pair // len(self.terms), pair % len(self.terms)):
            key = (int(doc[p]), int(self.part_item[part]))
            best[key] = max(best.get(key, 0.0), score)
        seen: dict[tuple[int, int], np.ndarray] = {}
        for (d, item), score in sorted(best.items()):
            h = w.hash[first[d] : first[d + 1]]
            q, a = (_overlap(x[item], h, d, seen) for x in (self.question, self.answer))
            if 100 * q >= OVERLAP_PERCENT and 100 * a >= OVERLAP_PERCENT:
                yield d, self.items[item], score, q, a


def _overlap(part: tuple[int, np.ndarray], h: np.ndarray, d: int, seen: dict) -> float:
    """Share of a part's runs in a document. A part without words is no obstacle."""
    width, run = part
    if not width:
        return 1.0
    if (d, width) not in seen:
        seen[d, width] = flat.window_hash(h, width)
    return float(np.isin(run, seen[d, width]).mean())


def _question_answer(text: str | None) -> tuple[str, str]:
    """All sentences but the last, and the last; an item of one sentence is cut in the middle of its words."""
    sentences = [s for s in regex.split(r"(?<=[.!?])\s+", (text or "").strip()) if regex.search(r"\w", s)]
    if len(sentences) > 1:
        return " ".join(sentences[:-1]), sentences[-1]
    words = (text or "").split()
    return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])


def _cut(items: Iterator[Item], limit: int) -> Iterator[list[Item]]:
    """Items in lists of at most ``limit`` bytes of text (a longer item is alone)."""
    held, size = [], 0
    for item in items:
        n = len(item.text.encode())
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(item)
        size += n
    if held:
        yield held


def _item_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part of a text: the text's key, the part's number of words and its distinct terms."""
    for batch in batches:
        rows = [(key, len(p), np.unique(p).view(np.int64)) for key, h in zip(batch.column(0).to_pylist(), _hashes(batch.column(1).to_pylist())) for p in _cut_parts(h)]
        if rows:
            key, n, terms = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["key", "words", "terms"])


def _shards(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes in shards of bounded size; the driver holds one shard at a time."""
    keyed = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    parts = stage(keyed.select("key", "text").mapInArrow(_item_parts, "key long, words long, terms array<long>"), "parts")
    total = parts.agg(F.count(F.lit(1)).alias("n"), F.avg("words").alias("mean")).first()
    terms = parts.select("key", F.explode("terms").alias("term"))
    # Equal items share a key and count as often as they occur.
    held_by = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by_text = terms.distinct().join(held_by, "term").groupBy("key").agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    rows = stage(keyed.join(by_text, "key").select("item_id", "text", "terms"), "items")

    def read() -> Iterator[Item]:
        for r in rows.toLocalIterator():
            term = np.array([x.term for x in r.terms], np.int64).view(_U)
            yield Item(r.item_id, r.text, term, np.array([x.n for x in r.terms], np.int64))

    for shard in _cut(read(), SHARD_BYTES):
        yield [Index(part, total.n, total.mean) for part in _cut(iter(shard), INDEX_BYTES)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every contaminated document and its item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    found = spark.createDataFrame([], OUT)
    with scratch(spark):
        for shard in _shards(items):
            held = spark.sparkContext.broadcast(shard)

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for chunk in flat.chunks(batch.column(1)):
                        words = word_spans(chunk)
                        rows = [x for index in held.value for x in index.scan(chunk, words)]
                        if rows:
                            d, item, *rest = zip(*rows)
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(pa.array([chunk.first + x for x in d])), pa.array(item, pa.int64()), *(pa.array(x, pa.float64()) for x in rest)],
                                ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                            )

            found = found.union(stage(texts.mapInArrow(run, OUT), "matches", keep=True))
            held.destroy()
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    key = free_name("id", docs)
    bad = matches(docs, benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(key), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
