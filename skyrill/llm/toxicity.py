"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its byte n-grams (with its borders, and
the word itself), a document the mean of its words, and a softmax over two
classes reads the document; a misspelling or another ending shares most n-grams
with the word it hides, so it lies near it. In the mean a word counts by the
logarithm of its occurrences, words repeated at once count as one, and ``PAD``
words without a meaning are added, so that neither spam nor a few words decide.

Training rows: labelled rows that are not held out, about ``SAMPLE_ROWS`` of each
class at most and fewer of a class where its whole texts are over its share of ``SAMPLE_BYTES``, by a
threshold on a hash of the id and never by length. Only n-grams whose mean
density differs between the classes by some standard errors get an embedding
(``SCREENS``, ``FEATURES`` at most); embeddings and softmax are trained together
(Adam) until a fifth of the training rows, set apart, no longer gains, and the
screen that does best on that fifth is kept. The bias is moved from the sample's
share of toxic rows to that of all training rows. Only the text is an input of a score.

Defined results: a null or empty text has the score of a mean without evidence;
texts of any length are read whole; held out are rows whose crc32 of the doc_id
as text leaves 1 modulo 3; rows repeat as given; labels that disagree on a
doc_id count as toxic; with no labelled rows of both classes the scores are
0.5; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .shared import bounded_sample, scratch, stage, table

SAMPLE_ROWS = 2500
SAMPLE_BYTES = 64 << 20
GRAMS = (3, 4, 5)
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
PAD = 60.0
#: Documents of the sample that must hold an n-gram.
MIN_DOCUMENTS = 4
#: Standard errors of a difference of means from which an n-gram gets an embedding, tried in turn.
SCREENS = (4.0, 2.5)
FEATURES = 4096
DIMENSIONS = 8
STEPS = 250
PATIENCE = 20
LEARNING_RATE = 0.02
DECAY = 1e-2
PREDICT_AT = 0.7
SEED = 7
OUT = "doc_id long, held_out boolean, score double, predicted int"

_U = np.uint64


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def _bucket(h: np.ndarray) -> np.ndarray:
    return (flat.mix(h) >> _U(64 - BUCKET_BITS)).astype(np.int32)


def word_grams(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of words given as byte ranges, borders marked by 60 and 62; a word is its own n-gram too."""
    size = end - start + 2
    stop = np.cumsum(size)
    begin = stop - size
    place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(begin, size)
    word = np.repeat(np.arange(len(start), dtype=np.int32), size)
    source = np.clip(np.repeat(start, size) + place - 1, 0, max(len(buf) - 1, 0))
    wide = np.where(place == 0, 60, buf[source]).astype(np.uint8) if len(buf) else np.zeros(0, np.uint8)
    wide[stop - 1] = 62
    words, hashes = [], []
    for n in GRAMS:
        code = np.zeros(max(len(wide) - n + 1, 0), _U)
        for k in range(n):
            code = code * _U(0x9E3779B97F4A7C15) + (wide[k : k + len(code)].astype(_U) + _U(n))
        ok = place[: len(code)] + n <= size[word[: len(code)]]
        words.append(word[: len(code)][ok])
        hashes.append(_bucket(code[ok]))
    words.append(np.arange(len(start), dtype=np.int32))
    hashes.append(_bucket(flat.span_hash(wide, begin, stop)))
    return np.concatenate(words), np.concatenate(hashes)


class Bag:
    """Words of some documents: a number for each distinct word, its n-grams, and the weight of each word in each document's mean."""

    def __init__(self, chunks: Iterator[flat.Chunk]):
        numbers: dict[int, int] = {}
        doc, word, weight, gram_word, gram = [], [], [], [], []
        self.n_docs = 0
        for chunk in chunks:
            w = flat.words(chunk)
            fresh = np.flatnonzero((np.diff(w.hash, prepend=_U(0)) != 0) | (np.diff(w.doc, prepend=-1) != 0))
            h, d = w.hash[fresh], w.doc[fresh]
            order = np.lexsort((h, d))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
            first = np.flatnonzero(new)
            count = np.log2(1.0 + np.diff(first, append=len(order)))
            at = order[first]
            total = np.bincount(d[at], weights=count, minlength=chunk.n_docs) + PAD
            distinct, where, number = np.unique(h[at], return_index=True, return_inverse=True)
            unknown = np.array([x not in numbers for x in distinct.tolist()], bool)
            for x in distinct[unknown].tolist():
                numbers[x] = len(numbers)
            place = fresh[at[where[unknown]]]
            g_word, g = word_grams(chunk.buf, w.start[place], w.end[place])
            gram_word.append(g_word + (len(numbers) - len(place)))
            gram.append(g)
            doc.append(d[at] + self.n_docs)
            word.append(np.array([numbers[x] for x in distinct.tolist()], np.int64)[number])
            weight.append(count / total[d[at]])
            self.n_docs += chunk.n_docs
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.doc, self.word, self.weight = join(doc, np.int64), join(word, np.int64), join(weight, float)
        self.gram_word, self.gram, self.n_words = join(gram_word, np.int64), join(gram, np.int64), len(numbers)
        order = np.argsort(self.gram_word, kind="stable")
        self.gram_word, self.gram = self.gram_word[order], self.gram[order]
        self.gram_count = np.maximum(np.bincount(self.gram_word, minlength=self.n_words), 1)

    def mean(self, gram_score: np.ndarray) -> np.ndarray:
        """Each document's mean of a score of buckets."""
        by_word = np.bincount(self.gram_word, weights=gram_score[self.gram], minlength=self.n_words) / self.gram_count
        return np.bincount(self.doc, weights=self.weight * by_word[self.word], minlength=self.n_docs)

    def densities(self, wanted: np.ndarray, docs: int = 50) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, bucket, weight of the bucket in the document's mean) of wanted buckets, some documents at a time."""
        keep = wanted[self.gram]
        word, gram = self.gram_word[keep], self.gram[keep]
        border = np.searchsorted(word, np.arange(self.n_words + 1))
        edge = np.searchsorted(self.doc, np.arange(0, self.n_docs + docs, docs))
        for lo, hi in zip(edge[:-1], edge[1:]):
            w = self.word[lo:hi]
            n = border[w + 1] - border[w]
            place = np.repeat(border[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key, at = np.unique(np.repeat(self.doc[lo:hi], n) * BUCKETS + gram[place], return_inverse=True)
            yield key // BUCKETS, key % BUCKETS, np.bincount(at, weights=np.repeat(self.weight[lo:hi] / self.gram_count[w], n), minlength=len(key))


class Model:
    """Logit of each n-gram bucket and the bias: all that scoring needs of embeddings and softmax."""

    def __init__(self, gram_score: np.ndarray, bias: float):
        self.gram_score, self.bias = gram_score.astype(np.float32), float(bias)

    def score(self, chunk: flat.Chunk) -> np.ndarray:
        return _sigmoid(self.bias + Bag(iter([chunk])).mean(self.gram_score))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def separation(bag: Bag, y: np.ndarray, fitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket by how many standard errors its mean density is higher in toxic documents, and its deviation over all."""
    n = np.array([(fitted & (y == k)).sum() for k in (0, 1)], float)[:, None]
    held, total, square = np.zeros((3, 2, BUCKETS))
    for doc, bucket, value in bag.densities(np.ones(BUCKETS, bool)):
        for k in (0, 1):
            of = fitted[doc] & (y[doc] == k)
            held[k] += np.bincount(bucket[of], minlength=BUCKETS)
            total[k] += np.bincount(bucket[of], weights=value[of], minlength=BUCKETS)
            square[k] += np.bincount(bucket[of], weights=value[of] ** 2, minlength=BUCKETS)
    mean, spread = total / n, np.maximum(square / n - (total / n) ** 2, 0)
    pooled = np.maximum(square.sum(0) / n.sum() - (total.sum(0) / n.sum()) ** 2, 0)
    error = np.sqrt(np.maximum(spread[1], pooled) / n[1] + spread[0] / n[0] + 1e-18)
    return np.where(held.sum(0) >= MIN_DOCUMENTS, (mean[1] - mean[0]) / error, 0.0), np.sqrt(pooled)


def train(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Fit embeddings and softmax jointly on labelled texts; ``share`` is that of toxic rows where the model will be used."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    bag, y = Bag(flat.chunks(pa.array(texts, pa.large_string()))), np.array(labels, float)
    rng = np.random.Generator(np.random.PCG64(SEED))
    fitted = rng.random(len(y)) >= 0.2
    for k in (0, 1):  # a class of few rows is in both parts where it can be
        of = np.flatnonzero(y == k)
        fitted[of[0]], fitted[of[1:2]] = True, False
    out = rng.normal(0, 0.5, (DIMENSIONS, 2))
    apart, deviation = separation(bag, y, fitted)
    best, kept = np.inf, Model(np.zeros(BUCKETS), 0.0)
    for screen in SCREENS:
        chosen = np.flatnonzero(apart >= screen)
        chosen = np.sort(chosen[np.argsort(-apart[chosen], kind="stable")[:FEATURES]])
        column = np.full(BUCKETS, -1)
        column[chosen] = np.arange(len(chosen))
        x = np.zeros((bag.n_docs, len(chosen)), np.float32)
        for doc, bucket, value in bag.densities(column >= 0):
            x[doc, column[bucket]] = value / deviation[bucket]
        loss, score, bias = _fit(x, y, fitted, out)
        if loss < best:
            best, kept = loss, Model(np.zeros(BUCKETS), bias)
            kept.gram_score[chosen] = score / deviation[chosen]
    if share is not None and 0 < share < 1:
        kept.bias += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return kept


def _fit(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, out: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Least loss on the rows set apart, with each feature's logit and the bias there, for embeddings that start at zero."""
    rate = y[fitted].mean()
    params = [np.zeros((x.shape[1], DIMENSIONS)), out, np.array([0.0, np.log(rate / (1 - rate))])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    best, stale = (np.inf, np.zeros(x.shape[1]), 0.0), 0
    apart = ~fitted if not fitted.all() else fitted
    for step in range(1, STEPS + 1):
        table_, out, b2 = params
        u, b = out[:, 1] - out[:, 0], float(b2[1] - b2[0])
        score = table_ @ u
        p = _sigmoid(b + x @ score.astype(np.float32))
        loss = -np.mean(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1))[apart])
        stale += 1
        if loss < best[0] - 1e-4:
            best, stale = (loss, score, b), 0
        if stale >= PATIENCE:
            break
        error = fitted * (p - y) / fitted.sum()
        by_feature = (error.astype(np.float32) @ x).astype(float)
        du, db = table_.T @ by_feature, error.sum()
        grads = [np.outer(by_feature, u) + DECAY * table_, np.stack([-du, du], 1) + DECAY * out, np.array([-db, db])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - LEARNING_RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return best


def bounded_by_bytes(sample: DataFrame) -> DataFrame:
    """All rows (doc_id, text, toxic) if their texts are ``SAMPLE_BYTES`` at most, else the rows of small hash of each class that is over its share.

    A class has half of the bytes, and what the other leaves; a class within its share stays whole, and one row of each class stays in any case.
    """
    h = F.xxhash64("doc_id", F.lit(1))
    known = sample.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(h).alias("least")).collect()
    total = sum(r.bytes or 0 for r in known)
    if total <= SAMPLE_BYTES:
        return sample
    kept = F.lit(False)
    for r in known:
        size = r.bytes or 0
        share = max(SAMPLE_BYTES // 2, SAMPLE_BYTES - (total - size))
        mine = F.lit(True) if size <= share else (h < int(share / size * 2**64) - 2**63) | (h == r.least)
        kept = kept | ((F.col("toxic") == r.toxic) & mine)
    return sample.where(kept)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Train on about ``rows`` labelled rows at most of each class that are not held out."""
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    # The bounded choice is made on narrow rows; its ids then pick the texts.
    chosen = [bounded_sample(known.where(F.col("toxic") == k), rows, "doc_id") for k in (0, 1)]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        model = train(frame["text"].fillna("").tolist(), frame["toxic"].tolist(), share)
        return pd.DataFrame({"gram_score": [model.gram_score.tolist()], "bias": [model.bias]})

    with scratch(docs.sparkSession):
        sample = bounded_by_bytes(stage(texts.join(picked, "doc_id"), "labelled"))
        # The sample is bounded, so one task holds it; the driver receives the model only.
        rows_ = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "gram_score array<float>, bias double").collect()
    if not rows_:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.array(rows_[0].gram_score), rows_[0].bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in flat.chunks(batch.column(1)):
                ids = batch.column(0).slice(chunk.first, chunk.n_docs)
                s = held.value.score(chunk)
                out = [held_out(i) for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= PREDICT_AT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(run, OUT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
