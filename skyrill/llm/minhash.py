"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds its distinct shingles of five lower-cased words (the
whole sequence where there are fewer). Documents with equal sets form one
class, represented by its smallest id. One hash per shingle assigns it to a
bin and ranks it there; each bin keeps its smallest value, and an empty bin
copies the bin that its own random probe sequence meets first (optimal
densification), so each bin agrees with probability equal to the similarity.
``BANDS`` bands of ``ROWS`` bins are the bucket keys of a class: at the
threshold 0.75 a pair shares no bucket with probability (1 - 0.75**6)**64, below
4e-6. Candidate edges are stars (see ``graph.resolve``) and every link is
confirmed on the full sets: 100 * intersection >= 75 * union.

Defined results: a null or empty text, or one without words, has the empty set
and is linked with nothing; a text of any length gives its whole set, in one task's memory; rows with one doc_id are one document, whose
texts' links are joined; repeated rows repeat; an empty table gives an empty
table; columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flat
from .graph import resolve
from .shared import scratch, stage, table

SHINGLE_WORDS = 5
BANDS = 64
ROWS = 6
BINS = BANDS * ROWS
THRESHOLD_PERCENT = 75
#: Longs of parity bits that describe a set: bit k tells whether an odd number of its shingles hash to k.
PARITY_LONGS = 16
PARITY = tuple(f"p{k}" for k in range(PARITY_LONGS))

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_rng = np.random.Generator(np.random.PCG64(20240501))
_BAND_KEY = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | _U(1)
_PROBES = [_rng.integers(0, BINS, BINS) for _ in range(64)]


def shingles(chunk: flat.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle of a chunk, ordered by document and hash."""
    w = flat.words(chunk, lower=True)
    n_words = np.bincount(w.doc, minlength=chunk.n_docs)
    full = flat.window_hash(w.hash, SHINGLE_WORDS)
    n = len(full)
    at = np.flatnonzero(w.doc[:n] == w.doc[SHINGLE_WORDS - 1 :])
    doc, h = w.doc[at], full[at]
    first = np.cumsum(n_words) - n_words
    for size in range(1, SHINGLE_WORDS):
        short = np.flatnonzero(n_words == size)
        if len(short):
            value = np.full(len(short), size, _U)
            for k in range(size):
                value = flat.mix(value * _U(0xA0761D6478BD642F) + w.hash[first[short] + k])
            doc, h = np.concatenate([doc, short]), np.concatenate([h, value])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, BINS) minima by one permutation, densified; rows of empty sets are meaningless."""
    value = flat.mix(h ^ _U(0x2545F4914F6CDD1D))
    bin_ = ((value >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    least = np.full(n_docs * BINS, _EMPTY, _U)
    np.minimum.at(least, doc * BINS + bin_, flat.mix(value))
    least = least.reshape(n_docs, BINS)
    out = least.copy()
    row, col = np.nonzero(least == _EMPTY)
    has = np.bincount(doc, minlength=n_docs) > 0
    keep = has[row]
    row, col = row[keep], col[keep]
    step = 0
    while len(row):
        probe = _PROBES[step] if step < len(_PROBES) else np.random.Generator(np.random.PCG64(step)).integers(0, BINS, BINS)
        got = least[row, probe[col]]
        hit = got != _EMPTY
        out[row[hit], col[hit]] = got[hit]
        row, col = row[~hit], col[~hit]
        step += 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) bucket keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], _U)
    for r in range(ROWS):
        key = flat.mix(key + parts[:, :, r] * _U(0x9E3779B97F4A7C15))
    return flat.mix(key ^ _BAND_KEY)


def parity(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, PARITY_LONGS) parity bits: two sets differ in at least as many shingles as their bits differ."""
    place = (flat.mix(h ^ _U(0x8CB92BA72F3D8DD7)) >> _U(32)) * _U(64 * PARITY_LONGS) >> _U(32)
    out = np.zeros((n_docs, PARITY_LONGS), _U)
    np.bitwise_xor.at(out, (doc, (place >> _U(6)).astype(np.int64)), _U(1) << (place & _U(63)))
    return out.view(np.int64)


def may_link() -> str:
    """SQL over size and parity bits of two sets that holds for every link.

    A link has 100 * i >= T * u; with the sizes n, nx and the difference
    d = u - i that is d * (100 + T) <= (100 - T) * (n + nx), and bits differ in d places at most.
    """
    differ = " + ".join(f"bit_count({p} ^ {p}x)" for p in PARITY)
    t = THRESHOLD_PERCENT
    return f"100 * least(n, nx) >= {t} * greatest(n, nx) and {100 + t} * ({differ}) <= {100 - t} * (n + nx)"


def _lists(values: np.ndarray, border: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in flat.chunks(batch.column(1)):
            doc, h = shingles(chunk)
            n = np.bincount(doc, minlength=chunk.n_docs)
            border = np.concatenate([[0], np.cumsum(n)])
            keys = band_keys(signatures(doc, h, chunk.n_docs))
            digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(border[:-1], border[1:])]
            full = np.repeat(n > 0, BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(chunk.first, chunk.n_docs),
                    pa.array(n.astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    _lists(keys.reshape(-1)[full], np.concatenate([[0], np.cumsum((n > 0) * BANDS)])),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in flat.chunks(batch.column(1)):
            doc, h = shingles(chunk)
            border = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=chunk.n_docs))])
            facts = [pa.array(x) for x in parity(doc, h, chunk.n_docs).T]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.n_docs), _lists(h, border), *facts], ["node", "items", *PARITY])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document."""
    with scratch(docs.sparkSession):
        return stage(_near_duplicates(docs, id_col, text_col), "near", keep=True)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = stage(texts.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, bands array<long>"), "sketch")
    classes = stage(sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # One row of each class carries its bands on.
    reps = sketch.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    rows = reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("c"), F.max("node").alias("top")).where("c <> top").select("bucket", "c")
    members = stage(rows.join(shared, "bucket").select("bucket", "node", "c").distinct(), "shared")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = stage(texts.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets, f"node long, items array<long>, {', '.join(f'{p} long' for p in PARITY)}"), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
            .where(100 * F.least(F.size("x"), F.size("y")) >= THRESHOLD_PERCENT * F.greatest(F.size("x"), F.size("y")))
            .select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
        )
        return both.where(100 * F.col("i") >= THRESHOLD_PERCENT * (F.col("n") - F.col("i"))).select("a", "b").distinct()

    facts = sets.select("node", F.size("items").alias("n"), *PARITY)
    labels = resolve(members, verify, facts, may_link())
    component = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    return (
        sketch.select("doc_id", "n_shingles", "digest")
        .join(component, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"), F.coalesce("label", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
