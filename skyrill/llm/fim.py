"""Fill-in-middle: each text is cut in three at two units drawn from its id, and the parts are put in another order.

Units are told by a predicate on adjacent bytes: a code point, a word or a line
begins where it holds. Each text is cut into chunks that overlap by one byte, so
the predicate can be asked at a chunk's first byte as well. All chunks of an
Arrow batch are counted at once; prefix sums of the counts give the number of
units and route each cut's rank to the chunk that owns it, and only that chunk
is scanned again for the byte at which the cut lies. Python returns five numbers
for each text; parts are sliced and joined as bytes by column expressions.

The three forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle)
and ``spm`` (suffix, prefix, middle). Texts with a mark of their own stay plain,
so the marks of an output are exactly those that were put in.

Defined results: a null or empty text has no units, is plain, and its output is
empty; a null id draws as an empty one; equal ids draw equal numbers; texts of
any length are read whole, one Arrow batch in memory; an empty table gives an
empty one; other columns are kept by ``fill_in_middle`` unless they have the
name of a column that it adds, which is an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The marks before the parts, shares of plain and of suffix-first forms in a hundred, and the seed.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE = 10
SPM_SHARE = 20
SEED = 1
CHUNK_BYTES = 1 << 12

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Whether a unit begins at a byte, from the byte before it and the byte itself; a text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "code_point": lambda before, here: (here & 0xC0) != 0x80,
    "word": lambda before, here: _BLANK[before] & ~_BLANK[here],
    "line": lambda before, here: before == 0x0A,
}
CUTS = "n long, first long, second long, first_byte long, second_byte long"


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``count`` places of each entry, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def _marks(data: np.ndarray, begin: np.ndarray, end: np.ndarray, fresh: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chunks' bytes and whether a unit begins there; ``fresh`` chunks are the first of their texts."""
    at = _spread(begin, end - begin)
    marks = UNITS[unit](data[np.maximum(at - 1, 0)], data[at])
    marks[np.cumsum(end - begin)[fresh] - (end - begin)[fresh]] = True
    return at, marks


def cut_places(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "code_point", chunk_bytes: int = CHUNK_BYTES) -> tuple[np.ndarray, ...]:
    """(units, smaller and larger rank, bytes before each of the two cuts) of the texts data[offsets[i]:offsets[i + 1]].

    A rank is the draw modulo the units plus one: the cut lies after so many units.
    """
    sizes = np.diff(offsets)
    chunks = -(-sizes // chunk_bytes)
    text = np.repeat(np.arange(len(sizes)), chunks)
    nth = _spread(np.zeros(len(sizes), np.int64), chunks)
    begin = offsets[:-1][text] + nth * chunk_bytes
    end = np.minimum(begin + chunk_bytes, offsets[1:][text])
    # A few megabytes of chunks at a time: what the predicate needs does not grow with the batch.
    counts = np.zeros(len(begin), np.int64)
    step = max(1, (4 << 20) // chunk_bytes)
    for k in range(0, len(begin), step):
        b, e = begin[k : k + step], end[k : k + step]
        _, marks = _marks(data, b, e, nth[k : k + step] == 0, unit)
        counts[k : k + step] = np.add.reduceat(marks, np.cumsum(e - b) - (e - b))
    ahead = np.concatenate([[0], np.cumsum(counts)])
    first_chunk = np.concatenate([[0], np.cumsum(chunks)])
    base = ahead[first_chunk[:-1]]
    n = ahead[first_chunk[1:]] - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    ranks = np.minimum(a, b), np.maximum(a, b)
    out = []
    for rank in ranks:
        # After all units lies the end; each other rank falls into the last chunk that has no more units before it.
        inside = np.flatnonzero(rank < n)
        place = sizes.copy()
        want = base[inside] + rank[inside]
        owner = np.searchsorted(ahead, want, side="right") - 1
        for k in range(0, len(inside), step):
            t, c = inside[k : k + step], owner[k : k + step]
            at, marks = _marks(data, begin[c], end[c], nth[c] == 0, unit)
            found = at[np.flatnonzero(marks)]
            start = np.cumsum(counts[c]) - counts[c]
            place[t] = found[start + want[k : k + step] - ahead[c]] - offsets[t]
        out.append(place)
    return n, *ranks, *out


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of texts; nulls are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8), offsets


def cuts(text: Column, h1: Column, h2: Column, unit: str = "code_point", chunk_bytes: int = CHUNK_BYTES) -> Column:
    """Struct of the units, the two ranks and the bytes before the two cuts of a text."""

    @F.arrow_udf(CUTS)
    def run(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        data, offsets = _flat(texts)
        found = cut_places(data, offsets, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), unit, chunk_bytes)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["n", "first", "second", "first_byte", "second_byte"])

    return run(text, h1, h2)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "code_point", id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``n`` units, ``form``, ``prefix_units`` and ``middle_units`` (null if plain) and ``output``; no shuffle."""
    added = ["n", "form", "prefix_units", "middle_units", "output"]
    if clash := {c.lower() for c in docs.columns} & set(added):
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    h1, h2, h3, h4 = draws(F.col(id_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - PLAIN_SHARE), "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")
    own = [f"__in_{k}" for k in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)], text.alias("__text"), form.alias("__form"), cuts(text, h1, h2, unit, chunk_bytes).alias("__cut"))
    whole, at, then = F.col("__text").cast("binary"), F.col("__cut.first_byte").cast("int"), F.col("__cut.second_byte").cast("int")
    prefix, middle, suffix = F.substring(whole, F.lit(1), at), F.substring(whole, at + 1, then - at), F.substring(whole, then + 1, F.octet_length("__text") - then)
    mark = {x: F.lit(x.encode()) for x in (PREFIX, SUFFIX, MIDDLE)}
    psm = F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    cut = F.col("__form") != "plain"
    return rows.select(
        *[F.col(o).alias(c) for c, o in zip(docs.columns, own)],
        F.col("__cut.n").alias("n"),
        F.col("__form").alias("form"),
        F.when(cut, F.col("__cut.first")).alias("prefix_units"),
        F.when(cut, F.col("__cut.second") - F.col("__cut.first")).alias("middle_units"),
        F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", spm).otherwise(whole).cast("string").alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of; the marks are found by splitting, as no part holds one."""
    after = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    before = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    psm = F.concat(before(after(output, PREFIX), SUFFIX), after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE))
    spm = F.concat(before(after(output, PREFIX), MIDDLE), after(output, MIDDLE), before(after(output, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
