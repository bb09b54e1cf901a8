"""Token counts: a separator scan of flat token files that have no index.

A token file is a run of little-endian 16-bit or 32-bit token ids; documents follow each other
and each ends with the end-of-document id. Files are read in blocks of
``BLOCK_BYTES`` as independent tasks. A block finds its separators with one
vectorised comparison and reports how many there are, where the first and last
lie, and the lengths of documents that begin and end inside. Two prefix scans
over the block reports of a file, a running count of separators and a running
maximum of their places, number the documents and join those that cross blocks.

Files are reached through ``pyarrow.fs`` by URI (local, S3, GCS, HDFS). The
writer names a file for its task attempt and the file becomes part of the
result only through the attempt's committed rows, so a retried or lost task
leaves nothing that is counted.

Defined results: a file of no tokens has no documents; tokens after the last
separator are one document more, open to the end; two separators in a row hold
an empty document; a null or empty text is an empty document; a document of any
length may span many blocks; repeated rows are
documents of their own; an empty table gives an empty table; other columns
are not read. A file must hold a whole number of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, stage, table

BLOCK_BYTES = 4 << 20
FILE_BYTES = 64 << 20
SEPARATOR = 50256


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


@lru_cache(maxsize=2)
def _encoder(ranks_path: str):
    """A byte-level BPE of a ranks file; ids below ``SEPARATOR``."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def write_tokens(docs: DataFrame, folder: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write token files of about ``file_bytes`` and return (file, number, doc_id) of every document in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path).encode_ordinary
        system, path = _open(folder)
        system.create_dir(path)
        out, name, size, number = None, "", 0, 0
        for batch in batches:
            files, numbers = [], []
            for text in batch.column(1).to_pylist():
                if out is None:
                    name, size, number = f"{uuid.uuid4().hex}.u16", 0, 0
                    out = system.open_output_stream(f"{path}/{name}")
                data = np.array([*encode(text or ""), SEPARATOR], "<u2").tobytes()
                out.write(data)
                files.append(f"{folder}/{name}")
                numbers.append(number)
                size, number = size + len(data), number + 1
                if size >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), batch.column(0)], ["file", "number", "doc_id"])
        if out is not None:
            out.close()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "file string, number long, doc_id long")


def blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(file, block, offset, bytes) of every block of the files (column file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _open(uri)
                size = system.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{uri}: {size} bytes are no whole number of ids")
                at = np.arange(0, size, block_bytes - block_bytes % width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uri] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at, pa.int64()), pa.array(np.minimum(block_bytes - block_bytes % width, size - at), pa.int64())],
                    ["file", "block", "offset", "bytes"],
                )

    return files.mapInArrow(run, "file string, block long, offset long, bytes long")


def scan_block(ids: np.ndarray, separator: int) -> tuple[int, int, int, np.ndarray]:
    """Separators, first and last place (-1: none), and the lengths of documents wholly inside after the first separator."""
    at = np.flatnonzero(ids == separator)
    if not len(at):
        return 0, -1, -1, at
    return len(at), int(at[0]), int(at[-1]), np.diff(at) - 1


def count_tokens(files: DataFrame, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES, width: int = 2) -> DataFrame:
    """(file, number, n_tokens, closed) of every document of the files; separators are not counted."""
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "start", "ids", "n", "first", "last", "inner"]
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["file"])
                with system.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(row["bytes"], row["offset"]), kind)
                n, first, last, inner = scan_block(ids, separator)
                cols = ([row["file"]], [row["block"]], [row["offset"] // width], [len(ids)], [n], [first], [last], [inner.astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(c) if i < 7 else pa.array(c, pa.list_(pa.int64())) for i, c in enumerate(cols)], names)

    listed = blocks(files, block_bytes, width)
    # Blocks are dealt anew: the blocks of one large file go to many tasks.
    dealt = listed.repartition("file", "block")
    reports = stage(dealt.mapInArrow(run, "file string, block long, start long, ids long, n long, first long, last long, inner array<long>"), "separators")
    narrow = reports.select("file", "block", "start", "ids", "n", "first", "last")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("number", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.when(F.col("n") > 0, F.col("start") + F.col("last"))
    placed = placed.withColumn("begin", F.coalesce(F.max(place).over(before) + 1, F.lit(0)))
    crossing = placed.where("n > 0").select("file", "number", (F.col("start") + F.col("first") - F.col("begin")).alias("n_tokens"), F.lit(True).alias("closed"))
    inner = placed.where("n > 1").select("file", "block", "number").join(reports.select("file", "block", "inner"), ["file", "block"])
    inner = inner.select("file", "number", F.posexplode("inner").alias("k", "n_tokens")).select("file", (F.col("number") + 1 + F.col("k")).alias("number"), "n_tokens", F.lit(True).alias("closed"))
    ends = narrow.groupBy("file").agg(F.sum("n").alias("number"), F.coalesce(F.max(place) + 1, F.lit(0)).alias("begin"), F.sum("ids").alias("all"))
    tail = ends.where("all > begin").select("file", "number", (F.col("all") - F.col("begin")).alias("n_tokens"), F.lit(False).alias("closed"))
    return crossing.union(inner).union(tail)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stage(write_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), default_ranks()), "written")
    counts = count_tokens(written.select("file").distinct())
    return written.join(counts, ["file", "number"], "left").select("doc_id", "n_tokens", "closed")
