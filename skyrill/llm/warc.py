"""WARC archives: writing with payload deduplication, and reading by boundary-chain verification.

Writing goes through Spark's text sink with the end of a record as the line
separator, so committed files are whole even when tasks are retried and any
file system that Spark writes will do. Files are gzip streams of bounded record
counts, each read by one task; with compression ``none`` they are splittable,
and large files of others are read block by block.

Reading never trusts the magic ``WARC/1.0`` alone, since a payload may hold it.
Spark splits every file at that mark; each piece is a candidate record whose
header tells where its successor must start. Candidates of one file block are
chained by pointer jumping in that block; the exits of blocks are chained by
pointer jumping over blocks (rounds: the logarithm of a file's blocks). Only
candidates on the chain from the file's start are records; other marks are
payload, and the pieces of such a payload are put together again.

Defined results: a null or empty payload is a record of length zero; a null
address has no target header; blanks, controls and what is not ASCII in addresses are percent-encoded; equal
payloads of one page id are responses all; a chain that breaks (a damaged or
cut file) ends there, and what follows is not reachable; a payload of any length is
one record, whole in memory when it is mended; an empty table writes
no record and reads none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh_path, stage, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 20_000
#: Equal payloads meet their response under so many keys: a payload of a third of all pages is no hot key.
SALTS = 16
_STEP = len(MAGIC)


def base32(hex_digest: Column) -> Column:
    """Base32 (upper case, no padding) of a hex digest whose length is a multiple of five."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): which pages revisit which.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one of largest id is the response.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload")))
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
    heads = groups.agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    heads = stage(heads, "heads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(heads, ["payload_digest", "payload_bytes", "salt"], "left").drop("salt")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))).drop("head")


#: Fixed value: the profile of revisits known by their payload's digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def clean_address(url: Column) -> Column:
    """``url`` with every character but visible ASCII as percent signs and the digits of its UTF-8 bytes."""
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x21-\x7E]$"), c).otherwise(F.regexp_replace(F.hex(c), "(..)", "%$1"))), "")
    return F.when(url.rlike(r"[^\x21-\x7E]"), encoded).otherwise(url)


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Write one record for each row of ``plan_records``; a revisit has no body and names its response."""
    revisit = F.col("refers_to").isNotNull()
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")))
        .otherwise(F.concat(F.lit("\r\nWARC-Record-ID: <urn:page-without-id:"), F.col("payload_digest"), F.lit(":"), F.hex(F.xxhash64("url")), F.lit(">"))),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("\r\nWARC-Target-URI: "), clean_address(F.col("url")))).otherwise(""),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"))).otherwise(""),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string")),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    records.select(header.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def _length(header: bytes) -> int:
    """Content-Length of a record header, or -1."""
    found = -1
    for line in header.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            found = int(value.strip())
    return found


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place each piece within its block and tell where its successor must start."""
    at, place = None, 0
    names = ["file", "block", "start", "size", "head", "length", "header", "body"]
    for batch in batches:
        rows: list[tuple] = []
        for file, block, body in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                at, place = (file, block), 0
            cut = body.find(b"\r\n\r\n")
            header = body[:cut] if cut >= 0 else b""
            rows.append((file, block, place, len(body), cut + 4 if cut >= 0 else -1, _length(header) if cut >= 0 else -1, header.decode("utf-8", "replace"), body))
            place += len(body) + _STEP
        cols = list(zip(*rows)) if rows else [()] * 8
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def jump(start: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """For each candidate of a block the first place at or after the block's end that its chain reaches, else -1."""
    n = len(start)
    slot = np.searchsorted(start, follow)
    inside = (slot < n) & (start[np.minimum(slot, n - 1)] == follow)
    pointer = np.where(inside, slot, np.arange(n))
    for _ in range(max(1, int(n).bit_length())):
        pointer = pointer[pointer]
    out = follow[pointer]
    return np.where(out > start[-1], out, -1)


def reach(start: np.ndarray, follow: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which candidates of a block lie on the chains from its entries."""
    n = len(start)
    slot = np.searchsorted(start, follow)
    inside = (slot < n) & (start[np.minimum(slot, n - 1)] == follow)
    pointer = np.where(inside, slot, np.arange(n))
    on = np.isin(start, entries)
    for _ in range(max(1, int(n).bit_length())):
        on[pointer[on]] = True
        pointer = pointer[pointer]
    return on


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, header, payload) of every record on the chain from its file's start."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("body"))
    pieces = stage(raw.mapInArrow(_pieces, "file string, block long, start long, size long, head long, length long, header string, body binary"), "pieces")
    # The bytes of earlier blocks place a block in its file.
    ends = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + _STEP).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage(ends.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))), "blocks")
    follow = F.col("start") + F.col("head") + F.col("length") + len(END) + _STEP
    narrow = pieces.where("length >= 0").select("file", "block", "start", follow.alias("follow"))

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("start")
        return frame.assign(out=jump(frame["start"].to_numpy(), frame["follow"].to_numpy()))

    kind = "file string, block long, start long, follow long, out long"
    jumps = narrow.groupBy("file", "block").applyInPandas(exits, kind).join(blocks, ["file", "block"])
    jumps = stage(jumps.select("file", "block", (F.col("base") + F.col("start")).alias("here"), F.when(F.col("out") >= 0, F.col("base") + F.col("out")).alias("out")), "jumps")
    entries = blocks.where("base = 0").select("file", F.lit(_STEP).cast("long").alias("here")).distinct()
    most = blocks.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    # Only places that a chain can enter a block at take part in the jumps between blocks.
    doors = stage(jumps.join(jumps.select("file", F.col("out").alias("here")).union(entries).distinct(), ["file", "here"], "left_semi").select("file", "here", "out"), "doors") if most > 1 else None
    covered = 1
    while covered < most:
        ahead = entries.join(doors, ["file", "here"]).where("out is not null").select("file", F.col("out").alias("here"))
        entries = stage(entries.union(ahead).distinct(), "entries")
        step = doors.alias("d").join(doors.alias("e"), (F.col("d.file") == F.col("e.file")) & (F.col("d.out") == F.col("e.here")), "left")
        doors = stage(step.select("d.file", "d.here", F.col("e.out").alias("out")), "doors")
        covered *= 2
    local = entries.join(jumps, ["file", "here"]).join(blocks, ["file", "block"]).select("file", "block", (F.col("here") - F.col("base")).alias("start"))

    def chained(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("start")
        if not len(left) or not len(right):
            return left.iloc[:0]
        return left[reach(left["start"].to_numpy(), left["follow"].to_numpy(), right["start"].to_numpy())]

    on = narrow.groupBy("file", "block").cogroup(local.groupBy("file", "block")).applyInPandas(chained, "file string, block long, start long, follow long")
    on = stage(on.join(blocks, ["file", "block"]).select("file", "block", "start", (F.col("base") + F.col("start")).alias("position")), "records")
    records = pieces.join(on, ["file", "block", "start"])
    whole = records.where(F.col("head") + F.col("length") <= F.col("size"))
    out = whole.select("file", "position", "header", F.expr("substring(body, cast(head + 1 as int), cast(length as int))").alias("payload"))
    broken = stage(records.where(F.col("head") + F.col("length") > F.col("size")).select("file", "position", "head", "length", "header"), "broken")
    if broken.isEmpty():
        return out
    # Pieces that begin inside a record's payload follow it by place; their own record is the last one before them.
    placed = pieces.join(blocks, ["file", "block"]).join(broken.select("file").distinct(), "file", "left_semi").select("file", "block", "start", (F.col("base") + F.col("start")).alias("place"))
    owner = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    mark = broken.select("file", F.col("position").alias("place"), F.lit(True).alias("is_broken"))
    known = on.select("file", F.col("position").alias("place"), F.lit(True).alias("is_record"))
    owned = placed.join(known, ["file", "place"], "left").withColumn("position", F.last(F.when(F.col("is_record"), F.col("place")), ignorenulls=True).over(owner))
    owned = owned.join(mark.select("file", F.col("place").alias("position")), ["file", "position"], "left_semi")
    parts = owned.join(pieces.select("file", "block", "start", "body"), ["file", "block", "start"])
    # Joined as hex digits: a fold that appends bytes would copy a payload once for each mark in it.
    pieces_of = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: F.concat(F.lit(MAGIC.encode().hex()), F.hex(x["body"])))
    text = F.unhex(F.array_join(pieces_of, ""))
    joined = parts.groupBy("file", "position").agg(text.alias("all")).join(broken, ["file", "position"])
    mended = joined.where(F.octet_length("all") >= F.lit(_STEP) + F.col("head") + F.col("length"))
    return out.union(mended.select("file", "position", "header", F.expr(f"substring(all, cast(head + {_STEP + 1} as int), cast(length as int))").alias("payload")))


def header_value(name: str) -> Column:
    """A field of a record's header; only CR LF ends a line, whatever else the value holds."""
    found = F.rtrim(F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1))
    return F.when(found != "", found)


def page_table(records: DataFrame) -> DataFrame:
    """Records as pages: id, full payload size and digest, type and response."""
    page = F.regexp_extract(header_value("WARC-Record-ID"), r"<urn:page:(-?\d+)>", 1)
    refers = F.regexp_extract(header_value("WARC-Refers-To"), r"<urn:page:(-?\d+)>", 1)
    revisit = header_value("WARC-Type") == "revisit"
    return records.select(
        page.try_cast("long").alias("page_id"),
        F.when(revisit, header_value("X-Payload-Length").try_cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(header_value("WARC-Payload-Digest"), "^sha1:", "")).otherwise(payload_digest(F.col("payload"))).alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        F.when(revisit, refers.try_cast("long")).alias("refers_to"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(plan_records(table(spark, sf_dir, "pages")), path)
    return page_table(read_records(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS head FROM p),
c AS (SELECT *, unnest(range(32)) AS k FROM d),
bits AS (SELECT page_id, payload_bytes, head, k,
    (('0x' || hex[(k // 4) * 5 + 1 : (k // 4) * 5 + 5])::BIGINT >> (15 - 5 * (k % 4))) & 31 AS v FROM c)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v + 1)::BIGINT], '' ORDER BY k) AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM bits GROUP BY page_id, payload_bytes, head
"""
