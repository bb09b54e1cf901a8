from __future__ import annotations

import base64
import hashlib
from urllib.parse import quote

import numpy as np
import pytest

from skyrill.llm import warc
from skyrill.llm.shared import fresh_path

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(pages):
    out = {}
    for i, _, html in pages:
        data = (html or "").encode()
        head = max(j for j, _, h in pages if (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out[i] = (len(data), digest, "response" if i == head else "revisit", None if i == head else head)
    return out


@pytest.mark.parametrize("split,compression", [("128m", "gzip"), ("128m", "none"), ("300b", "none")])
def test_round_trip_with_magic_in_payloads(spark, split, compression):
    pages = [(1, "http://a", "<p>é\r\n\r\nWARC/1.0\r\n"), (2, None, FAKE + "x" + FAKE), (3, "http://c\nd", None), (4, "http://e", ""), (5, "u", "<p>é\r\n\r\nWARC/1.0\r\n"), (6, "u", "z" * 2000), (7, "u", "WARC/1.0\r\n"), (8, "u", FAKE * 20)]
    pages += [(10 + k, "u", f"page {k % 7}" + FAKE * (k % 3)) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = fresh_path(spark, "test-archives")
    warc.write_archives(warc.plan_records(df).coalesce(2), path, compression=compression)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = warc.page_table(warc.read_records(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.page_id: tuple(r)[1:] for r in rows} == expected(pages)
    assert len(rows) == len(pages)


def test_line_ends_of_every_kind_in_addresses_and_payloads(spark):
    """No character of an address or payload can pass for a header line."""
    ends = ["\n", "\r", "\r\n", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "\x00", " ", "\t"]
    fake = ["WARC-Refers-To: <urn:page:77>", "X-Payload-Length: 5", "WARC-Type: response", "WARC-Record-ID: <urn:page:88>", "Content-Length: 1"]
    pages = []
    for k, e in enumerate(ends):
        for j, f in enumerate(fake):
            for twice in (0, 1):  # each payload is a revisit once
                pages.append((100 * k + 10 * j + twice, f"http://a/é%20{e}{f}{e}b", f"<p>{e}{f}{e}</p>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = fresh_path(spark, "test-archives")
    warc.write_archives(warc.plan_records(df), path)
    records = warc.read_records(spark, path)
    rows = warc.page_table(records).collect()
    assert {r.page_id: tuple(r)[1:] for r in rows} == expected(pages) and len(rows) == len(pages)
    found = {r.a for r in records.select(warc.header_value("WARC-Target-URI").alias("a")).collect()}
    assert found == {quote(u, safe="".join(map(chr, range(33, 127)))) for _, u, _ in pages}


def test_broken_chain_ends(spark, tmp_path):
    record = lambda i, body, n: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record(1, "abc", 3) + record(2, "abcdef", 5) + record(3, "x", 1)).encode())
    rows = warc.page_table(warc.read_records(spark, str(tmp_path))).collect()
    assert 1 in {r.page_id for r in rows} and 3 not in {r.page_id for r in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = fresh_path(spark, "test-archives")
    warc.write_archives(warc.plan_records(df), path)
    assert warc.read_records(spark, path).count() == 0


def test_pointer_jumping():
    start, follow = np.array([0, 10, 25, 40]), np.array([25, 40, 60, 61])
    assert list(warc.jump(start, follow)) == [60, 61, 60, 61]
    assert list(warc.reach(start, follow, np.array([0]))) == [True, False, True, False]
