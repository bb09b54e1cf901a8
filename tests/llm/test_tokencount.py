from __future__ import annotations

import numpy as np
import pytest

from skyrill.llm import tokencount as K


def plain(ids, sep):
    docs, n = [], 0
    for x in ids:
        if x == sep:
            docs.append((n, True))
            n = 0
        else:
            n += 1
    return docs + ([(n, False)] if len(ids) and ids[-1] != sep else [])


@pytest.mark.parametrize("block,width", [(14, 2), (4, 4), (1 << 20, 2)])
def test_equals_plain_scan(spark, tmp_path, block, width):
    rng = np.random.default_rng(1)
    files = []
    for k in range(7):
        rng.integers(0, 4, [0, 1, 3, 50, 200, 201, 90][k]).astype(f"<u{width}").tofile(tmp_path / f"{k}.bin")
        files.append((f"file://{tmp_path}/{k}.bin",))
    np.full(9, 3, f"<u{width}").tofile(tmp_path / "7.bin")
    files.append((f"file://{tmp_path}/7.bin",))
    got: dict = {}
    for r in K.count_tokens(spark.createDataFrame(files, "file string"), 3, block, width).collect():
        got.setdefault(r.file, {})[r.number] = (r.n_tokens, r.closed)
    for (f,) in files:
        want = plain(np.fromfile(f[7:], f"<u{width}").tolist(), 3)
        assert [got.get(f, {}).get(i) for i in range(len(want))] == want and len(got.get(f, {})) == len(want)


def test_written_documents(spark, docs_of, tmp_path):
    texts = ["Hello world", None, "", "x " * 500, "Hello world"]
    written = K.write_tokens(docs_of(texts), f"file://{tmp_path}/t", K.default_ranks(), file_bytes=200).persist()
    written.count()
    rows = written.join(K.count_tokens(written.select("file").distinct()), ["file", "number"]).collect()
    e = K._encoder(K.default_ranks()).encode_ordinary
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(e(t or "")) for i, t in enumerate(texts)}
    assert K.write_tokens(docs_of([]), f"file://{tmp_path}/e", K.default_ranks()).count() == 0


def test_odd_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number"):
        K.count_tokens(spark.createDataFrame([(f"file://{tmp_path}/a.bin",)], "file string")).collect()
