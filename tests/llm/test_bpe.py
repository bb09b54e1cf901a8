from __future__ import annotations

import hashlib
import random
import time

import pytest
from tokenizers import Tokenizer

from skyrill.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def pair():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return bpe.Bpe(PATH), t


def texts():
    rng = random.Random(3)
    out = ["", " ", "aaaaaaaaaa aaaa", "It's 'something 12345!!! <|endoftext|>Foo<|startoftext|>", "Σ ΑΣ İ ẛ̣ ﬁ", "a\x85b\x1cc​ d", "漢字かな 👩‍👩‍👧 ١٢٣ ½", "x" * 3000]
    out += ["".join(chr(c) for c in range(lo, lo + 64)) for lo in range(0, 0x3000, 64)]
    out += ["".join(rng.choice("ab' strevmld19é.!\n<|endoftx>Σ") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    return out


def test_equals_library(pair):
    own, lib = pair
    for text, (n, ids, decoded) in zip(texts(), own.batch(texts())):
        e = lib.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(e), " ".join(map(str, e)), lib.decode(e, skip_special_tokens=False)), text


def test_long_pieces_equal_library(pair):
    own, lib = pair
    rng = random.Random(6)
    alphabets = ["a", "ab", "aaaab", "etaoinshrdlu", "漢字仮名交文日本語中国", "가나다라마바사", "=-", "!", "😂❤️😍"]
    long = []
    for k in range(200):
        n, letters = rng.choice([120, 128, 129, 300, 1500]), alphabets[k % len(alphabets)]
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        long.append("".join(rng.choice(letters) for _ in range(n)) if k % 3 else word * (n // len(word)) + letters * (k % 5))
    long.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)))
    began = time.time()
    got = own.encode(long)
    assert time.time() - began < 60
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in long]


def test_cache_may_start_anew(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    own = bpe.Bpe(PATH)
    for _ in range(3):
        assert own.encode(["hello new world", None]) == [pair[1].encode("hello new world", add_special_tokens=False).ids, []]


def test_digest_rows(spark, docs_of, pair):
    rows = {r.doc_id: r for r in bpe.digest(docs_of(["Hello", None, "", "Hello"]), PATH).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (rows[1].n_tokens, rows[1].ids_sha256, rows[1].decoded_sha256) == (0, empty, empty)
    assert rows[0][1:] == rows[3][1:] and rows[0].n_tokens == 1
    assert bpe.digest(docs_of([]), PATH).count() == 0


def test_round_trip_columns(spark, docs_of, pair):
    df = bpe.decode(bpe.encode(docs_of(["The cat"]), PATH), PATH)
    r = df.first()
    assert r.h == "x" and r.decoded == pair[1].decode(r.ids, skip_special_tokens=False)
