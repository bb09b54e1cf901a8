"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file is a public tokenizer in the JSON form of the tokenizers
library: NFC, lower case, a pattern that picks pieces and drops white space,
byte symbols, and merges with an end-of-word suffix. Distinct pieces of a batch
are merged together: the symbols of all of them lie in one flat array, each
round looks up the rank of every neighbouring pair by binary search over the
sorted pair keys, and every piece merges its pair of lowest rank. Long pieces
(scripts without blanks, runs of letters) merge in all places at once where a
pair has the lowest rank within the reach of a token, and only the pairs beside
a merge are looked up again, so a piece's length costs in proportion.

Defined results: a null or empty text has no tokens and decodes to the empty
text; the strings of special tokens inside a text are those tokens; repeated
rows repeat; other columns are not read; a text of any length is taken whole,
in memory of some 100 bytes a byte. The vocabulary is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Distinct pieces kept between batches before the cache starts anew.
CACHE_PIECES = 500_000
#: Characters whose class is the same in every Unicode version; a text with
#: others is cut into pieces by the library's own normaliser and splitter.
_SETTLED = regex.compile(r"[\u0000-\u024F\u2010-\u2027\u2030-\u205E\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]*")
#: Bytes from which a piece counts as long.
LONG_BYTES = 128
_NO_RANK = np.int32(2**31 - 1)
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.size = size
        self.reach = max(map(len, vocab))
        symbols = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        self.inner = np.array([vocab.get(c, -1) for c in symbols], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[int, str, str]] = {s: (1, str(i), s) for s, i in special.items()}
        self.fixed = dict(self.known)

    def split(self, text: str) -> list[str]:
        """The pieces of a text in order; strings of special tokens are pieces of their own."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            if k % 2:
                out.append(part)
            elif part and not _SETTLED.fullmatch(part):
                out += self.split_by_library(part)
            elif part:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += self.pieces.findall(part)
        return out

    def split_by_library(self, part: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(part)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in pieces]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, flat, and the border of each piece in them."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lengths)
        ids[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        far = (lengths >= LONG_BYTES)[word]
        near, rest = self._merge_short(ids[~far], word[~far], len(pieces)), self._merge_long(ids[far], word[far])
        all_ids, all_word = (np.concatenate(x) for x in zip(near, rest))
        order = np.argsort(all_word, kind="stable")
        return all_ids[order], np.searchsorted(all_word[order], np.arange(len(pieces) + 1))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of ids the place of their merge in the sorted keys, and whether they have one."""
        key = left * self.size + right
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return slot, self.keys[slot] == key

    def _merge_short(self, ids: np.ndarray, word: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and their pieces: in each round every piece merges its pairs of lowest rank."""
        live = np.ones(len(ids), bool)
        done_ids, done_word = [], []
        while len(ids) > 1:
            slot, found = self._look_up(ids[:-1], ids[1:])
            found &= word[1:] == word[:-1]
            if not found.any():
                break
            rank = np.where(found, self.ranks[slot], len(self.ranks))
            lowest = np.full(n_pieces, len(self.ranks), np.int64)
            np.minimum.at(lowest, word[:-1][found], rank[found])
            take = found & (rank == lowest[word[:-1]])
            at = np.flatnonzero(take)
            at = at[_alternate(at)]
            ids[at] = self.made[slot[at]]
            live[: len(ids)] = True
            live[at + 1] = False
            keep = live[: len(ids)]
            ids, word = ids[keep], word[keep]
            # A piece without a known pair is finished and leaves the array.
            open_ = lowest[word] < len(self.ranks)
            if not open_.all():
                done_ids.append(ids[~open_])
                done_word.append(word[~open_])
                ids, word = ids[open_], word[open_]
        return np.concatenate([*done_ids, ids]), np.concatenate([*done_word, word])

    def _merge_long(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and their pieces: in each round all pairs merge whose rank is the lowest within ``reach`` symbols.

        A pair of higher rank than another becomes later than it, and a token spans at most ``reach`` symbols, so
        what lies farther off cannot change a pair before its turn. Of a run of equal overlapping pairs, which merge
        from the left, only the part settled from the run's start is taken.
        """
        n = len(ids)
        slot, rank = np.zeros(n, np.int64), np.full(n, _NO_RANK)
        fresh = np.arange(n - 1)
        while len(fresh):
            slot[fresh], found = self._look_up(ids[fresh], ids[fresh + 1])
            rank[fresh] = np.where(found & (word[fresh] == word[fresh + 1]), self.ranks[slot[fresh]], _NO_RANK)
            known = rank < _NO_RANK
            wait = known & (rank != _lowest_within(rank, self.reach))
            follows = np.zeros(len(rank), bool)
            follows[1:] = known[1:] & (rank[1:] == rank[:-1])
            # Pairs that wait, counted from the start of the run of equal neighbours.
            waits = np.cumsum(wait)
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(rank))))
            at = np.flatnonzero(known & (waits - (waits - wait)[first] == 0))
            at = at[_alternate(at, first[at])]
            ids[at] = self.made[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            ids, word, slot, rank = ids[keep], word[keep], slot[keep], rank[keep]
            if len(rank):
                rank[-1] = _NO_RANK
            fresh = np.unique(np.concatenate([place - 1, place]))
            fresh = fresh[(fresh >= 0) & (fresh < len(ids) - 1)]
        return ids, word

    def learn(self, pieces: set[str]) -> None:
        """Add the merges of unknown pieces to the cache."""
        new = [p for p in pieces if p not in self.known]
        if not new:
            return
        ids, border = self.merge([p.encode() for p in new])
        text = [self.tokens[i] for i in ids.tolist()]
        number = list(map(str, ids.tolist()))
        cuts = border.tolist()
        for p, a, b in zip(new, cuts, cuts[1:]):
            self.known[p] = (b - a, " ".join(number[a:b]), " ".join(text[a:b]))

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of tokens, their ids joined by blanks, and the decoded text."""
        parts = [self.split(t) if t else [] for t in texts]
        fresh: set[str] = set()
        for p in parts:
            fresh.update(p)
        if len(self.known) > CACHE_PIECES:
            self.known = dict(self.fixed)
        self.learn(fresh)
        get = self.known.__getitem__
        for p in parts:
            entries = list(map(get, p))
            yield sum(e[0] for e in entries), " ".join([e[1] for e in entries if e[0]]), " ".join([e[2] for e in entries if e[0]])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(x) for x in ids.split()] for _, ids, _ in self.batch(texts)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, special tokens included; ids outside the vocabulary are left out."""
        return " ".join(self.tokens[i] for i in ids if 0 <= i < self.size and self.tokens[i])


def _alternate(at: np.ndarray, run_of: np.ndarray | None = None) -> np.ndarray:
    """Of chosen left positions, those that remain when overlapping pairs (a run of neighbours) merge from the left."""
    if len(at) < 2:
        return np.ones(len(at), bool)
    run = np.concatenate([[True], np.diff(at) > 1 if run_of is None else np.diff(run_of) > 0])
    first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
    return (np.arange(len(at)) - first) % 2 == 0


def _lowest_within(rank: np.ndarray, reach: int) -> np.ndarray:
    """The lowest rank at most ``reach`` places to either side of each place, by doubled windows."""
    wide = np.concatenate([np.full(reach, _NO_RANK), rank, np.full(reach, _NO_RANK)])
    width = 1
    while 2 * width <= 2 * reach + 1:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    return np.minimum(wide[: len(rank)], wide[2 * reach + 1 - width :][: len(rank)])


@lru_cache(maxsize=2)
def _load(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[tuple[pa.Array, list]]:
    """Ids and texts of a batch, some MB of text at a time."""
    size = batch.column(1).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)) if len(size) else np.zeros(0)
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a).to_pylist()


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number of tokens and digests of ids and decoded text for each document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(vocabulary)
        for batch in batches:
            for ids, texts in _slices(batch):
                rows = [(n, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for n, a, t in bpe.batch(texts)]
                n, a, t = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(t, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, OUT)


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the token ids of each text."""

    @F.pandas_udf("array<int>")
    def ids_of(s):
        import pandas as pd

        return pd.Series(_load(vocabulary).encode(s.where(s.notna(), None).tolist()), index=s.index)

    return docs.withColumn(out_col, ids_of(F.col(text_col).cast("string")))


def decode(frame: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``frame`` and the text of each id list (null: empty)."""

    @F.pandas_udf("string")
    def text_of(s):
        bpe = _load(vocabulary)
        return s.map(lambda ids: "" if ids is None else bpe.decode(list(ids)))

    return frame.withColumn(out_col, text_of(F.col(ids_col)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_vocabulary())
