"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's word pattern.  The distinct words of a batch are
put as byte tokens into padded integer matrices, one for each length bucket.  Each
round looks up the rank of every adjacent pair in an open-addressing hash table and
every row merges its leftmost pair of least rank (and the further occurrences of
that pair, where no merge in between could have made a pair of lower rank); rows
are compacted, finished rows leave.

Null and empty texts give an empty list.  No special tokens: their strings are text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: words kept between batches; beyond it the memory is emptied
CACHE_WORDS = 300_000
NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table (left id, right id) -> merged id, probed for whole arrays at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        k, v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(k)
        while len(k):  # of the keys that want a free slot one gets it; the rest move on
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = k[won], v[won]
            rest = np.ones(len(k), bool)
            rest[won] = False
            k, v, at = k[rest], v[rest], (at[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of every pair, NONE where there is none (ids below 0 are padding)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        key[(left < 0) | (right < 0)] = -2
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero(key.ravel() >= 0)
        flat, res = key.ravel(), out.ravel()
        at = self._slot(flat[todo])
        while len(todo):
            found = self.keys[at]
            hit = found == flat[todo]
            res[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return res.reshape(key.shape)


class Encoder:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pairs = PairTable(ranks)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, np.ndarray] = {}

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of each word, by length bucket."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            buckets.setdefault(max(3, (len(w) - 1).bit_length()), []).append(i)
        for bits, members in buckets.items():
            step = max(1, (1 << 21) >> bits)  # cells of a matrix are bounded, whatever the length
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([raw[i] for i in part])):
                    out[i] = ids
        return out

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        m = np.full((len(words), width), -1, np.int32)
        m[np.arange(width) < sizes[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        out: list = [None] * len(words)
        row = np.arange(len(words))
        rank = self.pairs.ranks(m[:, :-1], m[:, 1:])
        while len(row):
            least = rank.min(1) if rank.shape[1] else np.full(len(row), NONE)
            done = least == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    ids = m[k]
                    out[row[k]] = ids[ids >= 0].copy()
                m, rank, row, least = m[~done], rank[~done], row[~done], least[~done]
                if not len(row):
                    break
            at = rank == least[:, None]
            at = self._apart(at)
            new, new_rank = self._apply(m, at, least)
            worse = (new_rank <= least[:, None]).any(1) & (at.sum(1) > 1)
            if worse.any():  # a pair of lower rank came up between occurrences: only the leftmost may merge
                k = np.flatnonzero(worse)
                only = np.zeros_like(at[k])
                only[np.arange(len(k)), at[k].argmax(1)] = True
                a, b = self._apply(m[k], only, least[k])
                pad = max(a.shape[1], new.shape[1])
                new, new_rank = _widen(new, pad, -1), _widen(new_rank, pad - 1, NONE)
                new[k], new_rank[k] = _widen(a, pad, -1), _widen(b, pad - 1, NONE)
            m, rank = new, new_rank
        return out

    @staticmethod
    def _apart(at: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences the leftmost of each two."""
        if not (at[:, 1:] & at[:, :-1]).any():
            return at
        pos = np.broadcast_to(np.arange(at.shape[1]), at.shape)
        start = np.where(at & ~np.pad(at[:, :-1], ((0, 0), (1, 0))), pos, -1)
        return at & ((pos - np.maximum.accumulate(start, 1)) % 2 == 0)

    def _apply(self, m: np.ndarray, at: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows with the marked pairs merged and moved together, and their pair ranks."""
        m = m.copy()
        r, c = np.nonzero(at)
        m[r, c] = merged[r]
        m[r, c + 1] = -1
        keep = m >= 0
        sizes = keep.sum(1)
        new = np.full((len(m), int(sizes.max())), -1, np.int32)
        new[np.arange(new.shape[1]) < sizes[:, None]] = m[keep]
        return new, self.pairs.ranks(new[:, :-1], new[:, 1:])

    def batch(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of every text as one Arrow list array."""
        cut = [self.split(t) if t else [] for t in texts]
        fresh = list({w for ws in cut for w in ws}.difference(self.memory))
        for w, ids in zip(fresh, self.words(fresh)):
            self.memory[w] = ids
        get = self.memory.__getitem__
        flat = [ids for ws in cut for ids in map(get, ws)]
        lengths = np.fromiter((len(x) for x in flat), np.int64, len(flat))
        words = np.fromiter((len(ws) for ws in cut), np.int64, len(cut))
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(words)))]
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        if len(self.memory) > CACHE_WORDS:
            self.memory.clear()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _widen(a: np.ndarray, width: int, fill: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=fill)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: a scan without a shuffle, text leaving the JVM once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 256):  # a bounded number of whole texts at a time
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.batch(part.column(1).to_pylist())], names=[id_col, "ids"])

    kind = dict(documents.dtypes)[id_col]
    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
