"""Evaluation passages inside the training text.

The items are the small side: an inverted BM25 index of their passages, in blocks of
items with a maximum for every term and block, goes to every task.  Each document is the
query of a block-max WAND: the terms of a block that can't reach its least threshold even
all together are no reason to look at it, so only the others have postings; a block is
scored if what the document shares of these, by block maxima, could reach the threshold,
and the postings of other blocks are never read.  Every item that reaches its own
threshold is verified by the runs of words that document and passage share, and by how
much of question and answer the document holds.  An item's threshold is a lower bound of
what any document that covers half of its passage must score, so no leak is lost.

Items of any number: beyond ``PART_CHARS`` characters they are indexed in parts, and the
documents are scanned once for each part.  Null passages, and those shorter than a run,
can't leak; null and empty texts leak nothing; of equal items each is reported.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .confusables import skeleton

#: words (characters in zh and ja) of a run, share of a passage that runs must cover
RUN_WORDS, RUN_CHARS, COVER = 8, 15, 0.5
BY_CHARS = ("zh", "ja")
K1, B = 1.2, 0.75
BLOCK = 4
#: characters of the passages of one index (it takes about 25 bytes for each)
PART_CHARS = 4_000_000
#: texts looked up together
TEXTS = 64

_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|pre|blockquote|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--(?:(?!<!--).)*?-->", re.S)
_LINE_NO = re.compile(r"(?m)^[ \t >]*(?:\d{1,5}[ \t ]*[|│:)\]]|\[\d{1,5}\]|[>|])[ \t ]+")
_WORD = re.compile(r"[^\W_]+")
_INNER = re.compile(r"(?<=[^\W_])(?:[.,'’:‐‑/_-]|[‐‑-]\n\s*)(?=[^\W_])")
_IDEOGRAPHS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


class _Fold(dict):
    """Code point -> its letters whatever their case, accents and look-alikes, derived when first met."""

    def __missing__(self, cp: int) -> str:
        # small letters may have a look-alike only in their large form, and the other way round
        s = skeleton(skeleton(chr(cp)).upper()).casefold()
        out = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.category(c).startswith("M"))
        self[cp] = out
        return out


_FOLD = _Fold()


def plain(text: str) -> str:
    """Without markup, entities, line numbers and differences of character form, accent or case."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub("", _BLOCK_TAG.sub(" ", t))
    if "\n" in t or t[:9].lstrip(" \t>")[:1] in _NUMBERED:
        t = _LINE_NO.sub("", t)
    return t.lower() if t.isascii() else t.translate(_FOLD)


_NUMBERED = set("0123456789[>|")


def words(flat: str) -> list[str]:
    """Words of a plain text; marks inside a word don't count."""
    return _WORD.findall(_INNER.sub("", flat))


def letters(flat: str) -> str:
    """Letters and digits only, for scripts without word blanks."""
    return "".join(_WORD.findall(flat))


def _terms(tokens: list[str] | str) -> list[str]:
    """Index terms: words, or pairs of characters."""
    return tokens if isinstance(tokens, list) else [tokens[i : i + 2] for i in range(len(tokens) - 1)]


def _least_score(cost: np.ndarray, size: int, by_chars: bool) -> float:
    """What a text must score at least that holds runs covering COVER of a passage.

    ``cost`` is each term's weight shared among its places, so a set of places costs at
    most what the distinct terms in it score.  Dynamic programming over the places, by
    the number of words covered, inside a run and outside.
    """
    run = RUN_CHARS if by_chars else RUN_WORDS
    terms = run - 1 if by_chars else run  # places that a shortest run takes
    need = int(np.ceil(COVER * size))
    total = np.concatenate(([0.0], np.cumsum(cost)))
    out = np.full((len(cost) + 1, need + 1), np.inf)  # cheapest with so many covered (need: or more), no run open
    inside = np.full_like(out, np.inf)
    out[0, 0] = 0
    for i in range(len(cost) + 1):
        if i:
            out[i] = np.minimum(out[i], out[i - 1])
            grown = inside[i - 1] + cost[i - 1]
            inside[i, 1:] = np.minimum(inside[i, 1:], grown[:-1])
            inside[i, need] = min(inside[i, need], grown[need])
        if i >= terms:
            begun = out[i - terms] + total[i] - total[i - terms]
            k = min(run, need)
            inside[i, k:] = np.minimum(inside[i, k:], begun[: need + 1 - k])
            inside[i, need] = min(inside[i, need], begun[max(0, need - run) :].min())
        out[i] = np.minimum(out[i], inside[i])
    least = out[:, need].min()
    return float(least) if np.isfinite(least) else float(total[-1])


class Index:
    def __init__(self, items: list[tuple[int, str | None, str, str | None, str | None]]):
        self.ids, self.tokens, self.chars, self.extra = [], [], [], []
        for item, lang, passage, question, answer in sorted(items, key=lambda r: r[0]):
            flat = plain(passage)
            by_chars = (lang or "").lower()[:2] in BY_CHARS
            tokens = letters(flat) if by_chars else words(flat)
            if len(tokens) < (RUN_CHARS if by_chars else RUN_WORDS):
                continue
            self.ids.append(item)
            self.tokens.append(tokens)
            self.chars.append(by_chars)
            self.extra.append((question, answer))
        n = len(self.ids)
        counts = [Counter(_terms(t)) for t in self.tokens]
        size = [sum(c.values()) for c in counts]
        mean = sum(size) / max(1, n)
        df = Counter(t for c in counts for t in c)
        idf = {t: log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        # like items stand together, so that block maxima stay near to single items
        order = sorted(range(n), key=lambda i: (self.chars[i], self.tokens[i][:1], i))
        place = {i: k for k, i in enumerate(order)}
        self.item_at = np.array(order, np.int64)
        self.threshold = np.zeros(n)
        entries = []
        self.vocabulary: dict[str, int] = {}
        for i, c in enumerate(counts):
            weight = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / mean)) for t, f in c.items()}
            entries += [(self.vocabulary.setdefault(t, len(self.vocabulary)), place[i], w) for t, w in weight.items()]
            cost = np.array([weight[t] / c[t] for t in _terms(self.tokens[i])])
            self.threshold[place[i]] = 0.999 * _least_score(cost, len(self.tokens[i]), self.chars[i])
        entries.sort()
        term, self.place = (np.array([e[k] for e in entries], np.int64) for k in (0, 1))
        self.weight = np.array([e[2] for e in entries])
        # postings: of a term its blocks, of a block its items
        block = self.place // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.block, self.items_from = block[first], np.append(first, len(term))
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.blocks_from = np.searchsorted(term[first], np.arange(len(self.vocabulary) + 1))
        self.blocks = -(-n // BLOCK)
        self.least = np.array([self.threshold[k : k + BLOCK].min() for k in range(0, n, BLOCK)])
        self.grams: dict = defaultdict(list)
        for i, t in enumerate(self.tokens):
            run = RUN_CHARS if self.chars[i] else RUN_WORDS
            for p in range(len(t) - run + 1):
                self.grams[self._gram(t[p : p + run])].append((i, p))
        self.grams = dict(self.grams)
        self.any_chars, self.any_words = any(self.chars), not all(self.chars)
        # whether runs without an ideograph could cover half of such a passage
        self.plain_chars = any(c and sum(len(r) for r in _IDEOGRAPHS.split(t) if len(r) >= RUN_CHARS) >= COVER * len(t) for c, t in zip(self.chars, self.tokens))

    @staticmethod
    def _gram(part: list[str] | str) -> str:
        return part if isinstance(part, str) else " ".join(part)

    def candidates(self, queries: list[set[str]]) -> list[list[int]]:
        """For each query the items whose BM25 score reaches their threshold."""
        out: list[list[int]] = [[] for _ in queries]
        known = [list(map(self.vocabulary.__getitem__, self.vocabulary.keys() & q)) for q in queries]
        terms = np.fromiter((t for k in known for t in k), np.int64)
        if not len(terms):
            return out
        owner = np.repeat(np.arange(len(queries)), [len(k) for k in known])
        at, many = _ranges(self.blocks_from[terms], self.blocks_from[terms + 1])
        place = np.repeat(owner, many) * self.blocks + self.block[at]
        bound = np.bincount(place, self.block_max[at], len(queries) * self.blocks)
        # only the postings of blocks that could reach their least threshold are read
        use = np.flatnonzero((bound >= np.tile(self.least, len(queries)))[place])
        if not len(use):
            return out
        items, many = _ranges(self.items_from[at[use]], self.items_from[at[use] + 1])
        n = len(self.ids)
        score = np.bincount(np.repeat(place[use] // self.blocks, many) * n + self.place[items], self.weight[items], len(queries) * n).reshape(-1, n)
        for q, k in zip(*np.nonzero(score >= self.threshold)):
            out[q].append(int(self.item_at[k]))
        return out

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item, share of the passage, of the question, of the answer) for every item the text leaks."""
        return self.leaks_of([text])[0]

    def leaks_of(self, texts: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """The same for each of several texts."""
        read = []
        for text in texts:
            flat = plain(text) if text else ""
            ws = words(flat) if self.any_words else []
            cs = letters(flat) if flat and self.any_chars and (self.plain_chars or (not text.isascii() and _IDEOGRAPHS.search(flat))) else ""
            terms = set(ws)
            if cs:
                terms.update(_terms(cs))
            read.append((ws, cs, terms))
        return [self._verified(*r, set(c)) if c else [] for r, c in zip(read, self.candidates([r[2] for r in read]))]

    def _verified(self, ws: list[str], cs: str, terms: set[str], found: set[int]) -> list[tuple[int, float, float, float]]:
        cover: dict[int, set[int]] = defaultdict(set)
        by_chars = {self.chars[i] for i in found}
        runs = [" ".join(ws[p : p + RUN_WORDS]) for p in range(len(ws) - RUN_WORDS + 1)] if False in by_chars else []
        runs += [cs[p : p + RUN_CHARS] for p in range(len(cs) - RUN_CHARS + 1)] if True in by_chars else []
        for gram in self.grams.keys() & set(runs):
            for i, at in self.grams[gram]:
                if i in found:
                    cover[i].update(range(at, at + (RUN_CHARS if self.chars[i] else RUN_WORDS)))
        out = []
        for i, at in sorted(cover.items()):
            share = len(at) / len(self.tokens[i])
            if share >= COVER:
                q, a = self.extra[i]
                out.append((self.ids[i], share, _overlap(terms, q, self.chars[i]), _overlap(terms, a, self.chars[i])))
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of low..high, range by range, and how many each range has."""
    many = high - low
    return np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many), many


def _overlap(terms: set[str], part: str | None, by_chars: bool) -> float:
    """Share of the part's distinct terms that the document holds; 0 for a missing part."""
    if not part:
        return 0.0
    flat = plain(part)
    mine = set(_terms(letters(flat) if by_chars else words(flat)))
    return len(mine & terms) / len(mine) if mine else 0.0


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, covered, question, answer), one row for each leak.

    ``covered`` is the share of the passage in shared runs, which alone makes a leak;
    ``question`` and ``answer`` are the shares of their words that the document holds.
    A scan of the documents without a shuffle for each part of the items.
    """
    fit = eval_items.where(F.col("passage").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "lang", "passage", "question", "answer").distinct()
    chars = fit.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // PART_CHARS))
    out = None
    for k in range(parts):
        mine = fit.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else fit
        found = _scan(documents, Index([tuple(r) for r in mine.collect()]))
        out = found if out is None else out.unionByName(found)
    return out


def _scan(documents: DataFrame, index: Index) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx = shared.value
        for b in batches:
            rows = []
            for k in range(0, b.num_rows, TEXTS):
                part = b.slice(k, TEXTS)
                rows += [(d, *leak) for d, found in zip(part.column(0).to_pylist(), idx.leaks_of(part.column(1).to_pylist())) for leak in found]
            cols = list(zip(*rows)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "covered", "question", "answer"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, item_id bigint, covered double, question double, answer double")


def leaks_found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaked_items(documents, eval_items).select("doc_id", "item_id").distinct()
