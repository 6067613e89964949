"""Cutting oversized payloads at natural boundaries, with overlap.

The text is measured once: prefix sums over visible characters give the places where
a cut is possible at all, sorted arrays hold the natural boundaries (sentence and line
ends first, then blanks and end marks).  Each piece ends at the last boundary under its
limit, found by binary search; the next one starts at the first boundary after stepping
back by the overlap.  Where no boundary is in reach the cut is forced, between two
visible characters.

Null, empty and blank payloads give no unit; a text of exactly the limit is one unit;
a profile that isn't listed counts as ``default``; a single visible character longer
than the limit is the only thing ever cut through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import current_documents, text_payloads
from .sentences import sentence_spans

#: kind, max_chars and overlap_chars where the profile table has no ``default``
FALLBACK = ("chunk", 1000, 100)
MOST_PROFILES = 10_000
# Marks that end a sentence and so a run without a boundary.
MARKS = ".!?。！？…।؟"
_STOPS = re.compile(rf"[\s{re.escape(MARKS)}]+")
_MARKS = re.compile(rf"[{re.escape(MARKS)}]+")
_BLANKS = re.compile(r"\s+")


def visible_offsets(text: str) -> list[int] | range:
    """Sorted offsets at which a visible character starts or the text ends."""
    if text.isascii() and "\r" not in text:
        return range(len(text) + 1)
    return [0, *accumulate(map(len, regex.findall(r"\X", text)))]


class Boundaries:
    """The places where a text may be cut, as sorted arrays, found once a text."""

    def __init__(self, text: str):
        self.n = n = len(text)
        self.visible = visible_offsets(text)
        allowed = self.visible.__contains__ if isinstance(self.visible, range) else set(self.visible).__contains__
        spans = sentence_spans(text)
        stops = [m.span() for m in _STOPS.finditer(text)]  # blanks and end marks, each run of them once
        self.gap_starts = [0, *(b for _, b in stops)]
        self.gap_ends = [*(a for a, _ in stops), n]
        self.sentences = [b for _, b in spans if allowed(b)]
        blanks = [m.span() for m in _BLANKS.finditer(text)]
        marks = [m.end() for m in _MARKS.finditer(text) if allowed(m.end())]
        self.weak = sorted({*(a for a, _ in blanks if allowed(a)), *marks})
        self.begins = sorted({*(a for a, _ in spans if allowed(a)), *(b for _, b in blanks if allowed(b)), *(e for e in marks if e < n and not text[e].isspace())})

    def longest_run(self) -> int:
        """Most characters in a row without a blank, line break or sentence-ending mark: the widest gap."""
        return max(b - a for a, b in zip(self.gap_starts, self.gap_ends))

    def last_end(self, after: int, top: int) -> int:
        """The last boundary above ``after`` and not above ``top``, sentence ends first; 0 if there is none."""
        for ends in (self.sentences, self.weak):
            k = bisect_right(ends, top)
            if k and ends[k - 1] > after:
                return ends[k - 1]
        k = bisect_right(self.gap_ends, top)  # before an end mark that just doesn't fit any more
        e = self.gap_ends[k - 1] if k else 0
        return e if after < e < self.n and self.is_visible(e) else 0

    def is_visible(self, at: int) -> bool:
        k = bisect_left(self.visible, at)
        return k < len(self.visible) and self.visible[k] == at


def pieces(text: str, limit: int, overlap: int, where: Boundaries | None = None) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of at most ``limit`` code points.

    An overlap that would leave no boundary in reach is given up before a run is cut.
    """
    n = len(text)
    begin, stop = n - len(text.lstrip()), len(text.rstrip())
    if begin >= stop:
        return []
    limit = max(1, limit)
    overlap = min(max(0, overlap), limit - 1)
    if n <= limit:
        return [(begin, stop)]
    at = where or Boundaries(text)
    visible = at.visible
    out: list[tuple[int, int]] = []
    reached = after = begin  # end of the last piece, and where the text goes on behind it
    while True:
        top = begin + limit
        if stop <= top:
            out.append((begin, stop))
            return out
        end = at.last_end(reached, top)
        if not end and begin < after:
            end = at.last_end(reached, after + limit)
            if end:  # without the overlap, or with less of it, a boundary is in reach
                k = bisect_left(at.begins, end - limit)
                begin = at.begins[k] if k < len(at.begins) and at.begins[k] <= after else after
        if not end:  # no boundary in reach
            end = visible[bisect_right(visible, top) - 1]
            if end <= reached:
                end = top
        while end > begin + 1 and text[end - 1].isspace():
            end -= 1
        if end <= reached:  # only blanks in reach beyond what the last piece had: no overlap here
            begin = after = reached + len(text[reached:]) - len(text[reached:].lstrip())
            continue
        out.append((begin, end))
        reached = after = end
        if reached >= stop:
            return out
        while after < stop and text[after].isspace():
            after += 1
        back = max(end - overlap, begin + 1)
        if overlap:
            k = bisect_left(at.begins, back)
            begin = at.begins[k] if k < len(at.begins) and at.begins[k] <= after else after
            if begin >= after and not any(map(str.isspace, text[back:after])):
                # inside a run without boundaries the overlap starts between two visible characters
                begin = min(after, visible[bisect_left(visible, back)])
        else:
            begin = after


def cut(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int]], int]:
    """The pieces, and 1 if a run between two boundaries of the text is longer than the limit."""
    if len(text) <= limit:
        return pieces(text, limit, overlap), 0
    where = Boundaries(text)
    return pieces(text, limit, overlap, where), int(where.longest_run() > limit)


SCHEMA = "doc_key string, payload_no int, kind string, ordinal int, start_pos int, end_pos int, data string, n_chars int, max_chars int, forced int"
_ARROW = pa.schema(
    [("doc_key", pa.string()), ("payload_no", pa.int32()), ("kind", pa.string()), ("ordinal", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("data", pa.string())]
    + [(n, pa.int32()) for n in ("n_chars", "max_chars", "forced")]
)


def profiles(split_profiles: DataFrame) -> dict[str, tuple[str, int, int]]:
    """The profile table, which must be a small one."""
    rows = split_profiles.where("profile is not null and max_chars is not null").limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} split profiles")
    table = {r.profile: (r.kind or FALLBACK[0], int(r.max_chars), int(r.overlap_chars or 0)) for r in sorted(rows, key=lambda r: (r.profile, r.max_chars), reverse=True)}
    return {"default": FALLBACK} | table


def split_units(store_docs: DataFrame, split_profiles: DataFrame, with_text: bool = True, blanks: bool = False) -> DataFrame:
    """Units of every text payload of the current versions; ordinals run through a document's payloads.

    With ``blanks`` a payload over its limit that gives no unit has one empty row.
    """
    table = profiles(split_profiles)
    docs = current_documents(store_docs).select(
        "doc_key", "profile", F.expr("transform(payloads, p -> if(p.modality = 'text', p.data, null))").alias("texts")
    ).where(F.size("texts") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                kind, limit, overlap = table.get(r["profile"] or "default", table["default"])
                ordinal = 0
                for no, text in enumerate(r["texts"]):
                    if not text:
                        continue
                    cuts, forced = cut(text, limit, overlap)
                    part = {"doc_key": r["doc_key"], "payload_no": no, "kind": kind, "n_chars": len(text), "max_chars": limit, "forced": forced}
                    if blanks and not cuts and len(text) > limit:
                        rows.append(part | {"ordinal": None, "start_pos": 0, "end_pos": 0, "data": None})
                    for a, b in cuts:
                        rows.append(part | {"ordinal": ordinal, "start_pos": a, "end_pos": b, "data": text[a:b] if with_text else None})
                        ordinal += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.mapInArrow(run, SCHEMA)


def oversized_payloads(store_docs: DataFrame, split_profiles: DataFrame) -> DataFrame:
    """The payloads that were over their limit, from their units; every piece is held against the limit.

    A piece that breaks it ends the query with an error instead of leaving a row out.
    A blank payload has no unit but counts, with nothing forced.
    """
    units = split_units(store_docs, split_profiles, with_text=False, blanks=True)
    over = units.where(F.col("n_chars") > F.col("max_chars"))
    size = F.col("end_pos") - F.col("start_pos")
    kept = F.when(size > F.col("max_chars"), F.raise_error(F.concat(F.lit("a piece over its limit in "), "doc_key"))).otherwise(F.col("forced"))
    return over.groupBy("doc_key", "payload_no").agg(F.max(kept.cast("int")).alias("forced"))


def coverage(store_docs: DataFrame, split_profiles: DataFrame) -> DataFrame:
    """What the units of each payload keep: (doc_key, payload_no, first_pos, last_pos, within, gapless, overlapping).

    ``within``: none is over the limit; ``gapless``: only blanks lie between two units;
    ``overlapping``: none shares more than ``overlap_chars`` with the one before.
    """
    units = split_units(store_docs, split_profiles, with_text=False)
    before = Window.partitionBy("doc_key", "payload_no").orderBy("ordinal")
    table = profiles(split_profiles)
    texts = text_payloads(current_documents(store_docs), "profile")
    overlap = F.create_map(*[F.lit(x) for k, (_, _, o) in table.items() for x in (k, o)])
    mine = F.coalesce(F.try_element_at(overlap, F.coalesce("profile", F.lit("default"))), F.lit(table["default"][2]))
    rows = units.withColumn("prev", F.lag("end_pos").over(before)).join(texts.select("doc_key", "payload_no", F.col("data").alias("text"), mine.alias("o")), ["doc_key", "payload_no"])
    gap = F.when(F.col("start_pos") > F.col("prev"), F.expr("substring(text, prev + 1, start_pos - prev)")).otherwise("")
    return rows.groupBy("doc_key", "payload_no").agg(
        F.min("start_pos").alias("first_pos"), F.max("end_pos").alias("last_pos"), F.every(F.col("end_pos") - F.col("start_pos") <= F.col("max_chars")).alias("within"),
        F.every(F.coalesce(gap.rlike(r"(?U)\A\s*\z"), F.lit(True))).alias("gapless"), F.every(F.coalesce(F.col("prev") - F.col("start_pos") <= F.col("o"), F.lit(True))).alias("overlapping"),
    )
