"""Ingestion operators on text, as Column builders: normalising, splitting, packing, script detection."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RegistryError
from ..functions.registry import GLOBAL

#: sentence ends: western marks before a blank, full-width ones anywhere, line breaks
BOUNDARY = r"(?U)(?<=[.!?])\s+|(?<=[。！？…])\s*|\n+"
CHUNK_CHARS = 1000
#: share of CJK characters above which a text counts as CJK
CJK_SHARE = 0.2


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: [t if t is None else unicodedata.normalize("NFC", t) for t in ts], na_action="ignore")


def nfc_all(texts: Column) -> Column:
    """Composed characters in every text of an array; Python only for rows with one that isn't ASCII."""
    return F.when(F.exists(texts, lambda t: t.rlike(r"[^\x00-\x7F]")), _nfc_each(texts)).otherwise(texts)


def normalize(text: Column, nfc: bool = True) -> Column:
    """Composed characters, single blanks, no empty lines, no blanks around lines; Python only for non-ASCII rows."""
    if nfc:
        text = F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)
    text = F.regexp_replace(text, r"[ \t\x{A0}\x{3000}]+", " ")
    text = F.regexp_replace(text, r"\n{2,}", "\n")
    return strip(F.regexp_replace(text, r"(?Umd)^[^\S\n]+|[^\S\n]+$", ""))


def sentences(text: Column) -> Column:
    """Sentences without blanks around them, none empty."""
    return F.filter(F.transform(F.split(strip(text), BOUNDARY, -1), strip), lambda s: F.length(s) > 0)


def chunks(text: Column, max_chars: int = CHUNK_CHARS) -> Column:
    """Whole sentences packed greedily up to max_chars; a longer sentence stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.length(acc["open"]) + F.length(s) + 1
        full = (acc["open"] != "") & (joined > max_chars)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), s).otherwise(F.concat(acc["open"], F.lit(" "), s)).alias("open"),
        )

    packed = F.aggregate(sentences(text), empty, add, lambda a: F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))
    bare = strip(text)
    return F.when((F.size(packed) == 0) & (bare != ""), F.array(bare)).otherwise(packed)


def whole(text: Column) -> Column:
    """The text as its only piece."""
    return F.array(text)


def script(text: Column) -> Column:
    """``cjk`` or ``latin`` by the share of CJK characters among those that aren't blank."""
    wide = F.length(F.regexp_replace(text, r"[^\x{3000}-\x{9FFF}\x{FF00}-\x{FFEF}]", ""))
    seen = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(wide / F.nullif(seen, F.lit(0)) > CJK_SHARE, "cjk").otherwise("latin")


def by_script(**splitters: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A splitter that routes by script; ``default`` for scripts without their own."""

    def route(text: Column) -> Column:
        out = splitters.get("default", sentences)(text)
        for name, f in splitters.items():
            if name != "default":
                out = F.when(script(text) == name, f(text)).otherwise(out)
        return out

    return route


def pysbd_sentences(language: str = "en") -> Callable[[str], list[str]]:
    """A Python splitter by the pysbd library, where that is installed; for ``register_splitter(..., python=...)``."""

    def split(text: str) -> list[str]:
        try:
            from pysbd import Segmenter
        except ImportError as e:
            raise RegistryError("this splitter needs pysbd, which isn't installed") from e
        return [s.strip() for s in Segmenter(language=language, clean=False).segment(text) if s.strip()]

    return split


GLOBAL.splitter("SENTENCE", build=sentences)
GLOBAL.splitter("CHUNK", build=chunks)
GLOBAL.splitter("DOCUMENT", build=whole)
