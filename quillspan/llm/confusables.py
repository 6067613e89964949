"""One consistent form for text that looks alike.

``skeleton`` decomposes (compatibility), drops invisible characters, makes every
blank a plain one, replaces look-alike letters by their prototype and decomposes
again.  Letter case, accents, digits, raised digits, punctuation marks and word
order survive.  Payloads of equal skeleton and different data form the pairs.

Null, empty and blank data (also data of invisible characters only) is no case;
redelivered rows count once; one id delivered with two texts isn't paired with itself.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letter each looks like (its prototype).
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "օ": "o", "Տ": "S", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
    "Ѵ": "V", "ѵ": "v", "ɑ": "a", "ɡ": "g", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲭ": "X",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M",
    "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
# Raised digits and signs, which stay different from plain ones.
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"
# Ranges of characters that show nothing, besides those of category Cf.
INVISIBLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or any(a <= ord(ch) <= b for a, b in INVISIBLE)


class _Prototypes(dict):
    """Code point -> prototype, derived by rule when a character is first met."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        if ch in RAISED:
            out = ch
        elif _invisible(ch):
            out = ""
        elif ch in "\t\v\f" or unicodedata.category(ch) == "Zs":
            out = " "
        else:
            out = "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", ch) if not _invisible(c))
        self[cp] = out
        return out


_PROTOTYPES = _Prototypes()


def skeleton(text: str | None) -> str | None:
    """The form that texts of one look share; None for null."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ").replace("\v", " ").replace("\f", " ")
    # after the replacement only canonical order and composed raised signs are left to settle
    return unicodedata.normalize("NFD", text.translate(_PROTOTYPES))


@F.pandas_udf(T.StringType())
def skeleton_udf(data: pd.Series) -> pd.Series:
    return data.map(skeleton, na_action="ignore")


def look_key(text: str) -> bytes | None:
    """128 bits of the skeleton; None for what shows nothing."""
    s = skeleton(text)
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() if s and not s.isspace() else None


def keyed_payloads(payloads: DataFrame) -> DataFrame:
    """(payload_id, d, k) once each: 128 bits of the data and of its skeleton, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keys = [look_key(t) for t in texts]
            use = [i for i, k in enumerate(keys) if k is not None]
            data = [hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in use]
            ids = b.column(0).take(pa.array(use, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary()), pa.array([keys[i] for i in use], pa.binary())], names=["payload_id", "d", "k"])

    text = payloads.where((F.col("modality") == "text") & F.col("data").isNotNull() & F.col("payload_id").isNotNull())
    keyed = text.select(F.col("payload_id").cast("bigint").alias("payload_id"), "data").mapInArrow(run, "payload_id bigint, d binary, k binary")
    # said here once, or each join infers its own and the uses no longer share one exchange
    return keyed.where("k is not null and d is not null and payload_id is not null").groupBy("k", "d", "payload_id").agg(F.lit(1).alias("once"))


def canonical_payloads(payloads: DataFrame) -> DataFrame:
    """Every text payload once, with its consistent form as ``skeleton`` (null stays null)."""
    text = payloads.where(F.col("modality") == "text").select("payload_id", "data").distinct()
    return text.withColumn("skeleton", skeleton_udf("data"))


def lookalike_pairs(payloads: DataFrame) -> DataFrame:
    """(payload_a, payload_b), a < b: text payloads of different data and one skeleton.

    The texts are read and their skeletons made once: the shuffle carries two 128-bit
    keys and the id, never the text, and its output serves all three uses below.
    Variants (distinct texts) of a skeleton are paired first and only skeletons with
    several are; the ids of a variant join on after that, so a text with a third of all
    ids is neither collected nor joined with itself, and its partition can be split as skewed.
    """
    keyed = keyed_payloads(payloads)
    variants = keyed.groupBy("k", "d").agg(F.count("*").alias("ids")).where("ids > 0")  # asked for, else the plan takes another way to them
    several = variants.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    variants = variants.join(several, "k", "left_semi").select("k", "d")
    a, b = variants.select("k", F.col("d").alias("da")), variants.select("k", F.col("d").alias("db"))
    both = a.join(b, "k").where(F.col("da") < F.col("db")).select("da", "db", "k")
    left = keyed.select(F.col("k"), F.col("d").alias("da"), F.col("payload_id").alias("ia"))
    right = keyed.select(F.col("k"), F.col("d").alias("db"), F.col("payload_id").alias("ib"))
    pairs = both.join(left, ["k", "da"]).join(right, ["k", "db"]).where(F.col("ia") != F.col("ib"))
    return pairs.select(F.least("ia", "ib").alias("payload_a"), F.greatest("ia", "ib").alias("payload_b")).distinct()


def lookalike_classes(payloads: DataFrame) -> DataFrame:
    """(payload_id, look, variant): membership instead of pairs, linear in the rows however hot a form is.

    ``look`` names the form, ``variant`` the text; only forms with several texts come out.
    """
    keyed = keyed_payloads(payloads)
    several = keyed.groupBy("k", "d").agg(F.count("*").alias("ids")).groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return keyed.join(several, "k", "left_semi").select("payload_id", F.hex("k").alias("look"), F.hex("d").alias("variant"))
