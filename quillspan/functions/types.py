"""Value kinds, the parsing guards shared by driver and executors, and custom types.

Strings count as numbers or dates only in the forms that the guards let through, so
that Spark's more generous casts never widen a comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_D = r"[0-9]+(?:_[0-9]+)*"
NUMBER = rf"(?i)^[+-]?(?:(?:{_D}\.?(?:{_D})?|\.{_D})(?:e[+-]?{_D})?)\s*$"
SIGNED_WORD = r"(?i)^[+-](?:inf|infinity|nan)\s*$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{3}(?:[0-9]{3})?)?)?)?)?$"
COMPACT = r"^[0-9]{8}$"
_NUMBER, _SIGNED, _DATE, _COMPACT = (re.compile(p) for p in (NUMBER, SIGNED_WORD, DATE, COMPACT))


def number_of(text: str) -> float | None:
    """The number a string stands for, on the driver."""
    if _NUMBER.match(text) or _SIGNED.match(text):
        try:
            return float(text)
        except ValueError:
            return None
    return None


def date_of(text: str) -> datetime | None:
    if _DATE.match(text) or _COMPACT.match(text):
        try:
            return datetime.fromisoformat(text)
        except ValueError:
            return None
    return None


_EITHER = "(?i)" + NUMBER.removeprefix("(?i)") + "|" + SIGNED_WORD.removeprefix("(?i)")


def number_column(text: Column) -> Column:
    """The same for a column: double, or null.  The text is evaluated once."""
    return F.regexp_replace(F.regexp_extract(text, _EITHER, 0), r"[_\s]", "").try_cast("double")


def date_column(text: Column) -> Column:
    """timestamp_ntz, or null; compact dates and bare hours are completed first."""
    dashed = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    full = F.regexp_replace(dashed, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2})$", "$1:00")
    return F.regexp_extract(full, DATE, 0).try_cast("timestamp_ntz")


@dataclass(frozen=True)
class TypeHandler:
    """A custom type.  ``parse`` takes strings only; ``compare(left, right, op)`` overrides every comparison.

    ``parse_column`` keeps the parsing inside Catalyst; otherwise both run as UDFs
    (``key`` names the Spark type of parsed values that can be ordered directly).
    """

    name: str
    parse: Callable[[str], Any]
    compare: Callable[[Any, Any, str], bool] | None = None
    parse_column: Callable[[Column], Column] | None = None


def handler_of(name: str, h: Any) -> TypeHandler:
    if isinstance(h, TypeHandler):
        return h
    if isinstance(h, type):
        h = h()
    if hasattr(h, "parse"):
        return TypeHandler(name, h.parse, getattr(h, "compare", None), getattr(h, "parse_column", None))
    return TypeHandler(name, h)
