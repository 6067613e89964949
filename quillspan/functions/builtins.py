"""The built-in functions, all Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from .registry import GLOBAL, Signature


def contains(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))


def count(text: Column, needle: Column) -> Column:
    """Occurrences that don't overlap, case apart; none of an empty needle."""
    t, n = F.lower(text), F.lower(needle)
    found = F.floor((F.length(t) - F.length(F.replace(t, n, F.lit("")))) / F.nullif(F.length(n), F.lit(0)))
    return F.when(text.isNull() | needle.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.lit(0))).cast("bigint")


def like_pattern(pattern: str) -> str:
    """% and _ are the only wildcards; a backslash is itself."""
    return pattern.replace("\\", "\\\\")


def like(text: Column, pattern: Column) -> Column:
    return F.call_function("like", text, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


_UNSUPPORTED = re.compile(r"\(\?\(|\(\?#|\(\?P>|\(\?[aLu]+[):]")


def java_pattern(pattern: str) -> str:
    """A Python pattern in Java's dialect, its classes Unicode ones; what Java can't express is refused."""
    if _UNSUPPORTED.search(pattern):
        raise PlanError(f"MATCH can't express {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise PlanError(f"bad pattern {pattern!r}: {e}") from e
    p = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'u')}>", pattern)
    p = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', 'u')}>", p)
    return "(?U)" + p.replace(r"\Z", r"\z")


def match(text: Column, pattern: Column) -> Column:
    return F.rlike(text, pattern)


TEXT1, TEXT2 = Signature(("text",), "string"), Signature(("text", "text"), "boolean")
GLOBAL.function("CONTAINS", TEXT2, build=contains, pushdown=True)
GLOBAL.function("MATCH", TEXT2, build=match)
GLOBAL.function("LIKE", TEXT2, build=like)
GLOBAL.function("LENGTH", Signature(("text",), "bigint"), build=lambda t: F.length(t).cast("bigint"))
GLOBAL.function("COUNT", Signature(("text", "text"), "bigint"), build=count)
GLOBAL.function("LOWER", TEXT1, build=F.lower)
GLOBAL.function("UPPER", TEXT1, build=F.upper)
GLOBAL.function("SIMILARITY", Signature(("any", "text"), "double"), provides_score=True)
