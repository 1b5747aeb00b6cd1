"""Row predicates: safe identities, control characters, generated or refused titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed code points that no shown text may have: 0-8, 11, 12, 14-31, 127, 8234-8238, 8294-8297.
UNSAFE = "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"
#: Phrases with which a generator declines.
REFUSAL = "(?i)(i cannot|i can't|as an ai|unable to translate|no translation|sorry, but)"


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def optional_filters(**chosen) -> list[Column]:
    """Equality or membership for each given name; None leaves a name out."""
    return [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in chosen.items() if v is not None]


def has_unsafe(text: Column) -> Column:
    return text.rlike(UNSAFE)


def safe_identity(text: Column, longest: int = 500) -> Column:
    """1 to ``longest`` characters, no outer spaces, no slash, not a dot name, no unsafe characters."""
    return all_of(F.length(text).between(1, longest), F.trim(text) == text, ~text.isin(".", ".."), ~text.contains("/"), ~has_unsafe(text))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def first_usable(*titles: Column) -> Column:
    """The first title that is not blank and no refusal."""
    return F.coalesce(*[F.when((F.trim(t) != "") & ~t.rlike(REFUSAL), F.trim(t)) for t in titles])


def after(keys: list[tuple[str, bool]], cursor: list) -> Column:
    """Rows behind ``cursor`` in the order of ``keys`` (name, ascending): the page after a seen row."""
    result, equal = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(keys, cursor, strict=True):
        c, v = F.col(name), F.lit(value)
        result = result | equal & ((c > v) if ascending else (c < v))
        equal = equal & (c == v)
    return result


def in_order(keys: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(k).asc() if up else F.col(k).desc() for k, up in keys]
