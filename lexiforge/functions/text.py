"""Text functions: folds, counts in localized digits, URLs, shards, normal forms, word runs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed letters of the sort fold: what is dropped, and what maps to what.
DROPPED_MARKS = "ـًٌٍَُِّْٰ"
FOLDED_FROM = "أإآٱىؤئ"
FOLDED_TO = "اااايوي"
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
GROUP_SEPARATORS = ",٬’'  "
SHARD_MODULUS, SHARDS = 2147483647, 16


def normal(text: Column, form: str) -> Column:
    """A Unicode normal form; no built-in function has it."""

    @F.pandas_udf("string")
    def normalized(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t), na_action="ignore")

    return normalized(text)


def sort_fold(text: Column) -> Column:
    """Marks are dropped and letter variants made one, for ordering names."""
    return F.translate(text, FOLDED_FROM + DROPPED_MARKS, FOLDED_TO)


def search_fold(text: Column) -> Column:
    """NFKC, lower case, no marks, one form of each letter, single spaces."""
    lower = F.lower(normal(text, "NFKC"))
    plain = F.regexp_replace(normal(lower, "NFD"), r"\p{Mn}", "")
    letters = F.translate(plain, "یکىةـ", "يكيه")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def localized_count(text: Column, maximum: int = 10_000_000) -> Column:
    """The one number in ``text``, in any of three scripts' digits; null if there is none, more than one, or it is too large."""
    western = F.translate(text, DIGITS_FROM, DIGITS_TO)
    joined = F.regexp_replace(western, rf"(?<=[0-9])[{GROUP_SEPARATORS}](?=[0-9]{{3}})", "")
    numbers = F.regexp_extract_all(joined, F.lit("[0-9]+"), F.lit(0))
    value = F.get(numbers, F.lit(0)).try_cast("long")
    return F.when((F.size(numbers) == 1) & (value <= maximum), value)


def shard(identifier: Column, shards: int = SHARDS) -> Column:
    """A polynomial hash of the code points."""
    step = lambda h, c: (h * 31 + F.ascii(c)) % SHARD_MODULUS
    return (F.aggregate(F.split(identifier, ""), F.lit(0).cast("long"), step) % shards).cast("int")


def escaped(text: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def canonical_url(url: Column) -> Column:
    """Scheme, host in lower case and decoded path without its last slash; query and fragment go."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(F.lit("https://"), host, F.regexp_replace(decoded, r"(?<=.)/\z", ""))


def word_runs(text: Column) -> Column:
    """Runs of letters with their marks."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))


def identity_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by U+001F; null if one is null."""
    return F.sha2(F.concat(*[x for f in fields for x in (f, F.lit("\x1f"))][:-1]), 256)


def backoff(attempt: Column, base: float, cap: float, steps: int = 16) -> Column:
    """Exponential delay with a cap."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(steps))))
