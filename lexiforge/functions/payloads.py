"""Semi-structured payloads: translations, insights, generated titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.predicates import UNSAFE, all_of

# Fixed phrases of failed generations; a line that has one is no translation.
FAILED = ["roses are red", "unable to translate", "cannot translate", "can't translate", "as an ai", "translation guidelines", "translate the following", "provide a summary instead"]
# Fixed patterns of generated titles that are none: * stands for any characters, and the whole title must match.
REJECTED_TITLES = [
    "*here is*translat*", "*ai assistant*", "*unable to translat*",
    "*cannot translat*", "*do not*translat*", "*don't*translat*",
    "*attempt*translat*", "*translated title*", "*from english to arabic*",
    "*you are an arabic*", "i will not*translat*", "i will not*provide*",
    "i have nothing*translat*", "i have nothing*output*",
    "i have not*translat*", "i presume not*translat*",
    "i did not*translat*", "i am not able*translat*",
    "you're right*translat*", "*without proper context*",
    "*copyrighted material*", "*as requested*translat*",
    "*as requested*output*", "*do not speak arabic*",
    "*not attempt to translat*", "*refrain from translat*",
    "*translation capabilities*", "*translation services*",
    "*please provide*arabic*", "*let's have*discussion*",
    "*let's have*conversation*", "*entrust you*translate*",
    "nice try*translate*", "without permission*translate*",
    "translated to *", "titles translated", "my poem translation:",
]
# Fixed patterns of failed generations and of titles that are none, as the catalogue holds texts against them; letter case doesn't count.
FAILED_PATTERN = r"(?:roses are red|unable to translate|cannot translate|can't translate|i(?:'| a)m sorry.{0,80}translat|as an ai|translation guidelines|translate the following|provide (?:a )?summary instead)"
TITLE_PATTERN = (
    r"(?:i (?:do not|don't).{0,80}translat|i (?:have )?translated|i have (?:chosen|given|made).{0,80}translat|i(?:'m| am) an ai|assistant created by|here(?:'s| is).{0,100}(?:attempt|english|translat)"
    r"|english translation|arabic poem title|title translated|from english to arabic|you are an arabic|attempt at translat|^i (?:will not|have nothing|have not|presume not|did not|am not able).{0,180}(?:translat|output|provide|copyright|permission|context)"
    r"|^you(?:'re| are) right.{0,180}translat|^translated to\b|^titles? translated(?: to english)?$|^my poem translation:?$|without proper context|copyrighted material|let's have (?:a |an )?(?:engaging|respectful|thoughtful) (?:conversation|discussion)"
    r"|please provide (?:an |the )?(?:arabic|english|translation)|as requested.{0,120}(?:output|translat)|do not speak arabic|don't speak arabic|not attempt to translat|refrain from translat|kept the translated poem private"
    r"|translation capabilities|translation services|rough translation of the title|entrust you.{0,80}translate|nice try.{0,80}translate|without permission.{0,80}(?:translate|copyright)|my friend.{0,120}(?:cannot provide|thoughtful discussion))"
)
#: Longest line, text and title.
LINE, TEXT, TITLE = 5000, 20_000, 200


def is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def items(v: Column, path: str) -> Column:
    """The array at ``path`` as variants; null if there is none."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


#: A phrase of a failed generation, or an apology with a translation anywhere else.
FAILED_LINE = "|".join([*map(re.escape, FAILED), r"i'm sorry(?s:.*)translat", r"translat(?s:.*)i'm sorry"])


def failed_line(text: Column) -> Column:
    return F.lower(text).rlike(FAILED_LINE)


def valid_translation(payload: Column, source_lines: Column) -> Column:
    """``content`` is an array of 1 to 2000 texts, no more than the source has lines, none too long, unsafe or a refusal, one at least not blank."""
    # each line is read once; what is no text becomes null
    lines = F.transform(items(F.try_parse_json(payload), "$.content"), lambda x: F.when(is_text(x), as_text(x)))
    good = lambda t: F.coalesce((F.length(t) <= LINE) & ~t.rlike(UNSAFE) & ~failed_line(t), F.lit(False))
    judged = F.transform(F.array(lines), lambda t: all_of(F.size(t).between(1, 2000), F.size(t) <= source_lines, F.forall(t, good), F.exists(t, lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))))
    return F.coalesce(judged[0], F.lit(False))


def valid_insights(payload: Column) -> Column:
    """An object of exactly six keys: three texts, two arrays of texts, and an array of objects of exactly two texts."""
    v = F.try_parse_json(payload)
    sized = lambda t: F.coalesce(F.length(F.trim(t)).between(1, TEXT) & ~t.rlike(UNSAFE), F.lit(False))
    text_at = lambda x, path: is_text(F.try_variant_get(x, path, "variant")) & sized(F.try_variant_get(x, path, "string"))
    checks = [F.size(F.json_object_keys(payload)) == 6]
    checks += [text_at(v, f"$.{name}") for name in ("summary", "historicalContext", "culturalSignificance")]
    for name in ("themes", "literaryDevices"):
        own = items(v, f"$.{name}")
        checks += [F.size(own).between(1, 100), F.forall(own, lambda x: is_text(x) & sized(as_text(x)))]
    notable = items(v, "$.notableLines")
    pair = lambda x: F.coalesce(F.size(F.json_object_keys(F.to_json(x))) == 2, F.lit(False)) & text_at(x, "$.line") & text_at(x, "$.explanation")
    checks += [F.size(notable).between(1, 100), F.forall(notable, pair)]
    return F.coalesce(all_of(*checks), F.lit(False))


def glob(pattern: str) -> str:
    """A GLOB pattern as an anchored regular expression: * any characters, ? one, [a-f], [^a-f] one of a class.

    As in SQL, a class has no escapes; a ] stands for itself as its first character, and a [ without an end matches nothing.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "[":
            first = at + 1 + (pattern[at + 1 : at + 2] == "^")
            end = pattern.find("]", first + 1)
            if end < 0:
                return r"(?!)"
            inside = re.sub(r"([\\\[\]^&])", r"\\\1", pattern[first:end])
            out.append(f"[{'^' if first > at + 1 else ''}{inside}]")
            at = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return rf"(?s)\A{''.join(out)}\z"


def usable_title(title: Column) -> Column:
    """Not blank, one line, at most TITLE characters without outer spaces, no unsafe characters, no failed generation."""
    rejected = F.lower(title).rlike("|".join(map(glob, REJECTED_TITLES)))
    checks = all_of(F.trim(title) != "", F.length(F.trim(title)) <= TITLE, ~title.rlike(r"[\r\n]"), ~title.rlike(UNSAFE), ~failed_line(title), ~rejected)
    return F.coalesce(checks, F.lit(False))


def usable_in_catalogue(title: Column) -> Column:
    """As ``usable_title``, but by the catalogue's two patterns, with their bounded gaps; outer spaces don't count."""
    own = F.trim(title)
    checks = all_of(F.length(own).between(1, TITLE), ~own.rlike(r"[\r\n]"), ~own.rlike(UNSAFE), ~own.rlike(f"(?iu){FAILED_PATTERN}"), ~own.rlike(f"(?iu){TITLE_PATTERN}"))
    return F.coalesce(checks, F.lit(False))
