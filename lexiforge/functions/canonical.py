"""JSON texts: one canonical form, and references anywhere in them, read without recursion.

The canonical form has sorted keys and no spaces; numbers and strings are written as
ECMAScript writes them: every number is a double (so an integer beyond 2^53 loses its
last digits, -0 is 0, 1e21 has an exponent), and a surrogate without its partner is an
escape. There are two orders of keys: by UTF-16 unit, and by collation.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the form is used, and whether its keys are in the order of a collation.
VARIANTS = {"source": False, "work": False, "bound": True, "revision": True}
TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
LONE = re.compile("[\ud800-\udfff]")


class NotJson(ValueError):
    """A text is no JSON, or has a number beyond the doubles."""


def number(token: str) -> str:
    """A number as ECMAScript writes it: the shortest digits that give the same double."""
    if len(token) < 16 and token.isdigit():
        return token
    value = float(token)
    if value in (float("inf"), float("-inf")):
        raise NotJson(token)
    if value == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    digits, point = "".join(map(str, digits)), len(digits) + exponent
    if len(digits) <= point <= 21:
        out = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = f"{digits[0]}{'.' if digits[1:] else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def quoted(text: str) -> str:
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


class Reader:
    """Reads a JSON text token by token, with a stack of its own; subclasses say what containers and scalars become."""

    def text(self, value: str):
        raise NotImplementedError

    def scalar(self, token: str, is_number: bool):
        raise NotImplementedError

    def key(self, value: str):
        return value

    def listed(self, members: list):
        raise NotImplementedError

    def keyed(self, members: dict):
        raise NotImplementedError

    def read(self, text: str):
        stack: list[tuple] = []  # (members, the key that waits for its value)
        expected, at, key = "value", 0, None
        while (found := TOKEN.match(text, at)) is not None:
            at = found.end()
            mark, string, numeric, word = found.groups()
            if expected == ":":
                if mark != ":":
                    raise NotJson(text[:80])
                expected = "value"
                continue
            if expected in ("key", "key or }"):
                if string:
                    key, expected = self.key(json.loads(string)), ":"
                    continue
                if mark != "}" or expected == "key":
                    raise NotJson(text[:80])
                members, key = stack.pop()
                value = self.keyed(members)
            elif expected == "after":
                members = stack[-1][0]
                if mark == ",":
                    expected = "key" if isinstance(members, dict) else "value"
                    continue
                if mark != ("}" if isinstance(members, dict) else "]"):
                    raise NotJson(text[:80])
                members, key = stack.pop()
                value = self.keyed(members) if isinstance(members, dict) else self.listed(members)
            elif mark in ("[", "{"):
                stack.append(([] if mark == "[" else {}, key))
                expected = "value or ]" if mark == "[" else "key or }"
                continue
            elif mark:
                if mark != "]" or expected != "value or ]":
                    raise NotJson(text[:80])
                members, key = stack.pop()
                value = self.listed(members)
            else:
                value = self.text(json.loads(string)) if string else self.scalar(numeric or word, bool(numeric))
            if not stack:
                if text[at:].strip(" \t\n\r"):
                    raise NotJson(text[:80])
                return value
            if isinstance(stack[-1][0], dict):
                stack[-1][0][key] = value
            else:
                stack[-1][0].append(value)
            expected = "after"
        raise NotJson(text[:80])


class Writer(Reader):
    """Writes the canonical form; ``ranks`` has the places of keys in the order, else it is by UTF-16 unit."""

    def __init__(self, ranks: dict[str, int] | None = None):
        self.order = (lambda k: ranks[k]) if ranks is not None else lambda k: k.encode("utf-16-be", "surrogatepass")

    def text(self, value: str) -> str:
        return quoted(value)

    def scalar(self, token: str, is_number: bool) -> str:
        return number(token) if is_number else token

    def listed(self, members: list[str]) -> str:
        return f"[{','.join(members)}]"

    def keyed(self, members: dict[str, str]) -> str:
        return "{" + ",".join(f"{quoted(k)}:{members[k]}" for k in sorted(members, key=self.order)) + "}"


class Keys(Reader):
    """Collects the distinct keys of all objects, in the order in which they stand."""

    def __init__(self):
        self.found: dict[str, None] = {}

    def key(self, value: str) -> str:
        self.found.setdefault(value)
        return value

    def text(self, value: str) -> None: ...

    def scalar(self, token: str, is_number: bool) -> None: ...

    def listed(self, members: list) -> None: ...

    def keyed(self, members: dict) -> None: ...


class Apart(Exception):
    """A payload that the library doesn't read or write as it must be: the readers above do."""


def unlike_text(token: str) -> int | float:
    """A number as an object that the library writes as ECMAScript would."""
    value = float(token)
    if -1e16 < value < 1e16 and (whole := int(value)) == value:
        return whole
    if value in (float("inf"), float("-inf")):
        raise NotJson(token)
    if 1e16 <= abs(value) < 1e21:
        return int(number(token))
    if abs(value) < 1e-4:
        raise Apart
    return value


def without_repeats(members: list[tuple]) -> dict:
    found = dict(members)
    if len(found) < len(members):
        raise Apart
    return found


def no_number(name: str):
    raise NotJson(name)


DECODER = json.JSONDecoder(object_pairs_hook=without_repeats, parse_int=lambda t: int(t) if len(t) < 16 else unlike_text(t), parse_float=unlike_text, parse_constant=no_number)
ENCODER = json.JSONEncoder(ensure_ascii=False, check_circular=False, separators=(",", ":")).encode


def named(value, found: dict[str, None]) -> None:
    """Adds the keys of all objects, in the order in which they stand."""
    if isinstance(value, dict):
        for key, member in value.items():
            found.setdefault(key)
            if isinstance(member, (dict, list)):
                named(member, found)
    elif isinstance(value, list):
        for member in value:
            if isinstance(member, (dict, list)):
                named(member, found)


def keys_of(payload: str) -> list[str] | None:
    keys = Keys()
    try:
        try:
            named(DECODER.decode(payload), keys.found)
        except (Apart, RecursionError):
            keys = Keys()
            keys.read(payload)
    except ValueError:
        return None
    return list(keys.found)


def keys_in_order(payload: Column, collation: str) -> Column:
    """The numbers of a payload's distinct keys, sorted by the collation; keys that it holds equal, in the order in which the payload first has them."""

    @F.arrow_udf("array<struct<k:string,at:int>>")
    def listed(payloads: pa.Array) -> pa.Array:
        found = [() if p is None else keys_of(p) or () for p in payloads.to_pylist()]
        sizes = np.array([len(k) for k in found], np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(sizes.sum()) - np.repeat(ends - sizes, sizes)
        keys = pa.array([x if x.isascii() else LONE.sub("\ufffd", x) for k in found for x in k], pa.string())
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays([keys, pa.array(at, pa.int32())], ["k", "at"]))

    # a cast gives the keys their order: Spark can't put a Python function over a lambda over another
    return F.sort_array(listed(payload).cast(f"array<struct<k:string collate {collation},at:int>>")).getField("at")


@lru_cache(4096)
def by_unit(keys: tuple[str, ...]) -> list[str]:
    return sorted(keys, key=Writer().order)


@lru_cache(1024)
def by_rank(keys: tuple[str, ...], order: tuple[int, ...]):
    """Sorts an object's keys as ``order`` has the places of a payload's ``keys``; payloads often have the same."""
    ranks = {keys[at]: rank for rank, at in enumerate(order)}
    return lru_cache(256)(lambda members: sorted(members, key=ranks.__getitem__))


def arranged(value, order):
    """The value with the keys of all objects in the ``order``, a function of them."""
    if isinstance(value, dict):
        return {k: arranged(m, order) if isinstance(m := value[k], (dict, list)) else m for k in order(tuple(value))}
    return [arranged(m, order) if isinstance(m, (dict, list)) else m for m in value] if isinstance(value, list) else value


def escaped_lone(text: str) -> str:
    return text if text.isascii() else LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(payload: str | None, order: list[int] | None = None) -> str | None:
    """The canonical form, with the keys by the ``order`` of their numbers; null if the text is no JSON.

    The library reads and writes it, or, where it is too deep, or has repeated keys or tiny numbers, the readers above.
    """
    if payload is None:
        return None
    try:
        try:
            return written(DECODER.decode(payload), order)
        except (Apart, RecursionError):
            return read_apart(payload, order)
    except ValueError:
        return None


def written(value, order: list[int] | None) -> str:
    if order is None:
        return escaped_lone(ENCODER(arranged(value, by_unit)))
    found: dict[str, None] = {}
    named(value, found)
    return escaped_lone(ENCODER(arranged(value, by_rank(tuple(found), tuple(order)))))


def read_apart(payload: str, order: list[int] | None) -> str:
    if order is None:
        return Writer().read(payload)
    keys = keys_of(payload) or []
    return Writer({keys[at]: rank for rank, at in enumerate(order)}).read(payload)


def canonical_forms(payload: str | None, order: list[int]) -> tuple[str | None, str | None]:
    """The forms by UTF-16 unit and by the ``order``, of a payload that is read once."""
    if payload is None:
        return None, None
    try:
        try:
            value = DECODER.decode(payload)
            return written(value, None), written(value, order)
        except (Apart, RecursionError):
            return read_apart(payload, None), read_apart(payload, order)
    except ValueError:
        return None, None


def canonical_json(payload: Column, variant: str, collation: str = "UNICODE") -> Column:
    """The canonical form of a JSON text of any depth; null if it is none or has a number that isn't finite."""
    if not VARIANTS[variant]:

        @F.arrow_udf("string")
        def units(payloads: pa.Array) -> pa.Array:
            return pa.array(map(canonical, payloads.to_pylist()), pa.string())

        return units(payload)

    @F.arrow_udf("string")
    def by_letter(payloads: pa.Array, orders: pa.Array) -> pa.Array:
        return pa.array((canonical(p, o or []) for p, o in zip(payloads.to_pylist(), orders.to_pylist())), pa.string())

    return by_letter(payload, keys_in_order(payload, collation))


def canonical_json_forms(payload: Column, collation: str = "UNICODE") -> Column:
    """(unit, letter): both canonical forms of a JSON text, with the keys by UTF-16 unit and by the collation; null if it is none."""

    @F.arrow_udf("unit string, letter string")
    def both(payloads: pa.Array, orders: pa.Array) -> pa.Array:
        forms = [canonical_forms(p, o or []) for p, o in zip(payloads.to_pylist(), orders.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in forms], pa.string()) for i in range(2)], ["unit", "letter"])

    return both(payload, keys_in_order(payload, collation))


#: A text of hexadecimal digits in groups of 8, 4, 4, 4 and 12, of version 1 to 8.
REFERENCE = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
#: A payload without such a run, or an escape that may hide one, has no reference.
MAY_REFER = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|\\u00"


class References(Keys):
    """Collects the texts, not the keys, that are references."""

    def key(self, value: str) -> str:
        return value

    def text(self, value: str) -> None:
        if len(value) == 36 and REFERENCE.fullmatch(low := value.lower()):
            self.found.setdefault(low)


def references_of(payload: str | None) -> list[str]:
    """The references of a payload; the library reads it, or, where it is too deep for that, the reader without recursion."""
    reader, todo = References(), []
    try:
        todo.append(json.loads(payload or "", parse_constant=no_number, parse_int=len, parse_float=len))
        while todo:
            value = todo.pop()
            if isinstance(value, str):
                reader.text(value)
            elif isinstance(value, list):
                todo += value
            elif isinstance(value, dict):
                todo += value.values()
    except RecursionError:
        reader = References()
        try:
            reader.read(payload or "")
        except NotJson:
            return []
    except ValueError:
        return []
    return list(reader.found)


def references(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, reference) of all texts, at any depth of the payload, that are references, in lower case.

    Only payloads that may have one are read, each once. Payloads that are no JSON have none.
    """

    @F.arrow_udf("array<string>")
    def found(payloads: pa.Array) -> pa.Array:
        return pa.array(map(references_of, payloads.to_pylist()), pa.list_(pa.string()))

    return rows.where(F.col(payload).rlike(MAY_REFER)).select(key, F.explode(found(F.col(payload))).alias("reference")).distinct()
