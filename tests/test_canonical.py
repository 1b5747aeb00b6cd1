"""JSON in canonical form, and references in payloads of any depth."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.canonical import VARIANTS, Keys, NotJson, Writer, canonical, canonical_forms, canonical_json, keys_of, number, references

# Numbers as ECMAScript writes them.
NUMBERS = {
    "-0": "0", "-0.0": "0", "0e5": "0", "1.0": "1", "12.50": "12.5", "9007199254740993": "9007199254740992", "1e20": "100000000000000000000", "1e21": "1e+21", "123456789012345678901234": "1.2345678901234569e+23",
    "0.000001": "0.000001", "0.0000001": "1e-7", "1.5E-10": "1.5e-10", "5e-324": "5e-324", "1.7976931348623157e308": "1.7976931348623157e+308", "-1e-400": "0", "0.1": "0.1", "-12": "-12",
}
# (payload, keys by unit, keys by collation); None where the text is no JSON.
FORMS = [
    ('{"_":1,"1":2}', '{"1":2,"_":1}', '{"_":1,"1":2}'),
    ('{"f":1,"é":2,"e":3}', '{"e":3,"f":1,"é":2}', '{"e":3,"é":2,"f":1}'),
    ('{"B":1,"a":2,"A":3,"b":4}', '{"A":3,"B":1,"a":2,"b":4}', '{"a":2,"A":3,"b":4,"B":1}'),
    ('{"\\uff5e":1,"\\ud83d\\ude00":2}', '{"😀":2,"～":1}', '{"～":1,"😀":2}'),
    ('["\\ud800","\\ude00\\ud800",{"\\udfff":1}]', '["\\ud800","\\ude00\\ud800",{"\\udfff":1}]', '["\\ud800","\\ude00\\ud800",{"\\udfff":1}]'),
    ('{"a":1,"a":2,"\\u0061":3}', '{"a":3}', '{"a":3}'),
    (' [ "\\u001f\\u007f\\u2028\\/" , {} , [ ] ] ', '["\\u001f\x7f\u2028/",{},[]]', '["\\u001f\x7f\u2028/",{},[]]'),
    ('{"x":{"b":[{"d":1,"c":null}],"a":true}}', '{"x":{"a":true,"b":[{"c":null,"d":1}]}}', '{"x":{"a":true,"b":[{"c":null,"d":1}]}}'),
    ("7", "7", "7"),
    *[(bad, None, None) for bad in ("", " ", '{"a":1,}', "[1,]", "[1 2]", '{"a"}', "[1]]", "01", '"\x01"', '{"a":1 "b":2}', "nul", "1e999", "[", '{"a":[}', "NaN", "'a'", None)],
]


@pytest.mark.parametrize(("token", "written"), NUMBERS.items())
def test_numbers(token, written):
    assert number(token) == written


def test_a_number_beyond_the_doubles():
    with pytest.raises(NotJson):
        number("1e309")


def test_numbers_keep_their_value():
    draw = random.Random(3)
    for _ in range(2000):
        value = draw.uniform(-1, 1) * 10 ** draw.randint(-320, 308)
        assert float(number(repr(value))) == value


def test_forms_in_both_orders(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(FORMS)], "id int, p string")
    found = rows.select("id", *[canonical_json(F.col("p"), v).alias(v) for v in VARIANTS]).orderBy("id").collect()
    for (_, unit, letter), row in zip(FORMS, found):
        assert (row.source, row.work, row.bound, row.revision) == (unit, unit, letter, letter)


def test_deep_payloads_are_read_without_recursion(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert canonical(deep) == deep
    assert canonical('{"k":' * 5000 + "1" + "}" * 5000) == '{"k":' * 5000 + "1" + "}" * 5000


def uuid(i):
    return f"{i:08x}-0000-4000-8000-000000000000"


def test_references_at_any_depth(spark):
    made = [
        (1, "[" * 5000 + f'"{uuid(1)}"' + "]" * 5000),
        (2, json.dumps({"a": [{uuid(2): uuid(3).upper()}, f" {uuid(4)}", uuid(5) + "0"], "b": uuid(3)})),
        (3, '["\\ud800", "' + "".join(f"\\u{ord(c):04x}" for c in uuid(6)) + '"]'),
        (4, f'["{uuid(7)}"'),
        (5, None),
        (6, f'"{uuid(8)}"'),
        (7, json.dumps([uuid(9).replace("-4", "-9"), uuid(9).replace("-8", "-c")])),
        (6, f'["{uuid(8)}"]'),
    ]
    found = references(spark.createDataFrame(made, "id long, p string"), "id", "p").collect()
    assert sorted((r.id, r.reference) for r in found) == [(1, uuid(1)), (2, uuid(3)), (3, uuid(6)), (6, uuid(8))]
    assert references(spark.createDataFrame([], "id long, p string"), "id", "p").count() == 0


@pytest.mark.parametrize(("pattern", "fits", "fails"), [("[a-c]?*", ["bx", "cxyz"], ["b", "dx", ""]), ("*[^0-9a-f-]*", ["12g", "G", " "], ["12f-", ""]), ("[]x]*[[]", ["][", "x["], ["a["]), ("a[", [], ["a[", "a"]), ("*.[&^]", ["x.&", ".^"], [".x"])])
def test_glob_classes(spark, pattern, fits, fails):
    from lexiforge.functions.payloads import glob

    rows = spark.createDataFrame([(t, True) for t in fits] + [(t, False) for t in fails], "t string, fits boolean")
    assert rows.where(F.col("t").rlike(glob(pattern)) != F.col("fits")).count() == 0


def test_the_library_and_the_readers_agree():
    rng = random.Random(11)
    letters = ["a", "b", "é", "B", "\ud800", "😀", "～", '"', "\\", "\n", "\x7f", " ", "1", "_"]
    value = lambda d: [number_text, text, listed, keyed][rng.randrange(4 if d < 4 else 2)](d + 1)
    number_text = lambda _: rng.choice([*NUMBERS, "0.00012", "1e16", "12345678901234567.5", "1e400", "-123456789012345", "99999999999999999999999.5"])
    text = lambda _: json.dumps("".join(rng.choices(letters, k=rng.randrange(3))), ensure_ascii=rng.random() < 0.5)
    listed = lambda d: f"[{' ,'.join(value(d) for _ in range(rng.randrange(4)))}]"
    keyed = lambda d: "{" + ", ".join(f"{text(d)} : {value(d)}" for _ in range(rng.randrange(5))) + "}"
    for payload in (value(0) for _ in range(3000)):
        try:
            read = Writer().read(payload)
        except NotJson:
            read = None
        assert canonical(payload) == read
        if read is not None:
            keys = Keys()
            keys.read(payload)
            assert keys_of(payload) == list(keys.found)
            order = rng.sample(range(len(keys.found)), len(keys.found))
            named = list(keys.found)
            assert canonical_forms(payload, order) == (read, Writer({named[at]: rank for rank, at in enumerate(order)}).read(payload))


def test_work_on_orders_is_spread(spark, sf_dir, monkeypatch):
    from lexiforge.plans import QUERIES
    from lexiforge.sources import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 300)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert rows.rdd.getNumPartitions() == 1
    assert QUERIES["canonical_json_variants"](spark, sf_dir).rdd.getNumPartitions() == -(-rows.count() // 300)
