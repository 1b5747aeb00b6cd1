"""Words and glosses of many lines are held against each other as arrays; against a plain version by line, and the SQL."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import against_sql
from pyspark.sql import functions as F

from lexiforge.functions import alignment as A
from lexiforge.plans import ORACLES, QUERIES

# Odd ends of lines, characters beyond 16 bits, marks alone, characters newer than the JVM's tables, lines without words, more lines than are cut at a time.
TEXTS = [
    None, "", " \n", "\r\n", "a", "a b c d e f g h i j k l m n o p q\r\nr s t\n\n u", "قال", "قال abc\rd \U0001f600 e\U0001f600f", "́ áb é", "࢘ ꟀꟐ x \U00010780", "x\x00y z", " ".join(map(str, range(3000))),
    "\n".join(f"w{i} " * 17 for i in range(9000)), "after a long one\nb",
]


@pytest.mark.parametrize("name", ["gloss_coverage", "gloss_gaps", "script_segments"])
def test_odd_texts(name, spark, tmp_path):
    draw = random.Random(4)
    texts = TEXTS + ["".join(draw.choice("ab xyé0٣.\n\ŕ😀ق") for _ in range(draw.randint(0, 300))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    against_sql(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])


@pytest.mark.parametrize("name", ["gloss_coverage", "gloss_gaps", "script_segments"])
def test_a_text_is_cut_once(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_few_segments_are_passed_on_at_a_time(spark):
    texts = ["a b " * 20_000, "", None] * 20  # 80 KB each
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    batches = A.placed(rows, ["i"], A.lines_of(F.col("t")), A.LATIN_WORD).select("i", F.size("x").alias("n"))
    assert sorted((r.i, r.n) for r in batches.collect()) == [(i, 80_000 if t else 0) for i, t in enumerate(texts)]
    sizes = [len(t or "") for t in texts]
    ranges = list(A.few(np.array(sizes), A.CUT_BYTES))
    assert [i for at, till in ranges for i in range(at, till)] == list(range(len(texts))) and max(sum(sizes[at:till]) for at, till in ranges) <= A.CUT_BYTES
    assert list(A.few(np.array([5, 9, 1, 0]), 4)) == [(0, 1), (1, 2), (2, 4)]


@pytest.mark.parametrize("size", [1, 70, 1 << 18])
def test_cut_by_characters(size, monkeypatch):
    monkeypatch.setattr(A, "CUT_BYTES", size)
    lines = [["abc, d", "", "é́ قال x"], None, [], [""], ["\U0001f600a", None, "...", "b" * 100]]
    expected = []
    for row, own in enumerate(lines):
        for line in own or ():
            stop = token = 0
            for s in re.findall("[a-zé́]+|[^a-zé́]+", line or ""):
                stop, w = stop + len(s), s[0] in "abcdxé́"
                expected.append((s, len(s), w, stop, token, row))
                token += w
    found = [x for some in A.cut(pa.array([None, *lines], pa.list_(pa.string())).slice(1), A.LATIN_WORD) for x in zip(some.s.to_pylist(), *(a.tolist() for a in (some.n, some.w, some.stop, some.token, some.row)))]
    assert found == expected


def test_stretches_of_offsets_far_apart():
    far = 2**62
    words = np.array([[-far, -far + 5], [far, far + 4], [0, 9], [1, 3]])
    glosses = np.array([[-far, -far + 2], [far, far + 4], [far + 1, far + 2], [4, 5]])
    found = A.swept(np.array([0, 0, 1, 3]), words, np.array([0, 0, 0, 1]), glosses)
    assert list(zip(*(x.tolist() for x in found))) == [(0, 1, 2 - far, 5 - far), (0, 2, far + 1, far + 2), (1, 1, 0, 4), (1, 1, 5, 9), (3, 1, 1, 3)]


def findings(words, glosses):
    """What is found for one line, word by word."""
    given, found = {}, []
    for at, parts in glosses:
        given.setdefault(at, []).append(None if parts is None else "".join(p for p in parts if p is not None))
    for at, surface in words:
        if at not in given:
            found.append(("TOKEN_MISSING", at))
            continue
        found += [("TOKEN_DUPLICATE", at)] * (len(given[at]) > 1) + [("PARTS_MISMATCH", at)] * any(made is not None and made != surface for made in given[at])
    for at, times in given.items():
        if at not in {t for t, _ in words}:
            found += [("TOKEN_UNKNOWN", at)] + [("TOKEN_DUPLICATE", at)] * (len(times) > 1)
    return found


def test_findings_against_brute_force(spark):
    draw = random.Random(3)
    part = lambda: draw.choice(["a", "b", "", None])
    token = lambda: draw.choice([*range(6), -5, None, 2**62, -(2**62)])
    rows = [(-1, [], []), (-2, None, [(1, ["a"])]), (-3, [(1, "a")], None)]
    rows += [(i, [(token(), draw.choice(["a", "ab", "", None])) for _ in range(draw.randint(0, 5))], [(token(), draw.choice([None, [], [part()], [part(), part()]])) for _ in range(draw.randint(0, 7))]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, w array<struct<token_index:long,surface:string>>, g array<struct<token_index:long,parts:array<string>>>").coalesce(1)
    found = {r.id: [tuple(c) for c in r.c] for r in df.select("id", A.gloss_codes(F.col("w"), F.col("g")).alias("c")).collect()}
    assert found == {i: findings(w or [], g or []) for i, w, g in rows}
