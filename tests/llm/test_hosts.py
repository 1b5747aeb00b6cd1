"""Hosts that the quality rules drop, against a plain version."""

from __future__ import annotations

import random

from lexiforge.llm import quality_rules
from lexiforge.llm.quality_rules import quality_rules as judge

WORDS = [f"{a}{b}" for a in "river stone winter garden letter music".split() for b in "abcdefghij"]


def docs():
    draw, rows = random.Random(6), []
    good = lambda: " ".join(draw.sample(WORDS, 20))
    bad = {
        "symbols": lambda: " ".join(draw.sample(WORDS, 20)) + " ### $$$ %%%",
        "lines": lambda: "\n".join([draw.choice(WORDS)] * 5 + draw.sample(WORDS, 2) + ["same"] * 3 + draw.sample(WORDS, 6)),
        "long": lambda: " ".join(w * 3 for w in draw.sample(WORDS, 20)),
        "repeats": lambda: " ".join(draw.sample(WORDS, 12) * 2),
        "short": lambda: "too few words",
    }
    for host in range(30):
        rows += [(f"h{host}", good() if draw.random() > 0.05 else bad[draw.choice([*bad])]()) for _ in range(40)]
    for kind in bad:
        rows += [(f"bad {kind}", bad[kind]() if draw.random() < 0.8 else good()) for _ in range(60)]
        rows += [(f"mixed {kind}", bad[kind]() if draw.random() < 0.3 else good()) for _ in range(60)]
    rows += [("two of two", bad["symbols"]()) for _ in range(2)] + [("one", bad["lines"]()), (None, good()), (None, None), ("none", "")]
    draw.shuffle(rows)
    return [(i, *r) for i, r in enumerate(rows)]


def counts(text):
    words = text.split()
    lines = [line for line in text.split("\n") if line.split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def plain(rows):
    failed, hosts = {}, {}
    for i, host, text in rows:
        n, chars, symbols, lines, dup, repeat = counts(text or "")
        failed[i] = [n < 10, 100 * repeat > 20 * n, 10 * symbols > n, 10 * dup > 3 * lines, chars < 3 * n or chars > 10 * n]
        hosts.setdefault(host, []).append(i)
    rates = {h: [] for h in hosts}
    for rule in range(5):
        k = {h: sum(failed[i][rule] for i in own) for h, own in hosts.items()}
        n = {h: len(own) for h, own in hosts.items()}
        all_n, all_k = sum(n.values()), sum(k.values())
        mean = all_k / all_n
        spread = sum(n[h] * (k[h] / n[h] - mean) ** 2 for h in hosts)
        between = (spread - (len(n) - 1) * mean * (1 - mean)) / (all_n - sum(x * x for x in n.values()) / all_n - (len(n) - 1))
        weight = min(1000.0, max(1.0, mean * (1 - mean) / between - 1)) if between > 1e-12 else 1000.0
        for h in hosts:
            rates[h].append((k[h] + mean * weight) / (n[h] + weight))
    return {i: (any(failed[i][:2]), max(rates[h]), not any(failed[i][:2]) and max(rates[h]) < 0.5) for i, h, _ in rows}


def test_hosts_are_dropped_by_each_rule(spark):
    rows = docs()
    expected = plain(rows)
    found = judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        failed, rate, kept = expected[r.doc_id]
        assert (r.base_failed, r.kept) == (failed, kept) and abs(r.host_rate - rate) < 1e-9
    whole = {r.source for r in found if r.source and not r.kept} - {r.source for r in found if r.kept}
    assert {h for h in whole if h.startswith(("bad", "h", "mixed"))} == {"bad symbols", "bad lines", "bad long", "bad repeats", "bad short"}
    assert sum(not r.kept and not r.base_failed for r in found) > 100  # good documents of bad hosts, and failures of the other rules there


def test_small_hosts_are_shrunk(spark):
    rows = [(i, f"h{i % 20}", " ".join(WORDS[:20])) for i in range(400)] + [(900 + i, "small", " ".join(WORDS[:20]) + " ### ###") for i in range(2)]
    rates = {r.source: r.host_rate for r in judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert 0 < rates["h1"] < 0.05 and rates["h1"] < rates["small"] < 1
    same = spark.createDataFrame([(1, "a", "### x"), (2, "b", "### x")], "doc_id long, source string, text string")
    assert {round(r.host_rate, 9) for r in judge(same).collect()} == {1.0}
    assert quality_rules.host_verdicts(quality_rules.text_counts(same.limit(0)), same.source).count() == 0
