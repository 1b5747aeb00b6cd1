"""Operators that SQL can't express, against plain versions on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lexiforge.llm import quality_classifier, secret_scan, token_counts
from lexiforge.llm.exact_dedup import FuseFilter
from lexiforge.llm.hashing import BASE, shingle_sets
from lexiforge.llm.jaccard_join import near_duplicates
from lexiforge.llm.registry import QUERIES
from lexiforge.llm.sentence_pieces import DoubleArrayTrie, default_model, piece_model
from lexiforge.llm.signature_tree import Groups, SignatureTree, links


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_op9_agrees_with_the_library(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    for r in QUERIES["op9_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
    count = token_counts.counter(public_tokenizers.path("byte_bpe_50k.json")).count
    for text in ("", " ", "\n\n \n", "a\t b", "x  \t\n y", "don't  stop", "<|endoftext|>", "a<|endoftext|> b", "é ü 12½", "日本語  x", "ab" * 3000, "  a"):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_op4_base_spans_and_novel_ones(spark, sf_dir, texts):
    for r in QUERIES["op4_secret_scan"](spark, sf_dir).collect():
        t, spans = texts[r.doc_id], []
        for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t):
            spans += [(m.start(), 0, m.end())] * (len(m[2]) >= 6)
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort()
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    novel = secret_scan.scan('credential -> "q8Zt4VnX0pLr7Ks2WyB9"')
    assert novel["spans"] == "novel:15:35"
    assert secret_scan.scan("see the credential in application_default_credentials2 first")["spans"] == ""


def test_op5_learns_from_the_other_folds_only(spark, sf_dir):
    found = {r.doc_id: r for r in QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = {i: r for i, r in found.items() if r.held_out}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    good, bad = ([r.score for i, r in held.items() if labels.get(i) == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    turned = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels.items()], "doc_id long, quality int")
    again = quality_classifier.classify(docs, turned).select("doc_id", "score").collect()
    assert all(abs(r.score - found[r.doc_id].score) < 1e-9 for r in again)


def plain_score(text, flat):
    """The mean of the parts' numbers, one part at a time."""
    q, finish = 1 << 64, quality_classifier.mixed
    number = lambda key, seed: int(finish(np.array([key], np.uint64), seed)[0])
    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    hashes = [number(sum((b + 1) * pow(BASE, k, q) for k, b in enumerate(w)) % q, 7) for w in words]
    kinds = [[number(h, 31) % quality_classifier.BUCKETS for h in hashes]]
    kinds.append([quality_classifier.REPEATED + (a == b) for a, b in zip(hashes, hashes[1:])])
    for n in quality_classifier.SIZES:
        grams = []
        for i in range(len(text) - n + 1):
            key = 0
            for c in text[i : i + n]:
                key = (key * 0x100000001B3 + ord(c)) % q
            grams.append((key * 0x9E3779B97F4A7C15 % q >> 48) ^ n)
        kinds.append(grams)
    means = [float(np.mean([flat[b] for b in own])) for own in kinds if own]
    return 1 / (1 + np.exp(-(float(np.mean(means) if means else 0.0) + float(flat[-1]))))


def test_op5_scores_against_a_plain_scorer(spark):
    flat = np.random.default_rng(2).normal(0, 2, quality_classifier.BUCKETS + 1).astype(np.float32)
    texts = ["", "a", "One two two THREE", "ünï çödé 語 😀  x\n\ty", "same same same same", " \t ", "longer text " * 60, None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", quality_classifier.score(df.text, flat).alias("s")).collect():
        assert abs(r.s - plain_score(r.text or "", flat)) < 1e-6, r.text


def test_op5_learns_a_repeated_id_once(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(4, 0), (4, None)], "doc_id long, quality int")
    rows = [(i, ("good words " if i % 2 else "zzz qqq ") * 5) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = quality_classifier.fit(docs, labels)
    assert (once == quality_classifier.fit(docs.union(docs.where("doc_id < 50")), labels)).all() and (once == quality_classifier.fit(docs.repartition(5), labels)).all()


def test_op6_handmade_pages(spark, tmp_path):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Home</a></nav><header class='site'><p>Site</p></header>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>On &amp; off</h1><p>First\n <b>bold</b>&nbsp;line<p>Second {0}</p>"
        "<div class='ad'>Buy</div><ul><li>one<li>two</ul></article><aside>Side</aside><section id='comments'><p>Nice!</p></section><footer>&copy; x</footer></body></html>"
    )
    rows = [(i, f"https://a.example/{i}", page.format(i)) for i in range(6)] + [(6, None, None), (7, "https://b.example/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: r for r in QUERIES["op6_html_wrapper"](spark, str(tmp_path)).collect()}
    assert len(found) == 8
    for i in range(6):
        assert found[i].text == f"On & off\n\nFirst bold line\n\nSecond {i}\n\none\n\ntwo"
        assert found[i].n_chars == len(found[i].text)
    assert (found[6].text, found[7].text, found[7].n_chars) == ("", "", 0)


def best_cut(text, model):
    """All cuts of a short text by recursion over its prefixes."""
    data, best = (" " + text).encode(), {0: (0.0, [])}
    pieces = {model.pieces[i]: i for i in model.scores}
    starts = [i for i in range(len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
    for end in starts[1:]:
        ways = []
        for begin in starts[: starts.index(end)]:
            score, ids = best[begin]
            if (piece := pieces.get(data[begin:end])) is not None:
                ways.append((score + model.scores[piece], ids + [piece]))
            elif starts.index(end) - starts.index(begin) == 1:
                ways.append((score + model.unknown, ids + [model.byte_ids[b] for b in data[begin:end]]))
        best[end] = max(ways, key=lambda w: w[0])
    return best[len(data)]


def test_op8_best_cuts_and_round_trips(spark, sf_dir, texts):
    model = piece_model(default_model())
    score = lambda ids: sum(model.scores.get(i, 0.0) for i in ids)
    for text in ("a", "Hello world", "  two  spaces ", "naïve Straße", "日本x", "line\nend", "▁marker", "internationalization of antidisestablishmentarianism", "😀 ok"):
        ids = np.frombuffer(model.encode(text), np.int32).tolist()
        assert model.decode(ids) == text
        assert abs(score(ids) - score(best_cut(text, model)[1])) < 1e-9
    draw = np.random.default_rng(4)
    for _ in range(150):
        text = "".join(draw.choice(list("abcdeinorst  \n.,éß▁語😀"), int(draw.integers(1, 24))))
        ids = np.frombuffer(model.encode(text), np.int32).tolist()
        assert model.decode(ids) == text and abs(score(ids) - score(best_cut(text, model)[1])) < 1e-9, text
    for r in QUERIES["op8_sentence_pieces"](spark, sf_dir).collect():
        assert r.round_trip and r.n_pieces == len(r.piece_ids)
        assert model.decode(list(r.piece_ids)) == texts[r.doc_id]


def test_double_array_trie_finds_what_was_put_in():
    words = {bytes(w): k for k, w in enumerate({bytes(x) for x in np.random.default_rng(1).integers(97, 101, (300, 4)).astype(np.uint8)} | {b"a", b"ab", b"\xff\x00"})}
    trie = DoubleArrayTrie(words)
    for word, k in words.items():
        state = 0
        for b in word:
            after = trie.base[state] + b + 1
            assert trie.check[after] == state
            state = after
        assert trie.value[state] == k


def test_op10_rules_and_words(spark, sf_dir):
    rules = {"org/": ("org", "/", "allow"), "example.org/es/": ("example.org", "/es/", "block"), "example.org/en/1": ("example.org", "/en/1", "block"), "com/fr/": ("com", "/fr/", "allow"), "com/de/": ("com", "/de/", "block")}
    urls = {r.page_id: r.url or "" for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op10_url_filter"](spark, sf_dir).collect():
        _, sep, rest = urls[r.page_id].partition("://")
        host = re.split("[/?#]", rest)[0] if sep else ""
        path = re.split("[?#]", rest[len(host) :])[0] if sep else ""
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [n for n, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict == rules[best][2] if best else r.verdict in ("allow", "block")


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys, others = np.split(rng.integers(0, 2**63, n + 20_000).astype(np.uint64), [n])
        made = FuseFilter.from_bytes(FuseFilter.build(keys).to_bytes())
        assert made.has(keys).all() and made.has(others).mean() < 0.002


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, len(sets[i]), label[i]) for i in ids}


def test_op3_chains_hubs_and_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, words = [], [f"w{k}" for k in range(400)]
    for g in range(6):
        base = list(rng.choice(words, 60))
        for c in range(30):  # a chain: each copy differs a little more
            base[int(rng.integers(60))] = f"x{g}.{c}"
            rows.append((len(rows), " ".join(base).replace("w", "W" if c % 2 else "w")))
    common = " ".join(rng.choice(words, 40))
    rows += [(len(rows) + k, f"{common} " + " ".join(rng.choice(words, 8 + k % 9))) for k in range(60)]
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, "a b", "A  b", "a b c d e", "a b c d e f"])]
    expected = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from lexiforge.llm import jaccard_join

    for tile in (512, 16):  # with 16 the large blocks' way is taken
        monkeypatch.setattr(jaccard_join, "TILE", tile)
        assert {tuple(r) for r in near_duplicates(docs).collect()} == expected


def test_signature_tree_joins_what_all_pairs_join():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**48, 90).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, 60, replace=False), rng.integers(0, 2**48, int(k)).astype(np.uint64)))) for k in rng.integers(0, 12, 150)]
    sizes, groups = np.array([len(s) for s in sets]), Groups(np.arange(len(sets)))
    tree = SignatureTree(sets, sizes, np.arange(len(sets)))
    links(tree, tree, groups)
    plain = Groups(np.arange(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                plain.join(i, j)
    same = lambda g: {(i, j) for i in range(len(sets)) for j in range(i) if g.root(i) == g.root(j)}
    assert same(groups) == same(plain)


def test_shingles_of_batches_are_those_of_single_texts():
    import pyarrow as pa

    texts = ["one two three four five six", "", None, "Ä b\tC  d\ne f", "x"]
    together = [s.tolist() for sets in shingle_sets(pa.array(texts)) for s in sets]
    assert together == [next(iter(shingle_sets(pa.array([t], pa.string()))))[0].tolist() for t in texts]


def test_pipeline_stages_against_plain_steps(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, sf_dir).toArrow())
        ids[name] = sorted(r.doc_id for r in kept.select("doc_id").collect())
        if name != "encode":
            assert kept.columns == docs.columns
    good = {r.doc_id for r in QUERIES["op5_quality_classifier"](spark, sf_dir).where("predicted = 1").collect()}
    assert set(ids["quality"]) == good
    last = {}
    for i in ids["quality"]:
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i])
        last[key] = max(i, last.get(key, i))
    assert ids["exact"] == sorted(last.values())
    assert ids["near"] == sorted(i for i, n, c in brute_components([(i, texts[i]) for i in ids["exact"]]) if i == c)
    assert set(ids["mixture"]) <= set(ids["near"]) and ids["encode"] == ids["mixture"]
    assert kept.where("not round_trip").count() == 0
