"""Class words, several articles and several layouts in the wrappers of a host."""

from __future__ import annotations

import json
import random
import re
import time
from collections import Counter
from html import unescape

import pytest

from lexiforge.llm import html_wrapper
from lexiforge.llm.html_wrapper import aligned, extract_main_text, flat, main_text, page_wrapper, places, unflat

ARTICLE = "<h1>Title {0}</h1><p>The long story of page {0} goes on and on, with word{0} and more of it.</p>"
TEXT = "Title {0}\n\nThe long story of page {0} goes on and on, with word{0} and more of it."


def texts(spark, page, pages=5):
    rows = [(i, f"https://a.example/{i}", page.replace("{0}", str(i))) for i in range(pages)]
    return [r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def expected(text, pages=5):
    return [text.replace("{0}", str(i)) for i in range(pages)]


@pytest.mark.parametrize("pages", [1, 5])
@pytest.mark.parametrize("opened", ['<div class="content-sidebar-wrap">', '<div id="page" class="has-sidebar">', '<div class="layout no-comments">', '<form id="aspnet">'])
def test_what_holds_the_article_is_lifted(spark, opened, pages):
    for name in ("article", "main"):
        page = f"<body><nav>Menu</nav>{opened}<{name}>{ARTICLE}</{name}></{opened[1:5].strip()}><div class='comments'><article><p>Nice {{0}}!</p></article></div></body>"
        assert texts(spark, page, pages) == expected(TEXT, pages)


def test_the_wrapper_decides_about_class_words(spark):
    inside = '<p class="notice">Note {0} of its own.</p><div class="widget-text">Part {0}.</div><section class="related-work">Others did {0}.</section>'
    fixed = '<p class="banner">Read our terms.</p><div class="related"><a href=/1>More of {0}</a></div><div class="ad">Buy {0}</div>'
    page = f"<body><article>{ARTICLE}{inside}{fixed}</article></body>"
    assert texts(spark, page) == expected(TEXT + "\n\nNote {0} of its own.\n\nPart {0}.\n\nOthers did {0}.")


def test_most_of_the_varying_text_is_no_boilerplate(spark):
    assert texts(spark, f'<body><div class="widget">{ARTICLE}</div><div class="sidebar">Fixed</div></body>') == expected(TEXT)
    assert texts(spark, f'<body><div class="sidebar">{ARTICLE}</div></body>', 1) == expected(TEXT, 1)


def test_teasers_beside_the_article_and_embeds_in_it(spark):
    card = "<article class='card'><a href=/{0}>Read story {0}</a><p>In brief {0}</p></article>"
    post = f"<article class='post'>{ARTICLE}<article class='embed'><p>Quoted {{0}}</p></article><p>The end of {{0}}.</p></article>"
    assert texts(spark, f"<body>{card * 3}{post}{card}</body>") == expected(TEXT + "\n\nQuoted {0}\n\nThe end of {0}.")


def test_all_articles_of_a_page(spark):
    assert texts(spark, f"<body><div>Site</div><article class='b'>{ARTICLE}</article><article class='a'><p>A second story {{0}}.</p></article></body>") == expected(TEXT + "\n\nA second story {0}.")


def test_a_small_article_does_not_hide_the_text(spark):
    page = f"<body><article class='hint'><p>Tip {{0}}</p></article><div class='top'>Site</div><div class='story'>{ARTICLE * 3}</div></body>"
    assert texts(spark, page) == expected("\n\n".join([TEXT] * 3))


def test_every_layout_of_a_host(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div class='top'>Our site</div><div class='layout{'abcdef'[i % 6]}'><div>{ARTICLE.replace('{0}', str(i) * (7 - i % 6))}</div></div></body>") for i in range(18)]
    rows = [(i, u, h.replace("<div><h1>", "<h1>").replace("</p></div></div>", "</p></div>")) for i, u, h in rows]
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {i: TEXT.replace("{0}", str(i) * (7 - i % 6)) for i in range(18)}


def test_texts_that_differ_late(spark):
    same = "The same long opening of every page. " * 8
    page = f"<body><div class='top'>Our site</div><div class='story'>{same} {{0}}</div></body>"
    assert texts(spark, page) == expected(same.strip() + " {0}")


def host_pages(host, pages, seed):
    """Pages of plain ``div`` elements; which chrome they have depends on the host."""
    draw = random.Random(seed)
    say = lambda n: " ".join(draw.choice(WORDS) + str(draw.randrange(10_000)) for _ in range(n))
    links = "".join(f"<div><a href=/{k}>{say(1)}</a></div>" for k in range(draw.randrange(2, 6)))
    before, after = [f"<div>{say(3)}</div>" for _ in range(draw.randrange(1, 4))], [f"<div>{say(5)}</div>" for _ in range(draw.randrange(1, 3))]
    out = []
    for _ in range(pages):
        story = [say(draw.randrange(5, 30)) for _ in range(draw.randrange(2, 9))]
        story.insert(1, "Fixed words &amp; between")
        body = "".join(f"<div>{x}</div>" for x in story)
        out.append((f"https://{host}/{say(1)}", f"<body>{''.join(before)}<div>{links}</div>{f'<div>{body}</div>' if seed % 2 else body}{''.join(after)}</body>", [unescape(x) for x in story]))
    return out


WORDS = "river stone winter garden letter music".split()


def blocks_by_hand(page):
    """Texts between tags, with whether they are links."""
    return [(unescape(text), bool(link)) for link, text in re.findall(r"(<a [^>]*>)?([^<>]+)(?=<)", page)]


def test_plain_divs_against_brute_force(spark):
    hosts = {f"h{k}.example": host_pages(f"h{k}.example", 12, k) for k in range(8)}
    rows = [(url, page) for own in hosts.values() for url, page, _ in own]
    found = {r.url: r.text for r in extract_main_text(spark.createDataFrame(rows, "url string, html string")).collect()}
    alone = places(None)
    differ = 0
    for own in hosts.values():
        on = Counter(text for _, page, _ in own for text in {t for t, _ in blocks_by_hand(page)})
        for url, page, story in own:
            left = [(t, link or 4 * on[t] >= 3 * len(own)) for t, link in blocks_by_hand(page)]
            while left[0][1]:
                del left[0]
            while left[-1][1]:
                del left[-1]
            assert found[url] == "\n\n".join(t for t, _ in left) == "\n\n".join(story)
            differ += found[url] != main_text(page, *alone)
    assert differ == len(rows)


def test_the_order_of_pages_does_not_matter(spark):
    rows = [(url, page) for k in range(3) for url, page, _ in host_pages(f"h{k}.example", 20, k)]
    random.Random(1).shuffle(rows)
    wrappers = [flat(aligned([page_wrapper(page) for url, page in own])) for own in (sorted(rows), rows)]
    assert wrappers[0] == wrappers[1] == flat(unflat(wrappers[0]))
    texts = lambda parts: sorted(extract_main_text(spark.createDataFrame(rows, "url string, html string").repartition(parts)).select("url", "text").collect())
    assert texts(1) == texts(7)


def test_rare_labels_are_their_tags(spark):
    page = "<body><div class='x{0}'><p class='y{0}'>One {0}</p></div><div class='story'><p>Story {0}</p></div></body>"
    names = ["".join(random.Random(i).choices("abcdefgh", k=8)) for i in range(200)]
    rows = spark.createDataFrame([("h", page.replace("{0}", n)) for n in names], "host string, html string")
    (found,) = html_wrapper.host_plans(rows).collect()
    assert {row[1] for row in json.loads(found.told)[1]} == {"", "body", "div", "div.story", "p"}
    assert main_text(page.replace("{0}", "new"), *places(found.told)) == "One new\n\nStory new"


def closing_pages(n=400):
    """A closing line on three quarters of a host's pages, rare labels, and pages whose texts only the whole host tells of."""
    draw = random.Random(7)
    say = lambda k: " ".join(draw.choice(WORDS) + str(draw.randrange(10_000)) for _ in range(k))
    rows = []
    for i in range(n):
        close = "<div>All rights are with the makers of this site</div>" if i < 0.76 * n else "<div>Early " + say(2) + "</div>"
        rows.append((i, f"https://one.example/{i}", f"<body><div class='c{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}'>{say(3)}</div><div><h1>{say(4)}</h1><p>{say(20)}</p></div>{close}</body>"))
    return rows


@pytest.mark.parametrize("few", [0, 16 << 20])
def test_partitions_do_not_matter(spark, monkeypatch, few):
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", few)
    monkeypatch.setattr(html_wrapper, "HELD_ITEMS", 500)
    rows = closing_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    shuffled = random.Random(2).sample(rows, len(rows))
    layouts = [df.coalesce(1).sortWithinPartitions("page_id"), df.repartitionByRange(4, "page_id"), df.repartition(40), spark.createDataFrame(shuffled, df.schema).repartition(4)]
    found = [{r.page_id: r.text for r in extract_main_text(layout).collect()} for layout in layouts]
    assert all(f == found[0] for f in found[1:])
    assert sum("All rights" in t for t in found[0].values()) == 0 and sum("Early" in t for t in found[0].values()) == 96


def test_copies_of_a_page_do_not_matter(spark):
    page = f"<body><div>Our site</div><article>{ARTICLE}<div class='related'><p>A part of {{0}} that stays.</p></div></article><div>Copyright</div></body>"
    alone = texts(spark, page, 1)
    rows = [(i, "https://a.example/", page.replace("{0}", "0")) for i in range(8)]
    copies = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in copies} == set(alone) == set(expected(TEXT + "\n\nA part of {0} that stays.", 1))
    assert texts(spark, page, 3) == expected(TEXT + "\n\nA part of {0} that stays.", 3)
    several = [(i, u, h) for i, u, h in closing_pages(40)]
    more = several + [several[k] for k in (0, 0, 0, 39, 39)] + [several[1]] * 60
    by = lambda rows: {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by(several) == by(more)


def test_deep_and_long_pages(spark):
    deep = "<body>" + "".join(f"<div>Level {k} of {{0}}" for k in range(10_000)) + "</div>" * 10_000
    long = "<body><div class='top'>Site</div>" + "".join(f"<h2>Part {k} of {{0}}</h2><p>Text {k} of {{0}}</p>" for k in range(5_000))
    began = time.monotonic()
    assert texts(spark, deep, 3) == ["\n\n".join(f"Level {k} of {i}" for k in range(10_000)) for i in range(3)]
    assert texts(spark, long, 3) == ["\n\n".join(f"Part {k} of {i}\n\nText {k} of {i}" for k in range(5_000)) for i in range(3)]
    assert time.monotonic() - began < 120


@pytest.mark.parametrize("page", ["<div", "<div class=", "<a href='x", "</p></div></b>" * 2_000, "<b>" * 2_000 + "</i>" * 2_000, "<!-- no end <p>x", "<p>a<p>b<table><tr><td>c<td>d", "<svg><path/></svg>ok", "<title>t", "\x00<p>\ud7ff &#0; &bad; &#x110000;"])
def test_broken_markup(spark, page):
    assert len(texts(spark, page + " {0}", 2)) == 2


def test_columns_of_any_names(spark):
    df = spark.createDataFrame([("https://a.example/", "<p>x</p>", 1, 2, 3)], "url string, html string, _page_host int, _host int, _plan int")
    assert extract_main_text(df).collect()[0].asDict() == {"url": "https://a.example/", "html": "<p>x</p>", "_page_host": 1, "_host": 2, "_plan": 3, "text": "x"}
