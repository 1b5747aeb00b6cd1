"""Main text of web pages by wrappers that are inferred for each host (operator 6).

Every page is read as a stream of tags and texts. A wrapper is a union-free
regular expression over such streams, kept as a tree of items: an element, what
stands in it in order, and its texts. The pages of a host are aligned into one
wrapper: elements of one label under one parent are one item. Where streams
differ, an item that some pages lack is optional, one that stands twice in a row
or whose followers lead back to it is a repeated group, and a text that three
quarters of the item's pages don't share is a slot. Items add up counts and unite the pairs
of neighbours: sums of whole numbers and unions, so the wrapper depends neither on the order
of the pages nor on how they lie in partitions. Equal pages of a host count as one. Labels that
fewer than 1 in ``RARE`` of the host's pages have anywhere are told apart from their bare tags
no more; they are counted by host, exactly, before the first wrapper is made. The texts of items are
counted by host, item and text as rows of their own, and only those that three quarters
share come back to the wrapper. Both bound a wrapper by the size of pages, not by their number.
Pages are aligned within each task, then by salted parts of a host, then by host.

Each page is then matched to its host's wrapper, item by item, and the wrapper
tells what is its main text:

1. Some elements are never part of an article by their tag. Those that only have a
   class, id or role that sounds so are boilerplate if their item is fixed or mostly
   links, but not if it holds most of the host's varying text.
2. ``article`` (then ``main``) items lead if their slots hold a quarter of the host's
   varying text. Those that are mostly links, or short and repeated beside a longer
   one, are teasers.
3. Elsewhere the article is looked for from the root down: as long as one of the
   items that this page has holds four fifths of all varying text, is no repeated
   group and does not stand beside headings, paragraphs or bare text that varies. Fixed
   texts and links at both ends of what is found are the host's and not the article's.

Defined results: null and empty pages have an empty text; URLs without a host
share one wrapper. Text ends with the input where markup is cut off. Where nothing
varies, all of a page's text counts as varying, as on a host of one page, however often that
stands. Repeated rows give equal texts, an empty table an empty result. Other columns pass, whatever their names, but one
named like the result is replaced. Whole pages are read, however long or deep.
"""

from __future__ import annotations

import hashlib
import heapq
import html as html_
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.components import Rounds
from lexiforge.llm.storage import broadcast_few, settle, table, unused
from lexiforge.llm.url_filter import host_and_path

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
#: End tags and CLOSES don't reach beyond these.
SCOPES = frozenset("html body article main section table nav aside header footer form".split())
#: Never part of the article.
OUTSIDE = frozenset("head script style title noscript template iframe noframes nav footer aside form button select textarea dialog menu svg object video audio canvas xmp".split())
OUTSIDE_WORDS = frozenset("ad ads adslot advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Of these, words that article text has as well.
AMBIGUOUS_WORDS = frozenset("banner footer masthead modal notice notification popup related respond replies toolbar widget".split())
#: Parts that may follow another word of OUTSIDE_WORDS without making it another thing.
STRUCTURE_WORDS = frozenset("area author bar block body bottom box button buttons container content footer form header icon icons inner item items left level link links list main meta outer panel primary right row section slot text title top unit wrap wrapper".split())
#: Elements that hold the article on some pages though their tag says otherwise.
LIFTED = frozenset(["form"])
#: How much a label sounds like boilerplate.
PLAIN, COMPOUND, AMBIGUOUS, SURE = range(4)
#: Tags of an article's own flow: no article is looked for inside them.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: The part of the varying text that the article's item has at least.
MOST = 0.8
#: Labels must be on one in so many of their host's pages to be told apart from their bare tags.
RARE = 16
#: Salted parts that a host's wrappers are merged in first.
PARTS = 32
#: Items, texts or labels that a task holds before it passes them on.
HELD_ITEMS = 200_000
#: Bytes of what is said of all hosts up to which it is broadcast; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20


@lru_cache(maxsize=65536)
def suspicion(label: str) -> int:
    """SURE if a whole class, id or role is a word for boilerplate, AMBIGUOUS if the word has other uses, COMPOUND if it is only a part."""
    name, *words = label.split(".")
    most = PLAIN
    for word in words if name not in ("html", "body") else ():
        parts = [p for p in re.split(r"[-_:]+", word) if p]
        if not OUTSIDE_WORDS.intersection(parts):
            continue
        if parts[0] in OUTSIDE_WORDS and all(p in STRUCTURE_WORDS or p in OUTSIDE_WORDS for p in parts[1:]):
            sure = any(p in OUTSIDE_WORDS and p not in AMBIGUOUS_WORDS for p in parts)
            most = max(most, SURE if sure else AMBIGUOUS if len(parts) == 1 else COMPOUND)
        else:
            most = max(most, COMPOUND)
    return most


class Element:
    """An open element: what its tag says, and where it stands."""

    __slots__ = ("name", "label", "outside", "article", "suspect", "item", "no", "hard", "linked", "named", "last")

    def __init__(self, name: str, attributes: str = ""):
        self.name, words = name, []
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            words += [re.sub(r"\d+", "", w) for w in value.split()]
            if key.lower() == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search"):
                words.append("nav")
        self.label = ".".join([name, *sorted({w for w in words if w})])
        self.outside = name in OUTSIDE
        self.article = name in ("article", "main") or "articlebody" in words
        self.suspect = suspicion(self.label) if words else PLAIN
        self.item, self.no, self.hard, self.linked, self.named = None, False, False, name == "a", frozenset()
        self.last = ""

    def inherit(self, parent: "Element", out: bool) -> None:
        """Is text in here no part of an article? ``out``: the wrapper says so of this element."""
        self.no, self.hard = parent.no, parent.hard
        self.linked |= parent.linked
        if self.outside:
            self.no, self.hard = True, self.hard or self.name not in LIFTED
        elif out:
            self.no, self.hard = True, self.hard or self.suspect == SURE
        elif self.article and not self.hard:
            self.no = False


def read(page: str, root: Element, opened: Callable[[Element, Element], None], text: Callable[[Element, str], None], block: Callable[[], None]) -> None:
    """Calls ``opened`` for each new element and its parent, ``text`` for each run of text in its element, ``block`` where a block begins or ends."""
    stack, names = [root], Counter()
    at, n = 0, len(page)

    def cut(depth: int) -> None:
        for e in stack[depth:]:
            names[e.name] -= 1
        del stack[depth:]

    def push(name: str, attributes: str) -> None:
        element = Element(name, attributes)
        opened(element, stack[-1])
        stack.append(element)
        names[name] += 1

    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text(stack[-1], page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        if not name:
            continue
        if m.group(1) or m.group(4):
            depth = len(stack) - 1 if names[name] > 0 else 0
            while depth > 0 and stack[depth].name != name and (stack[depth].name not in SCOPES or name in SCOPES):
                depth -= 1
            if depth > 0 and stack[depth].name == name:
                if any(e.name not in INLINE for e in stack[depth:]):
                    block()
                cut(depth)
            continue
        if name not in INLINE:
            block()
            closed = CLOSES.get(name) or ({"p"} if name != "option" else set())
            if any(names[c] > 0 for c in closed):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name in closed:
                        cut(depth)
                        break
                    if stack[depth].name in SCOPES:
                        break
        elif name == "br":
            text(stack[-1], " ")
        if name in VOID:
            continue
        attributes = m.group(3) or m.group(6) or ""
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else n
            push(name, attributes)
        elif not attributes.endswith("/") or name not in ("svg", "path", "g"):
            push(name, attributes)
    block()


def spaced(text: str) -> str:
    return " ".join(html_.unescape(text).split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big")


class Item:
    """An element of a wrapper.

    pages have it, and it stands there ``times``; characters outside and inside of
    links in its own texts; of each of these texts (by digest) the pages and the
    characters; the items in it by label; pairs of labels of which the second
    follows the first there.
    """

    __slots__ = ("label", "pages", "times", "chars", "links", "texts", "kids", "follows")

    def __init__(self, label: str):
        self.label, self.pages, self.times, self.chars, self.links = label, 1, 0, 0, 0
        self.texts: dict[int, list[int]] = {}
        self.kids: dict[str, Item] = {}
        self.follows: set[tuple[str, str]] = set()


def page_wrapper(page: str, common: frozenset[str] | None = None) -> Item:
    """The wrapper of a single page: elements of one label under one parent are one item from the start.

    Labels that aren't ``common`` are their bare tags; without a set of them all are.
    """
    root = Element("")
    root.item = Item("")
    run: list[tuple[bool, str]] = []
    where = [root.item]

    def opened(element: Element, parent: Element) -> None:
        element.inherit(parent, False)
        element.item = parent.item
        if element.name in INLINE or element.no and not element.name == "form":
            return
        kids, label = parent.item.kids, element.label
        if common is not None and label not in common:
            label = element.name
        item = kids.get(label)
        if item is None:
            item = kids[label] = Item(label)
        item.times += 1
        if parent.last not in ("", label):
            parent.item.follows.add((parent.last, label))
        parent.last, element.item = label, item

    def text(element: Element, piece: str) -> None:
        if not element.no:
            if not run:
                where[0] = element.item
            run.append((element.linked, piece))

    def block() -> None:
        if run:
            chars, links = (len(spaced("".join(p for linked, p in run if linked == side))) for side in (False, True))
            if chars or links:
                item = where[0]
                item.chars += chars
                item.links += links
                own = item.texts.setdefault(digest(spaced("".join(p for _, p in run))), [1, 0])
                own[1] += chars
            run.clear()

    read(page, root, opened, text, block)
    root.item.times = 1
    return root.item


def absorb(into: Item, other: Item) -> Item:
    """``into`` as the wrapper of both; ``other`` must not be used any more."""
    todo = [(into, other)]
    while todo:
        a, b = todo.pop()
        a.pages, a.times, a.chars, a.links = a.pages + b.pages, a.times + b.times, a.chars + b.chars, a.links + b.links
        a.follows |= b.follows
        for text, (pages, chars) in b.texts.items():
            if (own := a.texts.get(text)) is None:
                a.texts[text] = [pages, chars]
            else:
                own[0], own[1] = own[0] + pages, own[1] + chars
        for label, kid in b.kids.items():
            if (mine := a.kids.get(label)) is None:
                a.kids[label] = kid
            else:
                todo.append((mine, kid))
    return into


def aligned(wrappers: list[Item]) -> Item:
    """One wrapper of all, smaller ones first."""
    heap = [(w.pages, i, w) for i, w in enumerate(wrappers)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = absorb(b, a)
        n += 1
        heapq.heappush(heap, (both.pages, n, both))
    return heap[0][2]


@lru_cache(maxsize=1 << 18)
def step(path: int, label: str) -> int:
    """The digest of the path to an item, from that to its parent."""
    return int.from_bytes(hashlib.blake2b(f"{path} {label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def along(root: Item) -> Iterator[tuple[int, Item]]:
    """Each item with the digest of its path."""
    todo = [(0, root)]
    while todo:
        path, item = todo.pop()
        yield path, item
        todo += [(step(path, label), kid) for label, kid in item.kids.items()]


def page_labels(page: str) -> set[str]:
    """The labels on a page that are more than a tag."""
    found = {(m[2] or m[5] or "", m[3] or m[6] or "") for m in TAG.finditer(page)}
    return {label for name, attributes in found if attributes for label in [Element(name.lower(), attributes).label] if "." in label}


def flat(root: Item) -> str:
    """As JSON that is nested no deeper however deep the pages are: items before what is in them, each with its depth."""
    rows, todo = [], [(0, root)]
    while todo:
        depth, item = todo.pop()
        rows.append([depth, item.label, item.pages, item.times, item.chars, item.links, [[h, *own] for h, own in sorted(item.texts.items())], sorted(item.follows)])
        todo += [(depth + 1, kid) for _, kid in sorted(item.kids.items(), reverse=True)]
    return json.dumps(rows)


def unflat(text: str) -> Item:
    open_: list[Item] = []
    for depth, label, pages, times, chars, links, texts, follows in json.loads(text):
        item = Item(label)
        item.pages, item.times, item.chars, item.links = pages, times, chars, links
        item.texts = {h: [n, c] for h, n, c in texts}
        item.follows = {(a, b) for a, b in follows}
        del open_[depth:]
        if open_:
            open_[-1].kids[label] = item
        open_.append(item)
    return open_[0]


def looped(item: Item) -> set[str]:
    """Labels that stand between others that follow themselves: the repeated groups in ``item``."""
    left = set(item.kids)
    edges = {(a, b) for a, b in item.follows if a in left and b in left}
    while True:
        inner = {a for a, _ in edges} & {b for _, b in edges}
        kept = {(a, b) for a, b in edges if a in inner and b in inner}
        if len(kept) == len(edges):
            return inner
        edges = kept


def fixed_texts(item: Item) -> list[int]:
    """Texts that are on three quarters of the item's pages or more, and on two at least."""
    return [h for h, (pages, _) in item.texts.items() if pages > 1 and 4 * pages >= 3 * item.pages]


def plan(wrapper: Item) -> str:
    """What a page needs to know of its host's wrapper, as JSON: sets of labels of articles that lead, and each item as (depth, label, mean of varying characters in it, of its own texts alone, repeated, boilerplate, digests of fixed texts)."""
    order, todo = [], [(0, wrapper, False)]
    while todo:
        depth, item, repeated = todo.pop()
        order.append((depth, item, repeated))
        loops = looped(item)
        todo += [(depth + 1, kid, kid.times > kid.pages or label in loops) for label, kid in sorted(item.kids.items(), reverse=True)]
    fixed = {id(item): fixed_texts(item) for _, item, _ in order}
    own = {id(item): item.chars - sum(item.texts[h][1] for h in fixed[id(item)]) for _, item, _ in order}
    # of each item with all in it: characters, those that vary, those of links
    sums: dict[int, tuple[int, int, int]] = {}
    for _, item, _ in reversed(order):
        below = [sums[id(kid)] for kid in item.kids.values()]
        sums[id(item)] = tuple(x + sum(b[i] for b in below) for i, x in enumerate((item.chars, own[id(item)], item.links)))
    all_varying = sums[id(wrapper)][1]

    def boilerplate(item: Item, inside: bool) -> bool:
        kind, (chars, varying, links) = suspicion(item.label), sums[id(item)]
        if not kind or kind < SURE and item.label.split(".")[0] in ("article", "main"):
            return False
        if links > chars:
            return True
        if 2 * varying > all_varying:
            return False
        if kind == SURE:
            return True
        return kind == AMBIGUOUS and not inside if item.times == 1 else varying == 0  # one alone has nothing to compare with

    out, holding = set(), []  # holding: whether the open items are an article or in one
    for depth, item, _ in order:
        del holding[depth:]
        inside = bool(holding) and holding[-1]
        if boilerplate(item, inside):
            out.add(id(item))
        holding.append(inside or item.label.split(".")[0] in ("article", "main"))
    articles: dict[str, list[int]] = {}
    mains: dict[str, list[int]] = {}
    shown, above = 0, []  # above: (hidden, labels of articles) of the open items
    for depth, item, _ in order:
        del above[depth:]
        hidden, labels = above[-1] if above else (False, frozenset())
        hidden |= id(item) in out
        words = item.label.split(".")
        named = articles if words[0] == "article" or "articlebody" in words else mains if words[0] == "main" or "main" in words[1:] else None
        if not hidden:
            shown += own[id(item)]
            if named is not None and item.label not in labels:
                total = named.setdefault(item.label, [0, 0, 0, 0])
                for i, x in enumerate((*sums[id(item)], item.times)):
                    total[i] += x
                labels = labels | {item.label}
        above.append((hidden, labels))
    linked = {label for label, (chars, _, links, _) in articles.items() if links > chars}
    if linked != set(articles):
        out |= {id(item) for _, item, _ in order if item.label in linked}
        for label in linked:
            del articles[label]
    mean = lambda label: articles[label][0] / max(1, articles[label][3])
    posts = [mean(label) for label in articles if articles[label][3] <= wrapper.pages]
    teasers = {label for label, (_, _, links, times) in articles.items() if links and times > wrapper.pages and any(2 * mean(label) <= post for post in posts)}
    leading = []
    for totals, labels in ((articles, set(articles) - teasers), (mains, set(mains))):
        if labels and 4 * sum(totals[x][1] for x in labels) >= shown:
            leading.append(sorted(labels))
    rows = [[depth, item.label, sums[id(item)][1] / item.pages, own[id(item)] / item.pages, repeated, id(item) in out, fixed[id(item)]] for depth, item, repeated in order]
    return json.dumps([leading, rows])


class Place:
    """An item as a page is matched to it."""

    __slots__ = ("label", "tag", "mean", "own", "repeated", "out", "fixed", "kids", "above")

    def __init__(self, label: str = "", mean: float = 0.0, own: float = 0.0, repeated: bool = False, out: bool = False, fixed: list[int] = [], above: "Place | None" = None):  # noqa: B006
        self.label, self.tag, self.mean, self.own, self.repeated, self.out, self.fixed = label, label.split(".")[0], mean, own, repeated, out, frozenset(fixed)
        self.kids: dict[str, Place] = {}
        self.above = above


@lru_cache(maxsize=512)
def places(plan: str | None) -> tuple[list[frozenset[str]], Place]:
    leading, rows = json.loads(plan) if plan else ([], [[0, "", 0.0, 0.0, False, False, []]])
    open_: list[Place] = []
    for depth, label, *rest in rows:
        del open_[depth:]
        place = Place(label, *rest, above=open_[-1] if open_ else None)
        if open_:
            open_[-1].kids[label] = place
        open_.append(place)
    return [frozenset(x) for x in leading], open_[0]


def article_place(root: Place, seen: dict[int, list[Place]]) -> Place:
    """The item that holds the article, of those that the page has (``seen``: those in each item)."""
    place, share = root, 1.0
    while kids := seen.get(id(place)):
        best = max(kids, key=lambda k: (k.mean, k.label))
        beside = place.own > 0 or any(k.tag in FLOW and k.mean > 0 for k in kids)
        if beside or best.repeated or not best.mean:
            break
        share *= best.mean / sum(k.mean for k in kids)
        if share < MOST:
            break
        place = best
    return place


def main_text(page: str | None, leading: list[frozenset[str]], wrapper: Place, trusted: bool = True) -> str:
    """The blocks of the page's articles by its host's wrapper; not ``trusted``: whatever the wrapper says of class words."""
    if not page:
        return ""
    root = Element("")
    root.item = wrapper
    blocks: list[tuple[str, bool, Element]] = []
    run: list[tuple[Element, str]] = []

    def opened(element: Element, parent: Element) -> None:
        place, out = parent.item, False
        if element.name not in INLINE:
            found = place.kids.get(element.label)
            out = found.out if found is not None else element.suspect == SURE
            place = found or place.kids.get(element.name) or place
        elif element.suspect == SURE:
            out = True
        element.item = place
        element.inherit(parent, out and trusted)
        element.named = parent.named | {element.label} if element.article or "main" in element.label.split(".") else parent.named

    def text(element: Element, piece: str) -> None:
        if not element.no:
            run.append((element, piece))

    def block() -> None:
        if run:
            own = spaced("".join(p for _, p in run))
            if own:
                linked = len(spaced("".join(p for e, p in run if e.linked)))
                blocks.append((own, 2 * linked > len(own), run[0][0]))
            run.clear()

    read(page, root, opened, text, block)
    if not blocks and trusted:  # no class word empties a page
        return main_text(page, leading, wrapper, False)
    for labels in leading:
        own = [text for text, _, element in blocks if not labels.isdisjoint(element.named)]
        if own:
            return "\n\n".join(own)
    seen: dict[int, list[Place]] = {}
    known = {id(wrapper)}
    for _, _, element in blocks:
        place = element.item
        while id(place) not in known:
            known.add(id(place))
            seen.setdefault(id(place.above), []).append(place)
            place = place.above
    chosen = article_place(wrapper, seen)
    inside = {id(chosen)}
    todo = [chosen]
    while todo:
        kids = seen.get(id(todo.pop()), [])
        inside.update(map(id, kids))
        todo += kids
    own = [b for b in blocks if id(b[2].item) in inside]
    hosts = lambda b: b[1] or digest(b[0]) in b[2].item.fixed
    first, last = 0, len(own)
    while first < last and hosts(own[first]):
        first += 1
    while last > first and hosts(own[last - 1]):
        last -= 1
    return "\n\n".join(text for text, _, _ in own[first:last] or own or blocks)


WRAPPERS = pa.schema([("host", pa.string()), ("part", pa.int32()), ("wrapper", pa.string())])
#: What a task tells of its pages: wrappers, and (path of an item, text, pages, characters) for texts.
PARTIAL = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("path", pa.int64()), ("text", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64())])


def merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    whole = aligned([unflat(w.as_py()) for w in rows["wrapper"]])
    return pa.table({"host": [key[0].as_py()], "part": [0], "wrapper": [flat(whole)]}, WRAPPERS)


class Told:
    """What is said of each host, a text or a list of texts, looked up by pages: broadcast if it is small, else joined."""

    def __init__(self, hosts: DataFrame, size: Column):
        """``hosts``: (host, told), settled."""
        self.hosts, self.all = hosts, None
        if (hosts.agg(F.sum(size + F.length("host"))).first()[0] or 0) <= BROADCAST_BYTES:
            self.all = hosts.sparkSession.sparkContext.broadcast({r.host: r.told for r in hosts.collect()})

    def beside(self, pages: DataFrame, host: str, told: str) -> DataFrame:
        """``pages`` with a column ``told``: the host's name as the key of what is broadcast, else what is told of it."""
        if self.all is not None:
            return pages.withColumn(told, F.col(host))
        own = unused(pages, f"_{host}")
        return pages.join(self.hosts.select(F.col("host").alias(own), F.col("told").alias(told)), F.col(host) == F.col(own), "left").drop(own)

    def reader(self) -> Callable[[object], object]:
        """For tasks: from the column of ``beside`` to what is told."""
        sent = self.all
        return (lambda x: x) if sent is None else lambda x: sent.value.get(x)


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, html), each page of a host once. Only pages that have copies are shuffled, one of each task."""
    keyed = pages.where("html IS NOT NULL").withColumn("key", F.md5(F.col("html").cast("binary")))
    repeated = broadcast_few(settle(keyed.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")))
    copies = keyed.join(repeated, ["host", "key"], "left_semi").groupBy("host", "key").agg(F.first("html").alias("html"))
    return keyed.join(repeated, ["host", "key"], "left_anti").select("host", "html").unionByName(copies.select("host", "html"))


def common_labels(pages: DataFrame) -> DataFrame:
    """(host, told): the labels that one in RARE of the host's pages has, at least; exact counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, str]] = Counter()

        def passed_on() -> pa.RecordBatch:
            hosts, labels = zip(*held) if held else ((), ())
            made = pa.RecordBatch.from_pydict({"host": pa.array(hosts, pa.string()), "label": pa.array(labels, pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.update((h, label.encode("utf-8", "replace").decode()) for label in ("", *page_labels(page.as_py())))
                if len(held) > HELD_ITEMS:
                    yield passed_on()
        yield passed_on()

    counts = pages.select("host", "html").mapInArrow(counted, "host string, label string, n long").groupBy("host", "label").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    totals = counts.where("label = ''").select("host", F.col("n").alias("pages"))
    common = counts.where("label <> ''").join(totals, "host").where(F.col("n") * RARE >= F.col("pages"))
    # so many labels as RARE pages have, at most
    return settle(common.groupBy("host").agg(F.sort_array(F.collect_list("label")).alias("told")))


def host_plans(pages: DataFrame) -> DataFrame:
    """(host, told): the plan of each host's wrapper, by aligning all its pages (host, html)."""
    once = distinct_pages(pages)
    labels = Told(common_labels(once), F.length(F.array_join("told", "")))
    common_of = labels.reader()

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # wrappers of 1, 2, 4, ... pages of each host: two of about one size are aligned
        held: dict[str, list[Item]] = {}
        texts: dict[tuple[str, int, int], list[int]] = {}
        sets: dict[str, frozenset[str]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            none = [None] * len(held)
            yield pa.RecordBatch.from_pydict({"host": list(held), "wrapper": [flat(aligned(own)) for own in held.values()], "path": none, "text": none, "pages": none, "chars": none}, PARTIAL)
            if texts:
                columns = list(zip(*((h, None, path, text, n, c) for (h, path, text), (n, c) in texts.items())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTIAL)], schema=PARTIAL)
            held.clear()
            texts.clear()

        for batch in batches:
            for h, page, told in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if h not in sets:
                    if len(sets) > 256:
                        sets.clear()
                    sets[h] = frozenset(common_of(told) or ())
                whole = page_wrapper(page, sets[h])
                for path, item in along(whole):
                    for text, (_, chars) in item.texts.items():
                        count = texts.setdefault((h, path, text), [0, 0])
                        count[0], count[1] = count[0] + 1, count[1] + chars
                    item.texts = {}
                own = held.setdefault(h, [])
                own.append(whole)
                while len(own) > 1 and own[-2].pages <= own[-1].pages:
                    a = own.pop()
                    own[-1] = absorb(own[-1], a)
            if len(texts) > HELD_ITEMS or sum(size(w) for own in held.values() for w in own) > HELD_ITEMS:
                yield from passed_on()
        yield from passed_on()

    @F.arrow_udf("array<struct<path:long,item_pages:long>>")
    def items(wrappers: pa.Array) -> pa.Array:
        return pa.array(([{"path": path, "item_pages": item.pages} for path, item in along(unflat(w.as_py()))] for w in wrappers), pa.list_(pa.struct([("path", pa.int64()), ("item_pages", pa.int64())])))

    @F.arrow_udf("string")
    def planned(wrappers: pa.Array, fixed: pa.Array) -> pa.Array:
        out = []
        for w, own in zip(wrappers, fixed.to_pylist()):
            whole, by_path = unflat(w.as_py()), {}
            for f in own or ():
                by_path.setdefault(f["path"], {})[f["text"]] = [f["n"], f["chars"]]
            for path, item in along(whole):
                item.texts = by_path.get(path, {})
            out.append(plan(whole))
        return pa.array(out, pa.string())

    partial = labels.beside(once, "host", "told").select("host", "html", "told").mapInArrow(folded, "host string, wrapper string, path long, text long, pages long, chars long")
    tables = Rounds(pages.sparkSession)
    try:
        partial = tables.keep(partial)
        parts = partial.where("wrapper IS NOT NULL").select("host", "wrapper", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS)).cast("int").alias("part"))
        salted = parts.groupBy("host", "part").applyInArrow(merged, "host string, part int, wrapper string")
        wrappers = settle(salted.groupBy("host").applyInArrow(merged, "host string, part int, wrapper string").select("host", "wrapper"))
        texts = partial.where("text IS NOT NULL").groupBy("host", "path", "text").agg(F.sum("pages").alias("n"), F.sum("chars").alias("chars")).where("n > 1")
        own = wrappers.select("host", F.inline(items("wrapper")))
        fixed = texts.join(own, ["host", "path"]).where("4 * n >= 3 * item_pages")
        # as many as pages have, and a third more at most
        listed = fixed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "text", "n", "chars"))).alias("fixed"))
        return settle(wrappers.join(listed, "host", "left").select("host", planned("wrapper", "fixed").alias("told")))
    finally:
        tables.drop()


def size(root: Item) -> int:
    """Items of a wrapper."""
    n, todo = 0, [root]
    while todo:
        n += 1
        todo += todo.pop().kids.values()
    return n


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each."""
    host = host_and_path(F.col(url_col))[0]
    plans = Told(host_plans(pages.select(host.alias("host"), F.col(html_col).alias("html"))), F.length("told"))
    plan_of = plans.reader()

    @F.arrow_udf("string")
    def extracted(html: pa.Array, told: pa.Array) -> pa.Array:
        return pa.array((main_text(h.as_py(), *places(plan_of(p.as_py()))) for h, p in zip(html, told)), pa.string())

    page_host = unused(pages, "_page_host")
    numbered = pages.withColumn(page_host, host)
    told = unused(numbered, "_told")
    return plans.beside(numbered, page_host, told).withColumn(text_col, extracted(html_col, told)).drop(page_host, told)


def op6_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
