"""Links of HTML pages, and lossless segments of text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are cut at a time.
CUT_TEXTS = 16
SEGMENT = re.compile(r"[^\W_]+|[\W_]+")


class Links(HTMLParser):
    """The targets of links, with their texts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.inside = href is not None
            if self.inside:
                self.links.append([href, ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.links[-1][1] += data


def read_links(page: str | None) -> list[dict[str, str]]:
    parser = Links()
    parser.feed(page or "")
    parser.close()
    return [{"href": href, "name": name.strip()} for href, name in parser.links]


def links(page: Column) -> Column:
    """(href, name) of each link of a page."""

    @F.pandas_udf("array<struct<href:string,name:string>>")
    def listed(pages: pd.Series) -> pd.Series:
        return pages.map(read_links)

    return listed(page)


def segment_lists(texts: pa.Array) -> pa.Array:
    """The segments of each text, of few texts at a time: as Python's strings they take many times their bytes."""
    some = (texts.slice(at, CUT_TEXTS).to_pylist() for at in range(0, len(texts), CUT_TEXTS))
    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([SEGMENT.findall(t or "") for t in few], kind) for few in some)])


def segments(text: Column) -> Column:
    """Runs of word characters and what is between them; joined they are the text."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return segment_lists(texts)

    return cut(text)
