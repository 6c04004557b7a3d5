"""Pages read by a parser: for files as they come, with any entities, and tags that are not well formed.

functions.text has the same for well-formed pages as Column expressions.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GONE = ("script", "style", "nav", "header", "footer")
VOID = ("br", "hr", "img", "input", "link", "meta", "col", "wbr", "area", "base", "source", "embed")


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.title, self.all, self.main, self.has_main = [], None, [], [], False

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        self.has_main |= tag == "main"
        if tag == "title" and self.title is None:
            self.title = []

    def handle_endtag(self, tag):
        if tag in self.open:  # what was left open inside ends as well
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1] == "title" and self.title is not None:
            self.title.append(data)
        if not any(t in GONE for t in self.open):
            self.all.append(data)
        if "main" in self.open and not any(t in GONE for t in self.open[self.open.index("main") :]):  # whatever is open around it
            self.main.append(data)


def read_page(html: str | None) -> tuple[str, str]:
    """(title, text): the text of <main>, or of the page, a line for each piece between tags; blank lines go."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (x.strip() for x in "\n".join(page.main if page.has_main else page.all).splitlines())
    return "".join(page.title or ()).strip(), "\n".join(x for x in lines if x)


def page(html: Column) -> Column:
    """struct(title, text)."""

    @F.arrow_udf("struct<title: string, text: string>")
    def read(pages: pa.Array) -> pa.Array:
        made = [read_page(x) for x in pages.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in made], pa.string()) for i in (0, 1)], ["title", "text"])

    return read(html)
