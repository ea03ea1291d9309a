"""HTML pages by the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

_SKIP = {"script", "style", "nav", "footer", "header", "noscript", "template"}
_BLOCK = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "blockquote", "pre", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "main", "figure"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skipping: list[str] = []
        self.title = ""
        self.headings: list[tuple[int, str]] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipping.append(tag)
        if tag in _BLOCK:
            self.out.append("\n")
        if tag == "title" or re.fullmatch(r"h[1-6]", tag):
            self.inside.append(tag)
            if tag != "title":
                self.headings.append((int(tag[1]), ""))

    def handle_endtag(self, tag):
        if self.skipping and tag == self.skipping[-1]:
            self.skipping.pop()
        if tag in _BLOCK:
            self.out.append("\n")
        if tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
            return
        if self.skipping:
            return
        if self.inside and self.headings:
            level, said = self.headings[-1]
            self.headings[-1] = (level, said + data)
        self.out.append(data)


def _clean(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def read(html: str | None) -> tuple[str, list[tuple[int, str]], str]:
    """Title, headings and text (a line for each block) of a page."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    lines = [x for x in map(_clean, "".join(r.out).split("\n")) if x]
    return _clean(r.title), [(n, _clean(x)) for n, x in r.headings if _clean(x)], "\n".join(lines)


def text_of(html: str | None) -> str:
    """Text on one line: block tags part words, inline tags don't."""
    return _clean(read(html)[2])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, n_headings, toc (an outline), text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [read(x) for x in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([t for t, _, _ in got], pa.string()), pa.array([len(h) for _, h, _ in got], pa.int32()), pa.array(["\n".join("  " * (n - 1) + x for n, x in h) for _, h, _ in got], pa.string()), pa.array([x for _, _, x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "title", "n_headings", "toc", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, n_headings int, toc string, text string")
