"""Web pages: titles, paragraphs, headings and links by the standard library's HTML parser, in batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_SKIP = {"script", "style", "nav", "sup"}
_VOID = {"br", "img", "hr", "meta", "link", "input"}


class Page(HTMLParser):
    """Collects what a page shows; unclosed paragraphs end where the next block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.paragraphs, self.headings = "", "", [], [], []
        self.above: list[str] = []  # the heading above each link
        self._skip, self._note, self._open, self._text = 0, False, "", []

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        if tag == "html":
            self.lang = found.get("lang") or ""
        if tag == "a" and found.get("href"):
            self.links.append(found["href"])
            self.above.append(self.headings[-1] if self.headings else "")
        if tag in _SKIP:
            self._skip += 1
        elif tag == "a":
            # a marker of a footnote is no text; links don't nest
            self._note = "note-ref" in (found.get("class") or "").split()
        if tag in {"p", "h1", "h2", "h3", "title", "article", "footer", "div"}:
            self._close()
            self._open = tag
        elif tag == "br":
            self._text.append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIP and self._skip:
            self._skip -= 1
        elif tag == "a":
            self._note = False
        if tag in {"p", "h1", "h2", "h3", "title", "article", "footer", "div", "body"}:
            self._close()

    def handle_data(self, data):
        if self._open and not self._skip and not self._note:
            self._text.append(data)

    def _close(self):
        text = clean("".join(self._text))
        if text and self._open == "title":
            self.title = text
        elif text and self._open in {"h1", "h2", "h3"}:
            self.headings.append(text)
        elif text and self._open == "p":
            self.paragraphs.append(text)
        self._open, self._text = "", []


def clean(text: str) -> str:
    """No-break blanks as blanks, runs of white space as one."""
    return re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    page._close()
    return page


#: Pages that are held at once, before and after parsing.
PAGES = 200


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, title, lang, headings, paragraphs, links, above (the heading above each link)."""
    texts, lists = ("title", "lang"), ("headings", "paragraphs", "links", "above")

    def made(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES):
                batch = whole.slice(at, PAGES)
                found = [parse(h.as_py()) for h in batch.column("html")]
                columns = [pa.array([getattr(p, k) for p in found], kind) for names, kind in ((texts, pa.string()), (lists, pa.list_(pa.string()))) for k in names]
                yield pa.record_batch([batch.column("page_id"), batch.column("url"), *columns], ["page_id", "url", *texts, *lists])

    # a batch of Arrow has so many pages too, else thousands of them stand in the memory of each worker
    conf, key = pages.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= PAGES:
        conf.set(key, str(PAGES))
    return pages.select("page_id", "url", "html").mapInArrow(made, "page_id long, url string, title string, lang string, headings array<string>, paragraphs array<string>, links array<string>, above array<string>")
