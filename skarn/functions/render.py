"""Rendering of pages: sanitised html with safe, absolute links, in batches by the standard library's parser."""
from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.text import cut_bytes

KEPT = frozenset("a abbr b blockquote br code dd del details div dl dt em h1 h2 h3 h4 h5 h6 hr i img kbd li ol p picture pre q s samp source span strong sub summary sup table tbody td th thead tr u ul".split())
DROPPED = frozenset("script style iframe object embed noscript template title".split())
ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "srcset", "alt", "width", "height"), "source": ("srcset", "media"), "td": ("align",), "th": ("align",)}
VOID = frozenset(("br", "hr", "img", "source"))
BADGES = 3


def safe_url(url: str, base: str) -> str | None:
    """The url against its base if it is http, https or mailto."""
    try:
        full = urljoin(base, url.strip())
        return full if urlsplit(full).scheme in ("http", "https", "mailto") else None
    except ValueError:
        return None


class _Cleaner(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.skipping, self.open = base, [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skipping += 1
        elif not self.skipping and tag in KEPT:
            kept = []
            for name, value in attrs:
                if name not in ATTRIBUTES.get(tag, ()) or value is None:
                    continue
                if name in ("href", "src"):
                    value = safe_url(value, self.base)
                elif name == "srcset":
                    parts = [p.split(None, 1) for p in value.split(",") if p.strip()]
                    value = ", ".join(" ".join([u, *p[1:]]) for p in parts if (u := safe_url(p[0], self.base))) or None
                if value is not None:
                    kept.append(f' {name}="{escape(value, quote=True)}"')
            self.out.append(f"<{tag}{''.join(kept)}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skipping:
            self.out.append(escape(data, quote=False))


def clean(html: str | None, base: str | None) -> str:
    """Allowed tags and attributes only, urls absolute, every tag closed."""
    c = _Cleaner(base or "")
    c.feed(html or "")
    c.close()
    return "".join(c.out) + "".join(f"</{t}>" for t in reversed(c.open))


def without_badges(html: Column) -> Column:
    """Drops paragraphs that are rows of linked badge images: BADGES images or more and no text."""
    image = r"(?:\s|&nbsp;|<a\b[^>]*>|</a>|<br\s*/?>)*<img\b[^>]*>(?:\s|&nbsp;|<a\b[^>]*>|</a>|<br\s*/?>)*"
    return F.regexp_replace(html, rf"(?i)<p\b[^>]*>(?:{image}){{{BADGES},}}</p>", "")


def rendered(pages: DataFrame, key: str = "page_id", html: str = "html", base: str = "url", most_bytes: int | None = None) -> DataFrame:
    """(key, html) of pages, without badge rows, cleaned; with ``most_bytes``, sources are cut there first."""
    kind = pages.schema[key].dataType.simpleString()
    source = F.col(html) if most_bytes is None else cut_bytes(F.col(html), most_bytes)
    pages = pages.withColumn(html, without_badges(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = [clean(h, b) for h, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cleaned, pa.string())], [key, "html"])

    return pages.select(key, html, base).mapInArrow(run, f"`{key}` {kind}, html string")
