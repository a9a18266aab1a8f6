"""HTML extraction: one pass in Arrow batches for the tree, native expressions for the values.

The parser is the standard library's, lenient with unclosed and stray tags; selectors are tags,
classes, ids and descendants.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import casts as C
from ..functions.text import collapse
from ..functions.urls import image_url

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def text(self) -> str:
        """Stripped text pieces joined by a blank."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if s := " ".join(n.split()):
                    out.append(s)
            elif n.tag not in SILENT:
                stack.extend(reversed(n.children))
        return " ".join(out)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def find(self, tag: str | None = None, cls: tuple[str, ...] = (), id_: str | None = None) -> Iterator["Node"]:
        for n in self.walk():
            if n is not self and (tag is None or n.tag == tag) and (id_ is None or n.attrs.get("id") == id_) and set(cls) <= set(n.classes()):
                yield n

    def first(self, *a, **k) -> "Node | None":
        return next(self.find(*a, **k), None)


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)
        self.source, self.title = "", []

    def feed(self, data):
        self.source += data
        super().feed(data)

    def place(self) -> int:
        """Where the tag at hand starts in the source."""
        line, column = self.getpos()
        start = 0
        for _ in range(line - 1):
            start = self.source.index("\n", start) + 1
        return start + column

    def title_source(self) -> str:
        """Text of the first title as written, so that its character references stay."""
        start, end = (*self.title, len(self.source))[:2] if self.title else (0, 0)
        return tree(self.source[start:end].replace("&", "&amp;")).text()

    def handle_starttag(self, tag, attrs):
        if tag == "title" and not self.title:
            self.title = [self.place() + len(self.get_starttag_text())]
        n = Node(tag, dict(attrs), self.here)
        self.here.children.append(n)
        if tag not in VOID:
            self.here = n

    def handle_startendtag(self, tag, attrs):
        if tag == "title" and not self.title:
            self.title = [0, 0]
        self.here.children.append(Node(tag, dict(attrs), self.here))

    def handle_endtag(self, tag):
        if tag == "title" and len(self.title) == 1:
            self.title.append(self.place())
        n = self.here
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.here = n.parent

    def handle_data(self, data):
        self.here.children.append(data)


def parsed(html: str | None) -> Tree:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t


def tree(html: str | None) -> Node:
    return parsed(html).root


def list_page(html: str | None) -> dict:
    """Product links and the next page's, as written."""
    root = tree(html)
    urls = []
    for pod in root.find("article", ("product_pod",)):
        for h3 in pod.find("h3"):
            a = next((n for n in h3.find("a") if n.attrs.get("href")), None)
            if a is not None:
                urls.append(a.attrs["href"])
                break
    nxt = next((a.attrs["href"] for li in root.find("li", ("next",)) for a in li.find("a") if a.attrs.get("href")), None)
    return {"urls": urls, "next": nxt}


def detail_page(url: str, html: str | None) -> dict:
    """What lies in a product page, as text; casts come later."""
    root = tree(html)
    text = lambda n: "" if n is None else n.text()
    main = root.first(cls=("product_main",)) or root
    crumbs = [t for ul in root.find("ul", ("breadcrumb",)) for li in ul.find("li") if (t := li.text())]
    rating = main.first("p", ("star-rating",)) or root.first("p", ("star-rating",))
    description, marker = "", root.first(id_="product_description")
    if marker is not None:
        rest = marker.parent.children[marker.parent.children.index(marker) + 1 :]
        description = next((n.text() for n in rest if isinstance(n, Node) and n.tag == "p"), "")
    info: dict[str, str] = {}
    for t in root.find("table", ("table", "table-striped")):
        for tr in t.find("tr"):
            if key := text(tr.first("th")):
                info[key] = text(tr.first("td"))
    img = next((i for box in (("div", ("item", "active")), ("div", ("thumbnail",)), ("div", ("carousel",))) for b in root.find(box[0], box[1]) for i in b.find("img")), None) or root.first("img")
    return {
        "title": text(main.first("h1")), "raw_breadcrumb": crumbs, "price_text": text(main.first("p", ("price_color",))), "availability_text": text(main.first("p", ("availability",))),
        "rating_classes": [] if rating is None else rating.classes(), "description": description, "product_information": [{"k": k, "v": v} for k, v in info.items()],
        "image_url": image_url(url or "", img.attrs.get("src")) if img is not None else None,
    }


_KV = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_DETAIL = {"title": pa.string(), "raw_breadcrumb": pa.list_(pa.string()), "price_text": pa.string(), "availability_text": pa.string(), "rating_classes": pa.list_(pa.string()), "description": pa.string(), "product_information": _KV, "image_url": pa.string()}
_DETAIL_DDL = "title string, raw_breadcrumb array<string>, price_text string, availability_text string, rating_classes array<string>, description string, product_information array<struct<k:string,v:string>>, image_url string"


def list_pages(pages: DataFrame) -> DataFrame:
    """(url, html) to (url, urls, next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [list_page(h) for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g["urls"] for g in got], pa.list_(pa.string())), pa.array([g["next"] for g in got], pa.string())], names=["url", "urls", "next"])

    return pages.select("url", "html").mapInArrow(run, "url string, urls array<string>, next string")


def product_pages(pages: DataFrame) -> DataFrame:
    """(seq, url, html) to product records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [detail_page(u, h) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            cols = [pa.array([g[k] for g in got], t) for k, t in _DETAIL.items()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["seq", "product_url", *_DETAIL])

    raw = pages.select("seq", "url", "html").mapInArrow(run, f"seq long, product_url string, {_DETAIL_DDL}")
    p = C.price(F.col("price_text"))
    return raw.select(
        "seq", "product_url", collapse(F.col("title")).alias("title"), "raw_breadcrumb", C.category_of(F.col("raw_breadcrumb")).alias("category"), p["price"].alias("price"), p["currency"].alias("currency"),
        "availability_text", C.in_stock(F.col("availability_text")).alias("in_stock"), C.stock_count(F.col("availability_text")).alias("stock_count"),
        C.rating_class(F.col("rating_classes")).alias("rating"), C.rating_text(F.col("rating_classes")).alias("raw_rating_text"), "description", "product_information", "image_url", F.current_timestamp().cast("string").alias("scraped_at"),
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, title, title_source (its character references as written), h1, links, text of any page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h in b.column(1).to_pylist():
                page = parsed(h)
                root = page.root
                links = [a.attrs["href"] for a in root.find("a") if a.attrs.get("href") is not None]
                t, h1 = root.first("title"), root.first("h1")
                rows.append(("" if t is None else t.text(), page.title_source(), "" if h1 is None else h1.text(), links, root.text()))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["page_id", "title", "title_source", "h1", "links", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, title string, title_source string, h1 string, links array<string>, text string")
