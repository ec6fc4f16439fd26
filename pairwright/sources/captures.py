"""Captured pages: search results, item pages and product pages, read from HTML and JSON-LD.

HTML needs a parser, so pages are read in Arrow batches; what they give is plain columns from there on.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Item specifics by label.
SPECIFICS = {
    "brand": "brand", "manufacturer": "brand", "mpn": "mpn", "manufacturer part number": "mpn", "part number": "mpn", "model": "model", "model number": "model", "upc": "upc",
    "ean": "ean", "gtin": "gtin", "isbn": "isbn", "type": "type", "color": "color", "size": "size", "material": "material", "compatible model": "compatibleModel",
}
ROW_CAPS = {"a": 240, "b": 600}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Node:
    __slots__ = ("attrs", "children", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict, parent=None):
        self.name, self.attrs, self.parent, self.children, self.text = name, attrs, parent, [], []

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def inner(self) -> str:
        parts, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.name not in ("script", "style"):
                todo += reversed(x.children)
        return " ".join("".join(parts).split())

    def has(self, *classes: str) -> bool:
        own = (self.attrs.get("class") or "").lower()
        return any(c in own for c in classes)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.root = self.at = _Node("#root", {})

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(page: str) -> _Node:
    tree = _Tree()
    try:
        tree.feed(page or "")
        tree.close()
    except (AssertionError, ValueError):
        pass  # broken markup is read as far as it goes
    return tree.root


def usd(text: str | None) -> float | None:
    """The low end of a dollar price, None if there is none above 0; 'C $15.00' is not a US price."""
    found = re.findall(r"(?<![A-Z] )(?<![A-Z])(?:US )?\$\s*(\d[\d,]*(?:\.\d{1,2})?)", (text or "").replace("US $", "$"))
    values = [float(x.replace(",", "")) for x in found]
    return min(values) if values and min(values) > 0 else None


def card_price(card: _Node) -> float | None:
    """The first of: hidden exact price, split whole and fraction, data attribute, text; prices that are struck out never count."""

    def struck(n):
        return n.name in ("s", "del", "strike") or n.has("strike", "list-price", "was-price", "text-price")

    above = card
    while above:
        if struck(above):
            return None
        above = above.parent
    nodes, todo = [], [card]
    while todo:  # in page order, without what is struck out and all below it
        n = todo.pop()
        nodes.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, _Node) and not struck(c)]
    for n in nodes:
        if n.has("offscreen", "s-item__price", "price-current") and (v := usd(n.inner())):
            return v
    for n in nodes:
        if n.has("price-whole"):
            whole = re.sub(r"\D", "", n.inner())
            rest = next((re.sub(r"\D", "", m.inner()) for m in nodes if m.has("price-fraction")), "")
            if whole:
                return float(f"{whole}.{rest or '0'}")
    for n in nodes:
        for key in ("data-price", "data-a-price", "content"):
            if re.fullmatch(r"\d+(?:\.\d+)?", n.attrs.get(key, "")) and float(n.attrs[key]) > 0:
                return float(n.attrs[key])
    text = " ".join(x for n in nodes for x in n.children if isinstance(x, str))
    return usd(text)


ROW = T.StructType(
    [T.StructField("position", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("url", T.StringType()), T.StructField("image", T.StringType()), T.StructField("is_prime", T.BooleanType()), T.StructField("reject", T.StringType())]
)


def search_rows(page: str, site: str) -> list[dict]:
    """The page's result cards as rows; rejects keep the reason (no-anchor, bad-id, no-title, no-price, sponsored), the rest none. First of an id wins."""
    out, seen = [], set()
    cards = [n for n in parse(page).walk() if (n.attrs.get("data-asin") if site == "a" else n.name in ("li", "div") and n.has("s-item", "s-card"))]
    for card in cards:
        anchors = [n for n in card.walk() if n.name == "a" and n.attrs.get("href")]
        href = anchors[0].attrs["href"] if anchors else None
        if site == "a":
            ident = card.attrs["data-asin"].upper()
            ident = ident if re.fullmatch(r"[0-9A-Z]{10}", ident) else None
        else:
            ident = next((m[1] for n in anchors if (m := re.search(r"/itm/(?:[^/?#]*/)?(\d{9,15})(?:[/?#]|$)", n.attrs["href"]))), None)
        titles = [t for n in card.walk() if n.name in ("h2", "h3") or n.has("title") if (t := n.inner())]
        title = max(titles, key=len, default="") or (anchors[0].inner() if anchors else "")
        image = next((n.attrs["src"] for n in card.walk() if n.name == "img" and n.attrs.get("src")), None)
        price = card_price(card)
        sponsored = card.has("sponsored", "adholder", "carousel") or any(n.has("sponsored-label") for n in card.walk())
        reject = "sponsored" if sponsored else "no-anchor" if not href else "bad-id" if not ident else "no-title" if len(title) < 4 else "no-price" if price is None else None
        if reject is None and ident in seen:
            continue
        if reject is None:
            if len(seen) == ROW_CAPS[site]:
                break
            seen.add(ident)
        out.append({"position": len(out), "id": ident, "title": title, "price": price, "url": href, "image": image, "is_prime": any(n.has("prime") for n in card.walk()), "reject": reject})
    return out


def product_node(page: str) -> dict | None:
    """The first Product in the page's JSON-LD blocks; broken blocks are passed over."""
    for n in parse(page).walk():
        if n.name == "script" and "ld+json" in n.attrs.get("type", ""):
            try:
                data = json.loads("".join(c for c in n.children if isinstance(c, str)))
            except (ValueError, RecursionError):
                continue
            todo = [data]
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    kind = x.get("@type")
                    if kind == "Product" or isinstance(kind, list) and "Product" in kind:
                        return x
                    graph = x.get("@graph")
                    todo += graph if isinstance(graph, list) else [graph] if isinstance(graph, dict) else []
    return None


def offer_price(offers) -> float | None:
    """Price, or else lowPrice, or else the least of the offers' prices."""

    def number(v):
        try:
            return float(str(v).replace(",", "")) if v is not None else None
        except ValueError:
            return None

    if isinstance(offers, dict):
        for v in (offers.get("price"), offers.get("lowPrice")):
            if (n := number(v)) is not None:
                return n
        offers = offers.get("offers")
    prices = [n for o in offers or [] if isinstance(o, dict) and (n := number(o.get("price"))) is not None] if isinstance(offers, list) else []
    return min(prices, default=None)


ITEM = T.StructType(
    [T.StructField("title", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("brand", T.StringType()), T.StructField("mpn", T.StringType()), T.StructField("model", T.StringType()), T.StructField("gtin", T.StringType()), T.StructField("image", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("specifics", T.MapType(T.StringType(), T.StringType())), T.StructField("status", T.StringType())]
)


def item_page(page: str) -> dict:
    """An item page: JSON-LD first, page nodes second; of a specific's values the first wins. status: ok or no-title."""
    root, ld = parse(page), product_node(page) or {}
    specifics: dict[str, str] = {}

    def put(label, value):
        label, value = " ".join(str(label).lower().strip(" :").split()), " ".join(str(value).split())
        if label and value:
            specifics.setdefault(SPECIFICS.get(label, label), value)

    more = ld.get("additionalProperty")
    for p in more if isinstance(more, list) else [more]:
        if isinstance(p, dict):
            put(p.get("name", ""), p.get("value", ""))
    nodes = list(root.walk())
    for n in nodes:
        cells = [c for c in n.children if isinstance(c, _Node)]
        if n.name == "tr" and len(cells) == 2 or n.has("labels-values", "label-value") and len(cells) == 2:
            put(cells[0].inner(), cells[1].inner())
        if n.name == "dl":
            for a, b in zip(cells, cells[1:], strict=False):
                if a.name == "dt" and b.name == "dd":
                    put(a.inner(), b.inner())
    meta = {n.attrs.get("property") or n.attrs.get("name"): n.attrs.get("content") for n in nodes if n.name == "meta"}
    named = lambda v: v.get("name") if isinstance(v, dict) else v
    first = lambda *vs: next((str(v).strip() for v in vs if v not in (None, "", [])), None)
    title = first(ld.get("name"), *[n.inner() for n in nodes if n.name == "h1"][:1], meta.get("og:title"))
    price = offer_price(ld.get("offers"))
    if price is None:
        price = next((v for n in nodes if n.has("price") and (v := usd(n.inner()))), None)
    gtins = [re.sub(r"\D", "", str(v)) for v in (ld.get("gtin"), ld.get("gtin13"), ld.get("gtin12"), specifics.get("upc"), specifics.get("ean"), specifics.get("gtin")) if v]
    image = ld.get("image")
    return {
        "title": title, "price": price, "brand": first(named(ld.get("brand")), specifics.get("brand")), "mpn": first(ld.get("mpn"), specifics.get("mpn")), "model": first(named(ld.get("model")), specifics.get("model")),
        "gtin": next((g for g in gtins if len(g) in (8, 12, 13, 14)), None), "image": first(image[0] if isinstance(image, list) and image else image, meta.get("og:image")),
        "condition": next((n.inner() for n in nodes if n.has("condition") and n.inner()), None), "specifics": specifics, "status": "ok" if title else "no-title",
    }


def _parsed(pages: DataFrame, column: str, function, kind: T.DataType, name: str) -> DataFrame:
    @F.pandas_udf(T.StringType())
    def run(html):
        return html.map(lambda x: json.dumps(function(x)))

    return pages.withColumn(name, F.from_json(run(F.coalesce(F.col(column), F.lit(""))), kind))


def search_pages(pages: DataFrame, site: str, column: str = "html") -> DataFrame:
    """Rows of search pages, rejects among them: the columns of pages but the HTML, and those of ROW."""
    out = _parsed(pages, column, lambda x: search_rows(x, site), T.ArrayType(ROW), "_rows").drop(column)
    return out.select("*", F.inline("_rows")).drop("_rows")


def item_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """Item pages: the columns of pages but the HTML, and a struct `item`."""
    return _parsed(pages, column, item_page, ITEM, "item").drop(column)


def parse_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many cards each page had and why rows were rejected."""
    names = ("no-anchor", "bad-id", "no-title", "no-price", "sponsored")
    return rows.groupBy(*keys).agg(F.count("*").alias("scanned"), *[F.count_if(F.col("reject") == n).alias(n.replace("-", "_")) for n in names])


def page_title(html: Column) -> Column:
    """The text of <title>, squeezed, with the five basic character references decoded."""
    t = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def max_page(urls: Column) -> Column:
    """The largest page number of a list of URLs, 500 at most; null if none has one."""
    pages = F.transform(urls, lambda u: F.nullif(F.regexp_extract(u, r"[?&](?:page|_pgn)=(\d{1,6})", 1), F.lit("")).cast("int"))
    return F.array_max(F.filter(pages, lambda n: n <= 500))
