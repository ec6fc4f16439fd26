"""Search and product pages as rows: result cards by tiers of selectors, what is no organic result, card fields, page counts.

Side a keys cards by a ten-character id, side b by a listing number. Pages are read in Arrow batches, once each; what follows are Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import unquote_plus

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.sources.nodes import Page, read_pages

# Selectors, in the order in which they are tried.
CARDS_A = (
    'div[data-component-type="s-search-result"]', "div.s-result-item[data-asin]", 'div[data-asin][data-index]:not([data-index=""])', 'div[data-csa-c-type="item"][data-asin]',
    'div.s-result-item[data-cy="asin-title"]', "div.a-section.s-result-card[data-asin]", "article[data-asin]",
    "div[data-asin].AdHolder", 'div[data-asin][data-component-type="sp-sponsored-result"]', "div.s-result-item[data-asin].AdHolder", 'div[data-component-type="s-sponsored-result"]',
    "div[data-asin][data-ad-id]", '[data-cy="ad-badge"]',
    "div.sg-col[data-asin]", 'div[class*="sg-col-"][data-asin]', "div.a-section[data-asin][data-index]", "div.sg-row div[data-asin]", ".s-desktop-content div[data-asin]",
    "li[data-asin]", "li.s-result-item[data-asin]", "article.s-result-item",
    '[data-cel-widget*="search_result_"]', '[data-cel-widget*="search-result"]', "div[data-uuid][data-asin]",
    '[data-asin]:not([data-asin=""])', "[data-index][data-asin]", '[data-cy="asin-title"]',
)
SCOPE_A, SCOPE_KNOWN_A = ".s-main-slot, .s-search-results, .s-result-list, #search, .s-desktop-grid", ".s-main-slot, .s-search-results, .s-result-list, #search"
LINKS_A = 'a[href*="/dp/"], a[href*="/gp/product/"], a[href*="/sspa/click"]'
ANCHORS_A = ('a[href*="/dp/"]', 'a[href*="/gp/product/"]', 'a[href*="/sspa/click"]', 'a[aria-label*="product"][href]')
WRAPS_A = 'div[data-component-type="s-search-result"], div.s-result-item, div[data-asin][data-index], div[data-asin], div[class*="sg-col"], div.a-section, li, [data-cel-widget*="search"], article[data-asin], div[data-uuid]'
AD_SELF = (
    '.AdHolder, [data-ad-id], [data-ad-placement], [data-ad-creative], [data-ad-slot], [data-component-type*="sponsored" i], [data-cel-widget*="sponsored" i], '
    '[data-csa-c-type*="sponsored" i], [data-csa-c-content-id*="sponsored" i], [data-csa-c-slot-id*="sponsored" i]'
)
AD_INSIDE = AD_SELF + ', [data-cy="ad-badge"], .ad-badge, .p13n-asin, .p13n-sc-truncate'
AD_LINK = r"[?&](?:adId|adGroupId|advertiserId|creativeId|adSlot)="
CAROUSEL = '.a-carousel-container, .a-carousel-card, .a-carousel-viewport, .a-carousel-row, [data-a-carousel-options], [data-component-type*="carousel" i], [data-csa-c-type="carousel"], .p13n-carousel'
RECOMMENDED = (
    '[data-component-type="s-instant-results"], [data-component-type="s-related-keywords"], [data-component-type="s-breadcrumb"], [data-component-type="s-suggestion"], '
    '[data-component-type="s-quick-links"], [data-component-type="s-feedback"], [data-component-type="s-pagination"], [data-component-type="s-refinements"], '
    '[data-component-type="s-sort"], [data-component-type="s-filter"], [data-component-type="s-banner"], [data-component-type="s-announcement"], '
    '[data-component-type^="s-inline-"], [data-component-type="widget-cpd"], [data-component-type="sp-also-bought"], [data-component-type="sp-related"]'
)
RECOMMENDED_ID = r"(?i)s-(suggestion|breadcrumb|pagination|refinements|quick-links|related)"
CARDS_B = ("li.s-card", "div.s-card", "li.s-card--horizontal", "li.s-card--vertical", 'div[data-testid="search-result"]', "article.s-item")
OLD_CARDS_B = ("li.s-item", "ul.srp-results li", "div.s-item__wrapper")
WRAPS_B = 'li, div[class*="s-card"], div[class*="s-item"], div[class*="srp"], article, div[data-testid="search-result"]'
LINK_B, ITEM_B = 'a[href*="/itm/"]', r"/itm/(\d{9,})"
ANCHOR_A = (
    'h2 a[href*="/dp/"]', 'h2 a[href*="/gp/product/"]', 'h2 a[href*="/sspa/click"]', "h2 a.a-link-normal[href]", 'a.a-link-normal.s-link-style[href*="/dp/"]',
    'a.a-link-normal.s-link-style[href*="/gp/product/"]', 'a[href*="/dp/"][aria-label]', 'a[href*="/gp/product/"][aria-label]', 'a[href*="/sspa/click"]', "h2 a.a-link-normal",
    '.a-link-normal[href*="/dp/"]', '[data-cy="title-recipe"] a', '[data-cy="asin-title"] a',
)
TITLE_A = (
    "h2 span", "h2 a span", "h2", "a.a-link-normal.s-link-style span", 'a[href*="/dp/"] span', 'a[href*="/gp/product/"] span', '[data-cy="title-recipe"]', '[data-cy="asin-title"]',
    ".a-text-normal", "span.a-size-medium", "span.a-size-base-plus", "span.a-text-normal",
)
NO_TITLE = r"(?i)^(sponsored|ad|best seller|amazon's choice|new|used|refurbished|renewed|limited time deal|#\d+)\b"
PRICE_A = (
    ".a-price:not(.a-text-price) .a-offscreen", "span.a-price span.a-offscreen", '.a-price[data-a-color="price"] .a-offscreen', '.a-price[data-a-size="xl"] .a-offscreen',
    '[data-cy="price-recipe"] .a-price .a-offscreen', '[data-cy="price-recipe"] .a-offscreen', '[data-component-type="s-price"] .a-offscreen', ".s-price .a-offscreen",
    'span[class*="price"] .a-offscreen', "span.a-offscreen", ".a-offscreen",
)
STRUCK = '.a-text-price, [data-a-strike="true"], s, del, strike'
PRICE_ATTRIBUTES = ("data-price", "data-a-price", "data-price-whole", "data-csa-c-price", "data-eq-price")
CARD_A = 'div[data-asin], div[data-component-type="s-search-result"]'
PRIME_A = '.prima-badge, .s-prime-badge, i.a-icon-prime, [aria-label*="Prime" i], .s-image[alt*="Prime" i]'
IMAGE_A = (
    "img.s-image", 'img[data-image-latency="s-product-image"]', 'img[src*="m.media-amazon.com"]', 'img[data-src*="images/I/"]', "img[data-a-hires]", 'img[srcset*="m.media-amazon.com"]',
    "img[data-a-dynamic-image]", ".s-product-image-container img", 'div[data-component-type="s-product-image"] img',
)
NO_IMAGE = r"/images/G/01/|/s/no-image|/svg/"
ANCHOR_B = ('a.s-card__link[href*="/itm/"]', 'a[href*="/itm/"]')
TITLE_B = (".s-card__title span.su-styled-text.primary.default", ".s-card__title", ".s-item__title", ".s-item__title span", "h3.s-item__title", 'span[role="heading"]')
LIST_WORDS_B = r"(?i)^(?:New Listing|Results for|Best Match|Sponsored|Ad)\s*[-:–]?\s*"
PRICE_B = (".s-card__price", ".s-item__price", 'span[class*="price"]', ".x-price-primary", ".s-item__detail--primary span", 'div[data-testid="item-price"]')
FOREIGN = r"[£€]|\b(?:CAD|AUD|GBP|EUR|JPY|CNY|MXN|NZD|SEK|NOK|DKK|CHF)\b"
CONDITION_B = (
    ".s-card__subtitle span.su-styled-text.secondary.default", ".s-item__condition", ".s-item__subtitle", "span.SECONDARY_INFO", ".s-item__condition-text", ".x-item-condition",
    'div[itemprop="itemCondition"]',
)
IMAGE_B = (
    ".su-media-carousel img.s-card__image", ".su-image img", "img.s-card__image", 'img[src*="i.ebayimg.com"]', ".s-item__image-wrapper img", "img.s-item__image",
    'img[data-src*="i.ebayimg.com"]', 'img[data-lazy-src*="i.ebayimg.com"]', 'img[srcset*="i.ebayimg.com"]', 'img[data-srcset*="i.ebayimg.com"]', "img[alt]",
)
TITLE_PRODUCT = "#productTitle, h1#title, .product-title-word-break, #itemTitle"
PRICE_PRODUCT = (
    "#corePrice_feature_div .a-price .a-offscreen", "#corePriceDisplay_desktop_feature_div .a-price .a-offscreen", "#apex_desktop .a-price .a-offscreen",
    "#apex_desktop_newAccordionRow .a-price .a-offscreen", ".priceToPay .a-offscreen", 'span.a-price[data-a-size="xl"] .a-offscreen', "#price_inside_buybox", "#outOfStock .a-price .a-offscreen",
)
BOX_PRODUCT, RATING_PRODUCT = "#buybox, #desktop_buybox, #centerCol", '#acrPopover, #acrPopoverLink, span.a-icon-alt, [data-hook="rating-out-of-text"]'
IMAGE_PRODUCT = '#landingImage, #imgBlkFront, img[data-a-dynamic-image], img[src*="images/I/"]'
PAGER_B = "ol.pagination__items li, .pagination__items li, .srp-controls__pagination li, .x-pagination li, nav.pagination li, div.pagination li, li[class*=\"pagination\"]"
PAGER_LINKS_B = ("ol.pagination__items a[href]", ".pagination a[href]", ".srp-controls__pagination a[href]", "li.pagination__item a[href]", 'a[href*="_pgn="]')
NEXT_B = '.pagination__next, a[aria-label*="next" i], button.pagination__next, [class*="pagination__next"]'
NEXT_A = '.s-pagination-next, a[href*="page="][aria-label*="next" i], a[href*="page="][aria-label*="siguiente" i], button[class*="next"], [role="button"][aria-label*="next" i]'
NEXT_WORDS = r"(?i)next|siguiente|suivant|weiter|prossimo|avançar"
KEY, KEY_INSIDE, TARGETS = r"/(?:dp|gp/product|gp/aw/d|sspa/click)/([A-Z0-9]{10})(?:[/?&#]|$)", r"/(?:dp|gp/product)/([A-Z0-9]{10})", ("url", "redirect")
CAPS, ENOUGH, PAGES_MOST = {"a": 240, "b": 600}, 2, 500


PRODUCT = T.StructType().add("id", "string").add("title", "string").add("price", "double").add("url", "string").add("image", "string").add("is_prime", "boolean").add("rating", "double").add("condition", "string")
ROW = T.StructType([*PRODUCT.fields, T.StructField("reject", T.StringType())])


def _found(pattern: str, text: str, group: int = 1) -> str | None:
    m = re.search(pattern, text)
    return m[group] if m else None


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def product_key(url: Column) -> Column:
    """F8: the ten-character id in a product URL, or in the target that a redirecting URL carries as a parameter; null if there is none."""
    u = F.coalesce(url, F.lit(""))
    direct = _blank(F.regexp_extract(u, KEY, 1))
    inner = F.coalesce(*[_blank(F.regexp_extract(u, rf"[?&]{name}=([^&#]*)", 1)) for name in TARGETS])
    return F.coalesce(direct, _blank(F.regexp_extract(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit(" "))), KEY_INSIDE, 1)))


def _key(url: str) -> str | None:
    """product_key of a link."""
    inner = next((v for name in TARGETS if (v := _found(rf"[?&]{name}=([^&#]*)", url))), "")
    return _found(KEY, url) or _found(KEY_INSIDE, unquote_plus(inner))


def _above_0(text: str | None) -> float | None:
    value = float(text.replace(",", "")) if text else 0.0
    return value if value > 0 else None


def number_in(text: str) -> float | None:
    """The first number of a text, None if there is none above 0."""
    return _above_0(_found(r"\d+(?:\.\d{1,2})?", text.replace(",", ""), 0))


def dollars(text: str) -> float | None:
    """The first "$amount" of a text, None if it is not above 0."""
    return _above_0(_found(r"\$\s?([\d,]*\d[\d,]*(?:\.\d+)?)", text))


def low_price(text: str) -> float | None:
    """The least dollar price of a text that names no other currency; 'C $15.00' is not a US price."""
    found = [] if re.search(FOREIGN, text) else re.findall(r"(?<![A-Z] )(?<![A-Z])\$\s*(\d[\d,]*(?:\.\d+)?)", text.replace("US $", "$"))
    return min((v for x in found if (v := _above_0(x))), default=None)


def image_url(attrs: dict[str, str]) -> str | None:
    """The first web address among an image's sources: src, lazy sources, the first of a source set, the first of a table of sizes."""
    lazy = [attrs.get(n) for n in ("data-src", "data-lazy-src", "data-original", "data-a-hires")] + [_found(r"^\s*([^\s,]+)", attrs.get(n, "")) for n in ("srcset", "data-srcset")]
    lazy.append(_found("https?://[^\"'\\s]+", attrs.get("data-a-dynamic-image", ""), 0))
    return next((u for u in (attrs.get("src"), next(filter(None, lazy), None)) if u and re.match("https?://", u)), None)


def _one(page: Page, selectors: Iterable[str], n: int) -> int | None:
    """The first node at or below n that the first selector with any matches."""
    return next((m for s in selectors if (m := page.first(s, n, own=True)) is not None), None)


def _image(page: Page, selectors: Iterable[str], n: int) -> str | None:
    m = _one(page, selectors, n)
    url = None if m is None else image_url(page.attrs[m])
    return url if url and not re.search(NO_IMAGE, url) else None


# ---------------------------------------------------------------- S5


def not_organic(page: Page, n: int) -> bool:
    """An advert by its own or inner marks, link or leading word; a carousel by itself or its parent; a recommendation by itself, an ancestor or its id."""
    if page.matches(AD_SELF, n) or page.first(AD_INSIDE, n) is not None or re.match(r"(?i)sponsored(?:\s+ad)?\b", page.text(n)):
        return True
    if any(re.search(AD_LINK, page.attr(m, "href")) for m in page.every('a[href*="/sspa/click"]', n)):
        return True
    if page.matches(CAROUSEL, n) or page.parent[n] >= 0 and page.matches(CAROUSEL, page.parent[n]):
        return True
    return page.closest(RECOMMENDED, n) is not None or bool(re.search(RECOMMENDED_ID, page.attr(n, "id")))


# ---------------------------------------------------------------- S3, S4


def _cards(page: Page, tiers: Iterable[Iterable[tuple[str | None, int]]]) -> dict[str, int]:
    """The first node of each key, in the order of the tiers; a further tier is read only while there are fewer than ENOUGH."""
    cards: dict[str, int] = {}
    for k, tier in enumerate(tiers):
        if k and len(cards) >= ENOUGH:
            break
        for key, n in tier:
            if key:
                cards.setdefault(key, n)
    return cards


def cards_a(page: Page) -> dict[str, int]:
    """S3: the organic containers of all selector groups, first of each id; with fewer than two, product links' wrappers as well."""
    scoped = bool(page.hits(SCOPE_KNOWN_A))
    inside = lambda scope, n: not scoped or page.closest(scope, n) is not None

    def contained():
        for s in CARDS_A:
            for n in page.hits(s):
                key = page.attr(n, "data-asin")
                if len(key) == 10 and inside(SCOPE_A, n) and page.first(LINKS_A, n) is not None and not not_organic(page, n):
                    yield key, n

    def wrapped(s: str):
        for a in page.hits(s):
            around = page.closest(WRAPS_A, a)
            n = a if around is None else around
            if inside(SCOPE_KNOWN_A, n):
                yield _key(page.attr(a, "href")), n

    return _cards(page, [contained(), *(wrapped(s) for s in ANCHORS_A)])


def cards_b(page: Page) -> dict[str, int]:
    """Cards of the new layout; with fewer than two, of the old one as well; and then of any listing link."""
    item = lambda a: _found(ITEM_B, page.attr(a, "href"))

    def around(a: int) -> int:
        n = page.closest(WRAPS_B, a)
        return page.parent[a] if n is None else n

    new = ((page.attr(n, "data-listingid"), n) for s in CARDS_B for n in page.hits(s) if page.first(LINK_B, n) is not None)
    old = ((item(page.first(LINK_B, n)), n) for s in OLD_CARDS_B for n in page.hits(s))
    return _cards(page, [new, old, ((item(a), around(a)) for a in page.hits(LINK_B))])


# ---------------------------------------------------------------- A23, S6, S7


def _price_inside(page: Page, n: int) -> float | None:
    """A23 below one node: hidden prices by selector, whole and fraction, data attributes, the text; nothing that is struck out."""
    if page.closest(STRUCK, n) is not None:
        return None
    live = lambda s: next((m for m in page.every(s, n) if page.closest(STRUCK, m) is None), None)
    for s in PRICE_A:
        if (v := number_in(page.raw(live(s)))) is not None:
            return v
    if (whole := live(".a-price-whole")) is not None:
        digits, box = re.sub(r"\D", "", page.raw(whole)), page.closest(".a-price", whole)
        cents = "" if box is None else re.sub(r"\D", "", page.raw(page.first(".a-price-fraction", box)))
        if int(digits or 0):
            return int(digits) + int(cents.ljust(2, "0") or 0) / 100.0
    marked = live(", ".join(f"[{a}]" for a in PRICE_ATTRIBUTES))
    if (v := number_in(page.attr(marked, *PRICE_ATTRIBUTES))) is not None:
        return v
    at, end = page.stretch(n)
    left = []
    for m in page.every(STRUCK, n):
        start, stop = page.stretch(m)
        left.append(page.raw(0)[at : max(at, start)])
        at = max(at, stop)
    return dollars(" ".join([*left, page.raw(0)[at:end]]))


def card_price(page: Page, n: int) -> float | None:
    """The price inside a card, or else inside the result card around it."""
    price = _price_inside(page, n)
    if price is None and not page.matches(CARD_A, n) and (around := page.closest(CARD_A, n)) is not None:
        price = _price_inside(page, around)
    return price


def best_title(page: Page, n: int, label: str) -> str:
    """The longest text of a title selector or the link's label; of equally long ones a heading's, then the first."""
    best, rank = label, (len(label), False)
    for s in TITLE_A:
        for m in page.every(s, n, own=True):
            text = page.text(m)
            mine = (len(text), page.matches("h2, h2 span", m))
            if mine > rank and not re.search(NO_TITLE, text):
                best, rank = text, mine
    return best


def _rating(page: Page, n: int | None) -> float | None:
    found = _found(r"(\d+(?:\.\d+)?)\s*out of 5", page.raw(n))
    return float(found) if found else None


def _condition(text: str) -> str:
    return "Used" if re.search("used|refurbished|renewed", text.lower()) else "New"


def _row_a(page: Page, n: int) -> dict:
    anchor = _one(page, ANCHOR_A, n)
    key = page.attr(n, "data-asin") or _key(page.attr(anchor, "href"))
    return {
        "id": key if key and len(key) == 10 else None, "title": best_title(page, n, " ".join(page.attr(anchor, "aria-label", "title").split())) or page.text(anchor), "price": card_price(page, n),
        "url": f"https://www.amazon.com/dp/{key}" if key else None, "image": _image(page, IMAGE_A, n), "is_prime": page.first(PRIME_A, n) is not None or bool(re.search(r"(?i)\bprime\b", page.raw(n))),
        "rating": _rating(page, page.first("span.a-icon-alt", n)), "condition": _condition(page.raw(n)), "bare": anchor is None,
    }


def _row_b(page: Page, n: int) -> dict:
    anchor = _one(page, ANCHOR_B, n)
    long = lambda selectors, least: next((t for s in selectors if len(t := page.text(page.first(s, n, own=True))) > least), "")
    title = re.sub(LIST_WORDS_B, "", long(TITLE_B, 3) or page.text(anchor))
    priced = (v for s in PRICE_B for m in page.every(s, n) if (v := low_price(page.raw(m))) is not None)
    key = page.attr(n, "data-listingid") or _found(ITEM_B, page.attr(anchor, "href"))
    image = _image(page, ("picture source[srcset], picture source[data-srcset]",), n) or _image(page, IMAGE_B, n)
    return {
        "id": key, "title": "" if re.fullmatch("(?i)shop on ebay", title) else title, "price": next(priced, None) or low_price(page.raw(n)), "url": f"https://www.ebay.com/itm/{key}" if key else None,
        "image": re.sub(r"/s-l(?:64|96|140|225)\.", "/s-l300.", image) if image else None, "is_prime": None, "rating": None, "condition": long(CONDITION_B, 1)[:60], "bare": anchor is None,
    }


def _rows(page: Page, site: str) -> list[dict]:
    """The rows of a page, and after them what is none, with the reason."""
    good: dict[str, dict] = {}
    rest = []
    for n in (cards_a if site == "a" else cards_b)(page).values():
        r = (_row_a if site == "a" else _row_b)(page, n)
        bare = r.pop("bare")
        r["reject"] = "no-anchor" if bare else "bad-id" if not r["id"] else "no-title" if len(r["title"]) < 4 else "no-price" if r["price"] is None else None
        if r["reject"]:
            rest.append(r)
        elif len(good) < CAPS[site]:
            good.setdefault(r["id"], r)
    return [*good.values(), *rest]


def search_pages(pages: DataFrame, site: str, column: str = "html") -> DataFrame:
    """A row a card: the columns of pages but the HTML, position, id, title, price, url, image, is_prime, rating, condition, reject.

    reject is null, or why a card is no row: no-anchor, bad-id, no-title, no-price. Of an id the first row stays; a page gives CAPS rows at
    most (a limit of the page format). Cards that are no organic results give no row. Null and empty pages give none.
    """
    t = read_pages(pages, column, None, "_rows", T.ArrayType(ROW), lambda page, _: _rows(page, site))
    names = [F.col(f"`{c}`") for c in t.columns if c != "_rows"]
    return t.select(*names, F.posexplode("_rows").alias("position", "_row")).select(*names, "position", "_row.*")


def _product(page: Page, url: str) -> dict | None:
    key = (_found(r"(?i)^[a-z]+://[^/?#]+[^?#]*?/(?:dp|gp/product)/([A-Z0-9]{10})(?:[/?#]|$)", url) or "").upper()
    title = page.text(page.first(TITLE_PRODUCT))
    box = next((m for s in (BOX_PRODUCT, "body") if (m := page.first(s)) is not None), 0)
    price = next((v for s in PRICE_PRODUCT if (v := number_in(page.raw(page.first(s)))) is not None), None) or dollars(page.raw(box))
    if not key or len(title) < 4 or price is None:
        return None
    top = page.raw(0)[:4000].lower()
    return {
        "id": key, "title": title, "price": price, "url": f"https://www.amazon.com/dp/{key}", "image": _image(page, (IMAGE_PRODUCT,), 0), "is_prime": bool(re.search(r"\bprime\b", top) and re.search("free shipping|free delivery", top)),
        "rating": _rating(page, page.first(RATING_PRODUCT)), "condition": _condition(page.raw(0)[:2000]),
    }


def product_pages(pages: DataFrame, column: str = "html", url: str = "url") -> DataFrame:
    """The columns of pages but the HTML, and a struct `product` (id, title, price, url, image, is_prime, rating, condition); null without id, title or price."""
    return read_pages(pages, column, url, "product", PRODUCT, _product)


# ---------------------------------------------------------------- S15


def _max_a(page: Page, url: str) -> int | None:
    links = 'a[href*="page="], a[href*="ref=sr_pg_"]'
    pager = page.first(".s-pagination-container")
    inside = [] if pager is None else page.every(links, pager)
    numbers = _numbers(page.text(m) for m in ([] if pager is None else page.every(links + ", span, div, li", pager)))
    numbers = numbers or _numbers(_found(r"[?&]page=(\d+)", page.attr(m, "href")) for m in page.hits('a[href*="page="]'))
    onward = bool(page.hits(NEXT_A)) or any(re.search(NEXT_WORDS, f"{page.text(m)} {page.attr(m, 'aria-label')}") for m in inside)
    if numbers:
        return max(numbers) + onward
    own = _found(r"[?&]page=(\d{1,9})", url) if page.hits("[data-asin]") else None
    return int(own) if own else None


def _max_b(page: Page, _: str) -> int | None:
    items = page.hits(PAGER_B)
    if numbers := _numbers(page.text(m) for m in items):
        return max(numbers) + any(re.search("(?i)next", f"{page.text(m)} {page.attr(m, 'aria-label')}") for m in items)
    for s in PAGER_LINKS_B:
        if numbers := _numbers(_found(r"(?i)(?:page\s*)?(\d{1,3})", page.attr(m, "aria-label") or page.text(m)) for m in page.hits(s)):
            return max(numbers) + bool(page.hits(NEXT_B))
    return None


def _numbers(texts: Iterable[str | None]) -> list[int]:
    found = (_found(r"^\s*(\d{1,9})", t or "") for t in texts)
    return [int(x) for x in found if x and 0 < int(x) <= PAGES_MOST]


def max_pages(pages: DataFrame, site: str, column: str = "html", url: str = "url") -> DataFrame:
    """The columns of pages but the HTML, and max_page: the largest page number that the page's controls name, one more if they lead to a next page; null if nothing tells.

    Side a: numbers in the pager, or else in links, or else of the page's own URL if it has results. Side b: numbers in the pager, or else in its links.
    """
    return read_pages(pages, column, url, "max_page", T.IntegerType(), _max_a if site == "a" else _max_b)


def parse_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """How many cards each page had and why cards gave no row."""
    names = ("no-anchor", "bad-id", "no-title", "no-price")
    return rows.groupBy(*keys).agg(F.count("*").alias("scanned"), *[F.count_if(F.col("reject") == n).alias(n.replace("-", "_")) for n in names])
