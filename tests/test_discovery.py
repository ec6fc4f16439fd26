"""Result cards, what is no organic result, card fields, product pages and page counts: literal pages and rows."""

import pytest

from pairwright.plans import page_queries
from pairwright.sources import discovery as D
from pairwright.sources.nodes import Page


def card_a(ident, title="Steel Water Bottle 32oz Insulated", price='<span class="a-price"><span class="a-offscreen">$12.50</span></span>', attrs='data-component-type="s-search-result"', more=""):
    return f'<div {attrs} data-asin="{ident}"><h2><a class="a-link-normal" href="/x/dp/{ident}?a=1"><span>{title}</span></a></h2>{price}{more}</div>'


def main(*cards):
    return f'<html><body><div class="s-main-slot">{"".join(cards)}</div></body></html>'


def rows(spark, site, **pages):
    df = spark.createDataFrame(list(pages.items()), "name string, html string")
    out: dict = {name: [] for name in pages}
    for r in D.search_pages(df, site).orderBy("name", "position").collect():
        out[r["name"]].append(r)
    return out


def ids(found):
    return [r["id"] for r in found if r["reject"] is None]


A1, A2, A3, A4 = "B000000001", "B000000002", "B000000003", "B000000004"
OLD = '<span class="a-price a-text-price"><span class="a-offscreen">$99.00</span></span>'
SPLIT = '<span class="a-price"><span class="a-price-whole">1,234.</span><span class="a-price-fraction">5</span></span>'


def test_cards_of_side_a(spark):
    got = rows(
        spark, "a",
        plain=main(card_a(A1), card_a(A2), card_a(A1, "A second card of the same id")),
        tiers=main(card_a(A1, attrs='class="s-result-item"'), f'<ul><li data-asin="{A2}"><a class="a-link-normal" href="/dp/{A2}">Plain list entry of a bottle</a> <i>$7</i></li></ul>', card_a(A3)),
        adverts=main(
            card_a(A1), card_a(A2), card_a(A3, attrs='class="s-result-item AdHolder"'), card_a(A4, more='<span class="ad-badge">x</span>'),
            card_a("B000000005", attrs='class="a-carousel-card"'), f'<div data-component-type="s-inline-editorial">{card_a("B000000006")}</div>',
            card_a("B000000007", more='<a href="/sspa/click?adId=7">y</a>'), f'<div data-component-type="s-search-result" data-asin="B000000008"><b>Sponsored</b><a href="/dp/B000000008">An advert of a bottle</a>$3</div>',
        ),
        links='<body><div id="search"><p><a class="a-link-normal" href="/dp/B000000001">A bottle found by its link alone $5.25</a></p><section><a href="/sspa/click?url=%2Fx%2Fdp%2FB000000002%3Fq">Another bottle found by link $6</a></section></div></body>',
        scoped=main(card_a(A1), card_a(A2)) + card_a(A3),
        rejects=main(card_a(A1), card_a(A2, "Cup"), card_a(A3, price=OLD), card_a(A4)),
        prices=main(card_a(A1, price=OLD + SPLIT), card_a(A2, price='<em data-price="8.75"></em>'), card_a(A3, price='<s>$9.00</s><b>only $4.40 today</b>')),
        empty="", nothing=None, broken="<div data-asin='B000000001'><a href='/dp/B000000001'>",
    )
    assert ids(got["plain"]) == [A1, A2] and [r["price"] for r in got["plain"][:2]] == [12.5, 12.5]
    assert got["plain"][0]["title"] == "Steel Water Bottle 32oz Insulated" and got["plain"][0]["url"] == "https://www.amazon.com/dp/B000000001"
    assert ids(got["tiers"]) == [A3, A1, A2]  # the order of the selectors, then of the page
    assert ids(got["adverts"]) == [A1, A2]
    assert ids(got["links"]) == [A1, A2] and [r["price"] for r in got["links"]] == [5.25, 6.0]
    assert ids(got["scoped"]) == [A1, A2]  # what is beside the list does not count
    assert ids(got["rejects"]) == [A1, A4] and sorted((r["id"], r["reject"]) for r in got["rejects"] if r["reject"]) == [(A2, "no-title"), (A3, "no-price")]
    assert [r["price"] for r in got["prices"]] == [1234.5, 8.75, 4.4]
    assert got["empty"] == [] and got["nothing"] == [] and ids(got["broken"]) == []


def card_b(ident, title="Steel Water Bottle 32oz", price="$12.50", tag='li class="s-card"', kind="s-card"):
    return f'<{tag} data-listingid="{ident}"><a class="s-card__link" href="https://x/itm/{ident}?h=1"><span class="{kind}__title">{title}</span></a><span class="{kind}__price">{price}</span></{tag.split()[0]}>'


def old_b(ident, title="Old layout water bottle"):
    return f'<li class="s-item"><a href="https://x/itm/{ident}"><h3 class="s-item__title">{title}</h3></a><span class="s-item__price">$3.00 to $5.00</span><img data-src="https://i.ebayimg.com/s-l140.jpg" src="data:x"></li>'


def test_cards_of_side_b(spark):
    B1, B2, B3 = "295000000001", "295000000002", "295000000003"
    got = rows(
        spark, "b",
        new=f"<ul>{card_b(B1, 'New Listing: Steel Water Bottle')}{card_b(B2)}{old_b(B3)}</ul>",
        old=f"<ul>{card_b(B1)}{old_b(B2)}{old_b(B3)}</ul>",
        links=f'<div><p><a href="/itm/{B1}">A bottle found by link</a> $4</p></div><article><a href="/itm/{B2}">Second bottle by link</a> $5</article>',
        foreign=f"<ul>{card_b(B1, price='C $15.00')}{card_b(B2, price='US $1,015.00')}{card_b(B3, 'Shop on eBay')}</ul>",
    )
    assert ids(got["new"]) == [B1, B2] and got["new"][0]["title"] == "Steel Water Bottle"
    assert ids(got["old"]) == [B1, B2, B3] and got["old"][1]["price"] == 3.0 and got["old"][1]["image"] == "https://i.ebayimg.com/s-l300.jpg"
    assert ids(got["links"]) == [B1, B2]
    assert [(r["id"], r["price"], r["reject"]) for r in got["foreign"]] == [(B2, 1015.0, None), (B1, None, "no-price"), (B3, 12.5, "no-title")]
    counts = D.parse_counts(spark.createDataFrame([("p", r["reject"]) for r in got["foreign"]], "page string, reject string"), "page").collect()[0]
    assert (counts["scanned"], counts["no_price"], counts["no_title"], counts["bad_id"]) == (3, 1, 1, 0)


PRODUCT = '<body><h1 id="title"><span id="productTitle"> Steel  Bottle </span></h1>{}<span class="a-icon-alt">4.6 out of 5 stars</span><img id="landingImage" src="https://m/i.jpg"></body>'


def test_product_pages(spark):
    url = "https://www.amazon.com/x/dp/b000000001?th=1"
    data = {
        "core": (url, PRODUCT.format('<div id="price_inside_buybox">$19</div><div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">$18.99</span></span></div> Prime FREE delivery')),
        "box": (url, PRODUCT.format('<div>$1</div><div id="buybox">now $17.25, Renewed</div>')),
        "no-price": (url, PRODUCT.format("")),
        "no-id": ("https://www.amazon.com/s?k=x", PRODUCT.format('<div id="buybox">$17.25</div>')),
        "null": (None, None),
    }
    got = {r["name"]: r["product"] for r in D.product_pages(spark.createDataFrame([(k, *v) for k, v in data.items()], "name string, url string, html string")).collect()}
    assert got["core"].asDict() == {"id": "B000000001", "title": "Steel Bottle", "price": 18.99, "url": "https://www.amazon.com/dp/B000000001", "image": "https://m/i.jpg", "is_prime": True, "rating": 4.6, "condition": "New"}
    assert (got["box"]["price"], got["box"]["condition"], got["box"]["is_prime"]) == (17.25, "Used", False)
    assert got["no-price"] is None and got["no-id"] is None and got["null"] is None


@pytest.mark.parametrize(
    ("site", "url", "html", "expected"),
    [
        ("a", None, '<div class="s-pagination-container"><a href="?page=2">2</a><span>7</span><a href="?page=2">Next</a></div>', 8),
        ("a", None, '<div class="s-pagination-container"><span>1</span><span>3</span></div>', 3),
        ("a", None, '<a href="/s?k=x&page=4">more</a><a href="/s?k=x&page=501">last</a>', 4),
        ("a", "https://x/s?k=y&page=6", f'<div data-asin="{A1}"></div>', 6),
        ("a", "https://x/s?k=y&page=6", "<p>no results</p>", None),
        ("b", None, '<ol class="pagination__items"><li>1</li><li>2</li><li>5</li></ol>', 5),
        ("b", None, '<ol class="pagination__items"><li>1</li><li>2</li><li>Next</li></ol>', 3),
        ("b", None, '<div class="pagination"><a href="?q" aria-label="Page 9">x</a></div><button class="pagination__next">more</button>', 10),
        ("b", None, "", None),
    ],
)
def test_page_counts(spark, site, url, html, expected):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    assert D.max_pages(df, site).collect()[0]["max_page"] == expected


def test_product_key(spark):
    data = [
        ("https://x/dp/B000000001", "B000000001"), ("/gp/product/B000000001?x", "B000000001"), ("/sspa/click/B000000001", "B000000001"), ("/dp/B0000000011", None),
        ("/sspa/click?adId=3&url=%2Fname%2Fdp%2FB000000002%2Fref", "B000000002"), ("/r?redirect=https%3A%2F%2Fx%2Fdp%2FB000000003", "B000000003"), ("/r?url=%zz", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(data, "u string, k string")
    assert [r["got"] for r in df.withColumn("got", D.product_key(df["u"])).collect()] == [k for _, k in data]


def test_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", main(card_a(A1), card_a(A2)), "u")], "`a.b` int, nodes string, html string, _url string")
    got = D.search_pages(df, "a").orderBy("position").collect()
    assert [(r["a.b"], r["nodes"], r["_url"], r["id"]) for r in got] == [(1, "x", "u", A1), (1, "x", "u", A2)]
    none = spark.createDataFrame([], "url string, html string")
    assert D.search_pages(none, "b").count() == D.product_pages(none).count() == D.max_pages(none, "a").count() == 0


def test_pages_of_a_small_file_are_read_in_many_tasks(spark, tmp_path):
    rows = [(k, "red cup", 7, 100.0 + k) for k in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for q in (page_queries.product_pages, page_queries.search_cards_a, page_queries.search_cards_b):
        assert q(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    assert page_queries.card_counts(spark, str(tmp_path)).agg({"scanned": "sum"}).first()[0] == 300


def test_selectors_look_only_at_nodes_with_their_mark():
    html = "<ul id='l'>" + "<li class='a b'><i x='1'><b class='a'></b></i></li>" * 50 + "</ul><p class='c'><b class='a' id='z'></b></p>"
    page = Page(html)
    looked = []

    class Seen(list):
        def __getitem__(self, n):
            looked.append(n)
            return list.__getitem__(self, n)

    page.attrs = Seen(page.attrs)
    assert len(page.hits(".a")) == 101 and len(page.hits("li .a")) == 50 and len(page.hits("ul li i[x='1'] b, p".replace("'", '"'))) == 51
    looked.clear()
    [z] = page.hits("p .a#z")
    assert page.tag[z] == "b" and len(looked) == 2 and page.hits("ul p b") == [] and page.hits("div") == []
    assert [page.tag[n] for n in page.hits(":not(li)")].count("li") == 0 and len(page.hits(":not(li)")) == len(page.tag) - 50
