"""Registered queries over search and product pages: Spark renders the rows of given tables as pages of several layouts and reads them back.

The twins know nothing of pages: they say what each layout must give from the row that it was rendered from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.plans.catalogue import query
from pairwright.session import spread
from pairwright.sources import discovery
from pairwright.sources.listings import table

#: A part as a result card of side a, by p_partkey % 8; k is its id, t its title, p its price in text.
_CARD_A = """concat(
case p_partkey % 8 when 0 then '<div class="s-result-item"' when 1 then '<article' when 2 then '<div class="s-result-item AdHolder"' when 3 then '<li' when 7 then '<div class="a-carousel-card"' else '<div data-component-type="s-search-result"' end,
' data-asin="', k, '"><h2><a class="a-link-normal" href="', case when p_partkey % 8 = 4 then concat('/sspa/click?url=%2Fn%2Fdp%2F', k) else concat('/n/dp/', k, '?ref=1') end, '"><span>', t, '</span></a></h2>',
case p_partkey % 8 when 0 then concat('<span class="a-price"><span class="a-price-whole">', substring_index(p, '.', 1), '.</span><span class="a-price-fraction">', substring_index(p, '.', -1), '</span></span>')
  when 1 then concat('<em data-price="', p, '"></em>') when 3 then concat('<del>$1.00</del><b>now $', p, '</b>') when 5 then concat('<span class="a-price a-text-price"><span class="a-offscreen">$', p, '</span></span>')
  else concat('<span class="a-price a-text-price"><span class="a-offscreen">$1.00</span></span><span class="a-price"><span class="a-offscreen">$', p, '</span></span>') end,
case when p_partkey % 3 = 0 then '<i class="a-icon-prime"></i>' else '' end, ' <span class="a-icon-alt">', p_size % 5, '.5 out of 5 stars</span>',
case p_partkey % 8 when 1 then '</article>' when 3 then '</li>' else '</div>' end)"""

#: A part as a result card of side b, by p_partkey % 5; every other page of twenty parts has the old layout.
_CARD_B = """concat(case when p_partkey div 20 % 2 = 0 then concat('<li class="s-card" data-listingid="', k, '">') else '<li class="s-item">' end,
'<a href="https://www.ebay.com/itm/', k, '?h=1"><h3 class="s-item__title">', case p_partkey % 5 when 0 then 'Shop on eBay' when 1 then concat('New Listing: ', t) else t end, '</h3></a>',
'<span class="s-item__price">', case p_partkey % 5 when 2 then 'C $' when 3 then 'US $' else '$' end, p, case when p_partkey % 5 = 4 then ' to $5,000.00' else '' end, '</span>',
'<img alt="" src="data:image/gif" data-src="https://i.ebayimg.com/', k, '/s-l140.jpg"></li>')"""


def _part(spark, sf_dir: str, digits: str, size: int = 1) -> DataFrame:
    """Parts and the page of `size` parts that each stands on; those of a page are in one task, ahead of rendering and reading."""
    p = spread(table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / size)), "page")
    return p.withColumns({"k": F.expr(digits), "t": F.expr("concat('Item ', p_name)"), "p": F.expr("cast(cast(p_retailprice as decimal(12, 2)) as string)")})


def _results(parts: DataFrame, card: str) -> DataFrame:
    """Pages of cards in the order of p_partkey."""
    cards = parts.select("page", F.struct("p_partkey", F.expr(card).alias("card")).alias("c"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["card"]), "")
    return cards.groupBy("page").agg(F.concat(F.lit('<html><body><div class="s-main-slot"><ul>'), joined, F.lit("</ul></div></body></html>")).alias("html"))


_PARTS = "select *, 'Item ' || p_name as t, cast(cast(p_retailprice as decimal(12, 2)) as double) as p from part"


@query(f"""select p_partkey // 20 as page, 'B' || lpad(cast(p_partkey as varchar), 9, '0') as id, t as title, case when p_partkey % 8 <> 5 then p end as price, p_partkey % 3 = 0 as is_prime, p_size % 5 + 0.5::double as rating,
    case when p_partkey % 8 = 5 then 'no-price' end as reject from ({_PARTS}) where p_partkey % 8 not in (2, 7)""")
def search_cards_a(spark, sf_dir):
    """Parts as result pages of side a, read back: six layouts of cards, two kinds of adverts that go, five forms of prices."""
    pages = _results(_part(spark, sf_dir, "concat('B', lpad(cast(p_partkey as string), 9, '0'))", 20), _CARD_A)
    return discovery.search_pages(pages, "a").select("page", "id", "title", "price", "is_prime", "rating", "reject")


@query(f"""select p_partkey // 20 as page, cast(100000000000 + p_partkey as varchar) as id, case when p_partkey % 5 = 0 then '' else t end as title, case when p_partkey % 5 <> 2 then p end as price,
    'https://i.ebayimg.com/' || cast(100000000000 + p_partkey as varchar) || '/s-l300.jpg' as image, case p_partkey % 5 when 0 then 'no-title' when 2 then 'no-price' end as reject from ({_PARTS})""")
def search_cards_b(spark, sf_dir):
    """Parts as result pages of side b, every other page in the old layout."""
    pages = _results(_part(spark, sf_dir, "cast(100000000000 + p_partkey as string)", 20), _CARD_B)
    return discovery.search_pages(pages, "b").select("page", "id", "title", "price", "image", "reject")


@query("""select p_partkey // 20 as page, sum(case when p_partkey % 8 not in (2, 7) then 1 else 0 end)::bigint as scanned, 0::bigint as no_anchor, 0::bigint as bad_id, 0::bigint as no_title,
    sum(case when p_partkey % 8 = 5 then 1 else 0 end)::bigint as no_price from part group by 1""")
def card_counts(spark, sf_dir):
    """Cards of each page of side a, and why some gave no row."""
    return discovery.parse_counts(search_cards_a(spark, sf_dir), "page")


_PRODUCT = """concat('<html><body><h1 id="title"><span id="productTitle"> ', t, ' </span></h1>',
case p_partkey % 6 when 0 then concat('<div id="corePrice_feature_div"><span class="a-price"><span class="a-offscreen">$', p, '</span></span></div><span id="price_inside_buybox">$1.00</span>')
  when 1 then concat('<span class="priceToPay"><span class="a-offscreen">$', p, '</span></span>') when 2 then concat('<span id="price_inside_buybox">$', p, '</span>')
  when 3 then concat('<p>$2.00</p><div id="buybox">yours for $', p, '</div>') when 4 then concat('<p>was $', p, '</p>') else '<p>out of stock</p>' end,
case when p_partkey % 2 = 0 then ' <b>Prime</b> FREE delivery' else ' <b>Prime</b>' end, case when p_partkey % 7 = 0 then ' Renewed' else '' end,
case when p_partkey % 4 > 0 then concat('<span data-hook="rating-out-of-text">', p_size % 5, '.5 out of 5</span>') else '' end, '<img id="landingImage" data-a-hires="https://m.media-amazon.com/images/I/', k, '.jpg"></body></html>')"""


@query(f"""select p_partkey, 'B' || lpad(cast(p_partkey as varchar), 9, '0') as id, t as title, p as price, p_partkey % 2 = 0 as is_prime, case when p_partkey % 4 > 0 then p_size % 5 + 0.5::double end as rating,
    case when p_partkey % 7 = 0 then 'Used' else 'New' end as condition, 'https://m.media-amazon.com/images/I/B' || lpad(cast(p_partkey as varchar), 9, '0') || '.jpg' as image from ({_PARTS}) where p_partkey % 6 <> 5 and p_partkey % 11 > 0""")
def product_pages(spark, sf_dir):
    """Parts as product pages, read back: five places of the price; no row without a price or an id."""
    parts = _part(spark, sf_dir, "concat('B', lpad(cast(p_partkey as string), 9, '0'))")
    pages = parts.select("p_partkey", F.expr("concat('https://www.amazon.com/', case when p_partkey % 11 > 0 then 'n/dp/' else 's/' end, lower(k), '?th=1')").alias("url"), F.expr(_PRODUCT).alias("html"))
    return discovery.product_pages(pages).where("product is not null").select("p_partkey", "product.id", "product.title", "product.price", "product.is_prime", "product.rating", "product.condition", "product.image")


_PAGER = """case o_orderkey % 6 when 0 then concat('<div class="s-pagination-container"><span>1</span><span>', n, '</span></div>')
when 1 then concat('<div class="s-pagination-container"><a href="/s?page=2">2</a><span>', n, '</span><a href="/s?page=2">Next</a></div>') when 2 then concat('<a href="/s?k=x&page=', n, '">more</a><a href="/s?k=x&page=501">last</a>')
when 3 then '<div data-asin="B000000001"></div>' when 4 then concat('<a href="/s?page=', n, '" aria-label="Go to next page">x</a>') else '<p>none</p>' end"""


@query("""select o_orderkey, cast(case o_orderkey % 6 when 0 then n when 1 then n + 1 when 2 then n when 3 then 77 when 4 then n + 1 end as integer) as max_page from (select o_orderkey, 3 + o_custkey % 40 as n from orders)""")
def page_counts(spark, sf_dir):
    """A page of six forms for each order."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", F.expr("3 + o_custkey % 40").alias("n")), "o_orderkey")
    pages = o.select("o_orderkey", F.lit("https://www.amazon.com/s?k=x&page=77").alias("url"), F.expr(_PAGER).alias("html"))
    return discovery.max_pages(pages, "a").select("o_orderkey", "max_page")


@query("""select o_orderkey, case when o_orderkey % 6 < 4 then 'B' || lpad(cast(o_orderkey as varchar), 9, '0') end as id from orders""")
def product_links(spark, sf_dir):
    """F8: links of six forms, two of them redirects."""
    k = "concat('B', lpad(cast(o_orderkey as string), 9, '0'))"
    link = f"case o_orderkey % 6 when 0 then concat('/n/dp/', {k}, '?a=1') when 1 then concat('https://x/gp/product/', {k}) when 2 then concat('/sspa/click?adId=1&url=%2Fn%2Fdp%2F', {k}, '%2Fref') when 3 then concat('/r?redirect=https%3A%2F%2Fx%2Fdp%2F', {k}) when 4 then concat('/dp/', {k}, '0') else concat('/s?k=', {k}) end"
    return table(spark, sf_dir, "orders").select("o_orderkey", discovery.product_key(F.expr(link)).alias("id"))
