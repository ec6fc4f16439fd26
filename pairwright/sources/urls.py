"""URLs of listings and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([a-z][a-z0-9+.-]*)://([^/?#:]+)(?::\d+)?([^?#]*)(\?[^#]*)?"
ITEM_HOST = r"(?:^|\.)ebay\.(?:com|[a-z]{2}(?:\.uk)?)$"
ITEM_PATH = r"/itm/(?:[^/?#]*/)?(\d{9,15})(?:[/?#]|$)"
PRODUCT_HOST = r"(?:^|\.)amazon\.(?:com|ca|co\.uk|de|fr|es|it|co\.jp|com\.au|com\.mx)$"
PRODUCT_PATH = r"(?:/dp/|/(?:gp/)?product/)(?:-/en/)?([0-9a-z]{10})(?:[/?#]|$)"
BLOCKED = r"(?i)captcha|robot check|access denied|unusual traffic|verify you are (?:a )?human|pardon our interruption"


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, path and query; '' where a part is missing."""
    u = F.trim(F.coalesce(url, F.lit("")))
    get = lambda c, n: F.regexp_extract(c, "(?i)" + _URL, n)
    return {"scheme": F.lower(get(u, 1)), "host": F.lower(get(u, 2)), "path": get(u, 3), "query": F.regexp_replace(get(u, 4), r"^\?", "")}


def item_url(value: Column) -> Column:
    """struct of item_id, canonical_url, error (INVALID_URL, NOT_EBAY_ITEM or null)."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    full = F.when(raw.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), raw).when(raw.rlike(r"^[^\s/?#]+\.[^\s]+$"), F.concat(F.lit("https://"), raw)).otherwise("")
    p = parts(full)
    path_id = F.nullif(F.regexp_extract(p["path"], ITEM_PATH, 1), F.lit(""))
    bare = raw.rlike(r"^\d{9,15}$")
    good = p["scheme"].isin("http", "https") & (p["host"] != "")
    item = F.when(bare, raw).when(good & p["host"].rlike(ITEM_HOST), path_id)
    error = F.when(item.isNotNull(), F.lit(None).cast("string")).when(~good, "INVALID_URL").otherwise("NOT_EBAY_ITEM")
    return F.struct(item.alias("item_id"), F.concat(F.lit("https://www.ebay.com/itm/"), item).alias("canonical_url"), error.alias("error"))


def product_id(value: Column) -> Column:
    """struct of asin, url, error (ASIN_INVALID or null): a bare id, or one in a product URL."""
    raw = F.trim(F.coalesce(value, F.lit("")))
    p = parts(raw)
    bare = F.when(raw.rlike(r"(?i)^b[0-9a-z]{9}$"), F.upper(raw))
    of_site = p["scheme"].isin("http", "https") & p["host"].rlike(PRODUCT_HOST)
    inside = F.coalesce(F.nullif(F.regexp_extract(p["path"], "(?i)" + PRODUCT_PATH, 1), F.lit("")), F.nullif(F.regexp_extract(p["query"], "(?i)(?:^|&)asin=([0-9a-z]{10})", 1), F.lit("")))
    asin = F.coalesce(bare, F.when(of_site & inside.rlike("(?i)^b[0-9a-z]{9}$"), F.upper(inside)))
    return F.struct(asin.alias("asin"), F.concat(F.lit("https://www.amazon.com/dp/"), asin).alias("url"), F.when(asin.isNull(), "ASIN_INVALID").alias("error"))


def search_url(query: Column, page: Column) -> Column:
    """null for an empty query."""
    q = F.trim(F.coalesce(query, F.lit("")))
    p = F.greatest(F.lit(1), F.coalesce(page, F.lit(1))).cast("string")
    return F.when(q != "", F.concat(F.lit("https://www.amazon.com/s?k="), F.replace(F.url_encode(q), F.lit("+"), F.lit("%20")), F.lit("&page="), p, F.lit("&ref=sr_pg_"), p))


def query_value(url: Column, name: str) -> Column:
    """A parameter's decoded value, or null."""
    return F.url_decode(F.nullif(F.regexp_extract(parts(url)["query"], f"(?:^|&){name}=([^&]*)", 1), F.lit("")))


def page_number(url: Column) -> Column:
    """Page, 1 if the URL has none."""
    return F.greatest(F.lit(1), F.coalesce(F.nullif(F.regexp_extract(parts(url)["query"], r"(?:^|&)(?:page|_pgn)=(\d{1,6})", 1), F.lit("")).cast("int"), F.lit(1)))


def is_site(url: Column, domain: str) -> Column:
    """https and a host that is the domain or below it."""
    p = parts(url)
    return (p["scheme"] == "https") & ((p["host"] == domain) | p["host"].endswith("." + domain))


def is_blocked(url: Column, html: Column) -> Column:
    """S16."""
    return F.coalesce(url, F.lit("")).rlike(BLOCKED) | F.coalesce(html, F.lit("")).rlike(BLOCKED)
