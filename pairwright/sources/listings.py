"""Listing views over the driver's tables: catalog (buying side) and offers (selling side), with a keyword run for each.

One SQL text makes each view, in words that Spark and DuckDB share, so a query and its SQL twin read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What titles are made of.
MAKERS = ("logitech", "sony", "stanley", "anker", "razer", "philips", "lego", "canon", "hydro flask", "generic", "samsung", "no brand")
KINDS = ("gaming mouse", "wireless headphones", "water bottle", "power bank", "mechanical keyboard", "ssd", "smartphone", "running shoes")
SPAM = ("fast free shipping ", "brand new ", "hot sale ", "", "us seller ", "", "must have ", "")
PACKS = ("", " 2 pack", " pack of 3", "", " 6 count", " set of 4", "", " 12pk")
CONDITIONS = ("new", "used", "refurbished", "open box", "")


def pick(values: tuple[str, ...], index: str) -> str:
    """SQL that takes one of the values by index (0 and up, modulo their number)."""
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"(case ({index}) % {len(values)} {cases} end)"


def _name(key: str) -> str:
    return pick(MAKERS, key)


_MODEL = "concat('m', cast(p.p_partkey % 400 as varchar(10)), 'x')"
_RUN = "concat(p.p_brand, ' ', p.p_name)"

CATALOG = f"""
select p.p_partkey as id, {_RUN} as run,
  concat({_name('p.p_partkey')}, ' ', {_MODEL}, ' ', {pick(KINDS, 'p.p_size')}, ' ', p.p_name, ' ', lower(p.p_type), ' ', cast(p.p_size as varchar(10)), ' oz',
    {pick(PACKS, 'p.p_partkey % 7')}) as title,
  p.p_retailprice / 20 as price, p.p_partkey % 3 = 0 as is_prime,
  concat('https://m.example.com/img/', cast(p.p_partkey % 50 as varchar(10)), '.jpg') as image,
  {pick(CONDITIONS, 'p.p_size')} as condition
from part p
"""

#: An offer is what one supplier asks for one part: the least price and shipping of all its lines.
OFFER_ID = "cast(l_partkey as bigint) * 100000000 + l_suppkey"

OFFERS = f"""
select l.id, {_RUN} as run, p.p_partkey as part_id,
  concat({pick(SPAM, 'p.p_partkey + l.l_suppkey')}, p.p_name, ' ', {_name('p.p_partkey + l.l_suppkey % 3 * 4')}, ' ', {pick(KINDS, 'p.p_size')}, ' ', {_MODEL},
    {pick(PACKS, 'l.l_suppkey')}, ' ', cast(p.p_size as varchar(10)), 'oz ', lower(p.p_type)) as title,
  l.price, l.shipping,
  concat('https://n.example.com/pic/', cast(p.p_partkey % 50 as varchar(10)), '.jpg') as image,
  {pick(CONDITIONS, 'l.l_suppkey')} as condition,
  case when l.id % 11 = 0 then '012345678905' end as gtin
from (select {OFFER_ID} as id, l_partkey, l_suppkey, min(l_extendedprice / l_quantity) / 20 as price, min(l_tax) * 100 as shipping
  from lineitem group by l_partkey, l_suppkey) l
join part p on l.l_partkey = p.p_partkey
"""

#: For DuckDB: the views as common table expressions.
CTE = f"with catalog as ({CATALOG}), offers as ({OFFERS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CATALOG.replace("from part p", "from {part} p"), part=table(spark, sf_dir, "part"))


def offers(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """only: the offers whose id it has (a column), found by their lines, ahead of grouping these."""
    text = OFFERS.replace("from lineitem group", "from {lineitem} group").replace("join part p", "join {part} p")
    lines = table(spark, sf_dir, "lineitem")
    if only is not None:
        lines = lines.join(only.toDF("_only"), F.expr(OFFER_ID) == F.col("_only"), "left_semi")
    return spark.sql(text, part=table(spark, sf_dir, "part"), lineitem=lines)
